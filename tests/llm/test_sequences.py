"""SentencePiece, Merkle manifest and periodic runs: against the library, a
plain tree and brute force."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.llm import merkle, periodic, pieces
from pagemill.llm.queries import planted

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)
TEXTS = [None, "", " ", "  ", "a", " a  b ", "x\n\ny  \n z\n", "\n", "\n \n", "a▁b ▁▁ c", "<s> </s> <unk> <0x41>", "\x00\t\r\r x", "é́ 日本語 😀 \U0010ffff",
         "if (x) {\r\n    y();\r\n}", "naïve café " * 3, "z" * 5000, ("word " * 7000) + "end", "same text here", "same text here"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("table_chunks", [0, 3, 1 << 17])
def test_pieces_equal_the_library(spark, table_chunks):
    docs = spark.createDataFrame([(i % 15, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string").repartition(3)
    out = pieces.decode(pieces.encode(docs, MODEL, table_chunks=table_chunks), MODEL).collect()
    assert sorted(repr(r.text) for r in out) == sorted(map(repr, TEXTS))
    for r in out:
        ids = SP.encode(r.text or "")
        assert r.ids == ids and r.decoded == SP.decode(ids)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab ▁\n\t\r.é日😀(){};1")), max_size=40), min_size=1, max_size=6))
def test_chunks_join_to_the_whole(texts):
    import pyarrow as pa
    from pagemill.llm.common import text_chunks
    marked = [" " + t.replace("▁", " ") if t else "" for t in texts]
    table = pieces._Table(MODEL, pa.array([], pa.large_binary()), np.zeros(0, np.int32), np.zeros(1, np.int64))
    for i, j, buf, offs in text_chunks(pa.array(marked), 1 << 20, lower=False):
        at, ends = pieces.cut(buf, offs)
        chunks, code = pieces.distinct(buf, at)
        ids, per = table.pieces(chunks)
        for k in range(i, j):
            got = [x for c in code[ends[k - i]:ends[k - i + 1]] for x in ids[per[c]:per[c + 1]].tolist()]
            assert got == SP.encode(texts[k])


def test_chunk_table_counts_slices(spark):
    docs = spark.createDataFrame([("one two two",), ("two three",), ("three",), (None,)], "text string").repartition(4, F.xxhash64("text"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        rows = {bytes(r.chunk): (r.n, r.ids) for r in pieces.chunk_table(docs, MODEL).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)
    assert {c: n for c, (n, _) in rows.items()} == {b" two": 2, b" three": 2}
    assert rows[b" two"][1] == SP.encode("two")


def test_workers_hold_short_batches(spark, capsys):
    """Lists of ids are sent once, in batches of ``ROWS``: two workers and the JVM hold them at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)
    rows = spark.range(3000, numPartitions=1).selectExpr("id", "array_repeat(int(300 + id % 7), 40) AS ids")
    out = pieces.decode(rows, MODEL)
    out.explain()
    assert "_ids" not in capsys.readouterr().out
    assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 640
    assert {(r.id, r.decoded) for r in out.collect()} == {(i, SP.decode([300 + i % 7] * 40)) for i in range(3000)}
    longs = pieces.decode(rows.selectExpr("id", "cast(ids AS array<bigint>) AS ids"), MODEL)
    assert {(r.id, r.decoded) for r in longs.collect()} == {(r.id, r.decoded) for r in out.collect()}


def test_decode_of_any_ids(spark):
    lists = [None, [], [1, 306, 2], [0, 306], [3 + 0xC3, 3 + 0xA9], [3 + 0xC3, 306], [3 + 0xA9], [28705, 28705, 306], [13, 13]]
    rows = spark.createDataFrame([(x, 1) for x in lists], "ids array<int>, decoded int")
    assert [r.decoded for r in pieces.decode(rows, MODEL).collect()] == [SP.decode(x or []) for x in lists]
    with pytest.raises(Exception, match="outside the model"):
        pieces.decode(spark.createDataFrame([([32000],)], "ids array<int>"), MODEL).collect()
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.decode(pieces.encode(none, MODEL), MODEL).count() == 0


def node(run):
    return sha("".join(run))


def plain_tree(leaves, fanout):
    """(top, path per leaf) by lists."""
    level, paths, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for i in range(len(leaves)):
            lo = at[i] // fanout * fanout
            paths[i].append(("".join(level[lo:at[i]]), "".join(level[at[i] + 1:lo + fanout])))
            at[i] //= fanout
        level = [node(level[i:i + fanout]) for i in range(0, len(level), fanout)]
    return level[0], paths


@pytest.mark.parametrize("fanout,n", [(2, 90), (3, 41), (2, 1)])
def test_manifest_equals_a_plain_tree(spark, fanout, n):
    rng = random.Random(n)
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, "", "de", "en", "en", "en", "é"]), sha(str(rng.randrange(60))), "x") for _ in range(n)]
    rows += rows[:3] if n > 3 else []
    table = spark.createDataFrame(rows, "doc_id int, lang string, leaf string, root string").repartition(4)
    got = merkle.manifest(table, fanout=fanout).withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, r[2]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g])], fanout) for g in order}
    root, upper = plain_tree([trees[g][0] for g in order], fanout)
    want = sorted((str(g), *leaf, str([*p, *up])) for g, up in zip(order, upper) for leaf, p in zip(sorted(groups[g]), trees[g][1]))
    assert sorted((str(r.lang), r.doc_id is not None, r.doc_id or 0, r.leaf, str([tuple(s) for s in r.path])) for r in got) == want
    assert all(r.root == r.folded == root and r.subroot == trees[r.lang][0] for r in got)


def test_manifest_odd_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, leaf string")
    assert merkle.manifest(docs).count() == 0
    same = spark.range(300).selectExpr("1L AS doc_id", "'en' AS lang", "'ab' AS leaf", "2 AS `_g`", "3 AS `_row`", "4 AS path")
    out = merkle.manifest(same)
    assert out.columns == ["doc_id", "lang", "leaf", "_g", "_row", "subroot", "root", "path"]
    assert out.count() == 300 and out.where(merkle.fold(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
    assert out.where(merkle.fold(F.lit("no"), F.col("path")) == F.col("root")).count() == 0
    leaf = spark.sql("SELECT cast(null AS long) AS a, 'é' AS b, 12L AS c").select(merkle.leaf_digest(F.col("a"), F.col("b"), F.col("c")).alias("x")).first().x
    assert leaf == sha("-2:é2:12")
    nulls = merkle.manifest(spark.sql("SELECT cast(null AS string) AS leaf, cast(null AS string) AS lang, 1 AS doc_id")).first()
    assert nulls.root == nulls.subroot == "" and nulls.path == []


def brute_runs(w, min_words=24, times=3):
    n, out = len(w), {}
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            if i + p - s >= max(min_words, times * p):
                out.setdefault((s, i + p - s), p)
    return sorted((s, p, n) for (s, n), p in out.items())


def repetitive(rng):
    w = [rng.randrange(rng.choice([1, 2, 3, 40])) for _ in range(rng.randrange(130))]
    for _ in range(rng.randrange(3)):
        if w:
            p, s = rng.randrange(1, 15), rng.randrange(len(w))
            for i in range(s + p, min(len(w), s + p * rng.randrange(2, 9))):
                w[i] = w[i - p]
    return w


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(250):
        docs = [repetitive(rng) for _ in range(rng.randrange(1, 5))]
        offs = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
        words, times = rng.choice([(24, 3), (6, 3), (4, 2), (1, 2), (10, 4)])
        got = periodic.find_runs(np.array(sum(docs, []), np.int64), offs, words, times)
        for k, d in enumerate(docs):
            assert [(s, p, n) for t, s, n, p in got.tolist() if t == k] == brute_runs(d, words, times)


def test_extensions_equal_comparison():
    rng = random.Random(4)
    for size in (3, 60, 700):
        w = np.array([rng.randrange(2) for _ in range(size)] * 2 + [9])
        lce = periodic.LCE(w)
        i, j = np.array([(a, b) for a in range(0, len(w), 3) for b in range(len(w)) if a != b][:4000]).T
        want = [next(k for k in range(len(w)) if a + k >= len(w) or b + k >= len(w) or w[a + k] != w[b + k]) for a, b in zip(i, j)]
        assert lce(i, j).tolist() == want


def test_periodic_texts(spark):
    rng = random.Random(5)
    texts = [None, "", " \n", "x " * 23, "x " * 24, "X x " * 12, "\tä b\x0bc " * 400, "lone " + "p q r " * 9 + "p tail"]
    texts += [" ".join("uvw"[x] if x < 3 else f"w{x}" for x in repetitive(rng)) for _ in range(60)]
    texts += [" ".join(str(rng.randrange(900)) for _ in range(30000)) + " a b" * 50]
    docs = spark.createDataFrame([(i % 50, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, runs string").repartition(3)
    out = periodic.periodic_runs(docs).collect()
    assert len(out) == len(texts)
    for r in out:
        w = (r.text or "").split()
        runs = [(x.start, x.period, x.length) for x in r.runs]
        if len(w) < 5000:
            assert runs == brute_runs(w)
        else:
            assert runs == [(30000, 2, 100)]
        gone = {i for s, p, n in runs for i in range(s + p, s + n)}
        assert r.collapsed == " ".join(x for i, x in enumerate(w) if i not in gone)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_planted_texts(spark):
    import zlib
    rows = [(i, t) for i in range(60) for t in ("", " \n", "one", " a b  c d e\tf g h i j ")] + [(None, "a b"), (3, None)]
    out = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", planted("text", "doc_id").alias("t")).collect()
    some = 0
    for r in out:
        w = (r.text or "").split()
        h = zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
        if h % 10 == 0 and w:
            g, some = h // 10, some + 1
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        assert (r.t or "").split() == w
    assert some
