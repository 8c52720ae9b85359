"""The corpus pipeline, stage by stage, against the operators' definitions."""

import random
from collections import Counter

import corpus_pipeline as C
from pagemill.llm import mixing
from tests.conftest import SF_CHECK, SF_SMALL
from tests.llm.test_dedup import near, odd_rows, table


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    bench = [r.text.lower().split() for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    for name, stage in C.STAGES:
        out = stage(spark, docs, SF_SMALL).cache()
        before, after = docs.collect(), out.collect()
        if name != C.STAGES[-1][0]:
            assert out.columns == docs.columns
        kept, ids = {r.doc_id for r in after}, {r.doc_id for r in before}
        assert kept <= ids and len(kept) == len(after)
        if name == "language":
            assert len(kept) > 0.95 * len(ids)
        elif name == "lines":
            assert kept == ids
        elif name == "near_duplicates":
            assert kept == {d for (d, _, _, keep) in near([(r.doc_id, r.text, None) for r in before]) if keep}
        elif name == "decontamination":
            whole = {r.doc_id for r in before if any(" " + " ".join(b) + " " in " " + " ".join(r.text.lower().split()) + " " for b in bench)}
            assert whole and whole.isdisjoint(kept) and len(ids - kept) <= len(whole) + 2
        else:
            size, taken, target = Counter(), Counter(), {}
            for r in before:
                size[r.source] += len((r.text or "").encode().split())
            for r in after:
                taken[r.source] += r.taken
                target[r.source] = r.target
                assert r.taken in (r.size, 2 * r.size)
            want = dict(zip(sorted(size), mixing.targets([size[s] for s in sorted(size)], [(5, 2, 1)[i % 3] for i in range(len(size))], 1.5 * sum(size.values()), 2)))
            for s in want:
                assert abs(target.get(s, want[s]) - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 0.2 * want[s] + 50
        docs = out


def test_odd_rows_pass(spark):
    rng = random.Random(14)
    for rows in (odd_rows(rng) + [(None, "a null id", "s")], []):
        docs = table(spark, rows)
        for _, stage in C.STAGES[1:]:
            docs = stage(spark, docs, SF_SMALL)
        got = docs.collect()
        assert len([r for r in got if r.doc_id == 9]) <= 1


def test_language_stage(spark):
    rng = random.Random(20)
    consonants = " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=rng.randrange(3, 9))) for _ in range(80))
    junk = [consonants, "for (int i = 0; i < n; ++i) { if (a[i] != b[i]) { return false; } } static const char* name = NULL;" * 4,
            "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. " * 3,
            "a " * 1000, "\u042d\u0442\u043e \u043f\u0440\u0435\u0434\u043b\u043e\u0436\u0435\u043d\u0438\u0435 \u043d\u0430 \u0440\u0443\u0441\u0441\u043a\u043e\u043c. " * 5,
            "Ez a mondat magyar nyelven \u00edr\u00f3dott, hogy ellen\u0151rizz\u00fck a nyelv felismer\u00e9s\u00e9t. " * 5,
            "\u8fd9\u53e5\u8bdd\u662f\u7528\u4e2d\u6587\u5199\u7684\u3002" * 8, None, "", " \n", "12 34 +"]
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    texts = {}
    for r in docs.limit(600).collect():
        texts.setdefault(r.lang, []).append(r.text)
    both = ["\n".join(rng.choice(texts[k])[:600] for k in rng.sample(sorted(texts), 2)) for _ in range(40)]
    extra = [(10**9 + i, t, None, "x", 1) for i, t in enumerate(junk + both)] + [(None, both[0], "en", None, None)] * 2
    out = C.language(spark, docs.unionByName(spark.createDataFrame(extra, docs.schema)), SF_CHECK)
    assert out.columns == docs.columns
    kept = Counter(r.doc_id for r in out.collect())
    assert not any(kept[10**9 + i] for i in range(len(junk)))
    assert all(kept[10**9 + len(junk) + i] for i in range(len(both))) and kept[None] == 2
    assert sum(n for d, n in kept.items() if d is not None and d < 10**9) >= 0.995 * docs.where("text RLIKE '[a-zA-Z]'").count()
    assert C.language(spark, docs.limit(0), SF_CHECK).count() == 0
