"""Exact, line, near-duplicate and passage operators against brute force, with odd rows."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import exact_dedup, line_dedup, minhash, substring
from pagemill.llm.common import BitFilter, shuffles_freed, without
from pagemill.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# columns whose names the operators use inside
CLASH = {"_row": "a", "_id": "b", "_len": "c", "key": "d", "component": "e", "_text": "f", "_k": "g"}


def table(spark, rows, schema="doc_id long, text string, source string"):
    df = spark.createDataFrame(rows, schema)
    for c, v in CLASH.items():
        df = df.withColumn(c, F.lit(v))
    return df


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))


def odd_rows(rng):
    return [(1, None, None), (2, "", "s"), (3, " \t\n", "s"), (4, "One two", None), (5, "ONE TWO", "s"), (6, "É x", "s"),
            (7, "é x", "s"), (8, words(rng, 30_000), "s"), (9, "same text here", "t"), (9, "same text here", "t"), (10, "same text here", "t")]


def test_exact_groups(spark):
    rng = random.Random(1)
    rows = odd_rows(rng) + [(i, rng.choice(["aa", "Ab", "aB", "b" * 100 + "x", "b" * 100 + "y"]), "s") for i in range(20, 60)]
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[(t or "").translate(LOWER)].append(i)
    want = Counter((i, max(groups[(t or "").translate(LOWER)]), len(groups[(t or "").translate(LOWER)]),
                    i == max(groups[(t or "").translate(LOWER)])) for i, t, _ in rows)
    for whole in (True, False):
        got = exact_dedup.exact_duplicates(table(spark, rows), digest_all=whole).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == want
        for r in got:
            if whole or r.group_size > 1:
                assert r.text_sha256 in {hashlib.sha256(k.encode()).hexdigest() for k in groups}
    assert exact_dedup.exact_duplicates(table(spark, [])).count() == 0


def test_lines_by_site(spark):
    rng = random.Random(2)
    rows = odd_rows(rng)
    for i in range(100, 160):
        host = ["a", "b", None][i % 3]
        lines = [words(rng, 4) for _ in range(3)] + (["Menu  "] if i % 2 else []) + (["rare"] if i == 100 else []) + ["", "Menu"]
        rows.append((i, "\n".join(lines), host))
    total, seen = Counter(h for _, _, h in rows), Counter()
    strip = " \t\r\f\v"
    for _, t, h in rows:
        for line in {x.strip(strip) for x in (t or "").split("\n")} - {""}:
            seen[h, line] += 1
    gone = lambda h, x: x.strip(strip) and seen[h, x.strip(strip)] >= 3 and seen[h, x.strip(strip)] > 0.1 * total[h]
    got = line_dedup.drop_boilerplate(table(spark, rows))
    assert set(CLASH) < set(got.columns)
    want = Counter((i, None if t is None else "\n".join(x for x in t.split("\n") if not gone(h, x)),
                    0 if t is None else len(t.split("\n"))) for i, t, h in rows)
    assert Counter((r.doc_id, r.text, r.n_lines) for r in got.collect()) == want
    assert line_dedup.drop_boilerplate(table(spark, [])).count() == 0


def shingles(t):
    w = (t or "").translate(LOWER).encode().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def near(rows):
    sets, up = [shingles(t) for _, t, _ in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    low = {}
    for i, (d, _, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d)
    return Counter((d, len(s), low[root(i)], low[root(i)] == d) for i, ((d, _, _), s) in enumerate(zip(rows, sets)))


def test_near_duplicates(spark):
    rng = random.Random(3)
    rows = odd_rows(rng)
    for family in range(6):
        base = words(rng, 60).split()
        for k in range(12):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = words(rng, 1)
            rows.append((1000 + 50 * family + k, " ".join(w) + (" " + words(rng, 3) if k % 3 else ""), "s"))
    for block in (512, 5):  # 5 deals a family to several blocks
        got = minhash.near_duplicates(table(spark, rows), block=block).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == near(rows)
    assert minhash.near_duplicates(table(spark, [])).count() == 0
    null = minhash.near_duplicates(table(spark, [(None, "a b c d e f", "s"), (3, "a b c d e f", "s")])).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in null} == {(None, None, True), (3, 3, True)}


def test_signature_estimates():
    rng = np.random.default_rng(4)
    for share in (0.3, 0.6, 0.8, 0.95):
        est = []
        for _ in range(30):
            a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
            common = int(round(2 * share * 400 / (1 + share)))
            b = np.concatenate([a[:common], rng.integers(0, 1 << 63, 400 - common, dtype=np.uint64)])
            m = minhash.pack(minhash.minima([np.unique(a), np.unique(b)]))
            est.append(float(minhash.similarity(m[0], m[1])))
        assert abs(np.mean(est) - common / (800 - common)) < 0.04
    sets = [np.unique(rng.integers(0, 500, 120, dtype=np.uint64)) for _ in range(20)]
    a, b = np.triu_indices(20, 1)
    want = [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b)]
    assert minhash._Overlap(sets)(a, b).tolist() == want == minhash._Overlap(sets, max_bytes=0)(a, b).tolist()


def test_chain_is_optimal_without_gap_limit():
    rng = random.Random(5)
    for _ in range(40):
        n = rng.randrange(1, 25)
        p, q = (np.array([rng.randrange(60) for _ in range(n)]) for _ in range(2))
        best, path = substring.chain(p, q)[0]
        assert all(p[a] < p[b] and q[a] < q[b] for a, b in zip(path, path[1:]))
        assert best >= substring.K
        used = sorted(x for _, c in substring.chain(p, q) for x in c)
        assert used == list(range(n))


def test_chain_scores_equal_dynamic_programming():
    rng = random.Random(15)
    for _ in range(60):
        m = rng.randrange(1, 30)
        p, q = (np.array([rng.randrange(150) for _ in range(m)]) for _ in range(2))
        n = np.array([rng.randrange(6, 30) for _ in range(m)])
        worth = n - np.array([rng.random() for _ in range(m)])
        f = {}
        for i in sorted(range(m), key=lambda i: p[i]):  # every predecessor tried
            f[i] = worth[i] + max([0.0] + [f[j] - substring.GAP / 2 * (p[i] - (p[j] + n[j] - 5) + q[i] - (q[j] + n[j] - 5)) for j in f
                                           if p[j] + n[j] - 5 <= p[i] and q[j] + n[j] - 5 <= q[i]])
        assert abs(substring.chain(p, q, n, worth, drop=1e9)[0][0] - max(f.values())) < 1e-9


def test_stretches_join_matches_of_a_diagonal():
    pair, p, n = np.array([0, 0, 0, 0, 1]), np.array([3, 5, 30, 100, 91]), np.array([6, 6, 24, 6, 6])
    first, length, worth, sure = substring.stretches(pair, p, p - 2, n, np.array([False, True, False, False, False]))
    assert first.tolist() == [0, 3, 4] and length.tolist() == [51, 6, 6] and sure.tolist() == [True, False, False]
    assert np.allclose(worth, [32 - substring.GAP * 19, 6, 6])


def test_longest_stretch_equals_brute_force():
    rng = random.Random(18)
    for _ in range(80):
        same = np.array([rng.random() < rng.choice([0.3, 0.8, 0.95]) for _ in range(rng.randrange(1, 70))])
        i, j = substring._longest(same, 0.8)
        ok = [(b - a, -a) for a in range(len(same)) for b in range(a + 1, len(same) + 1) if same[a:b].mean() >= 0.8 - 1e-12]
        if not ok:
            assert i == j
            continue
        most, a = max(ok)
        a = -a
        assert a <= i <= j <= a + most and (i == j or (same[i] and same[j - 1]))


def test_passages(spark):
    rng = random.Random(6)
    passage, fuzzy = words(rng, 70), words(rng, 90).split()
    rows = odd_rows(rng) + [(i, words(rng, 80), "s") for i in range(100, 130)]
    for i in (200, 201, 202, 203):
        rows.append((i, words(rng, 40) + "\n" + passage.upper() + " " + words(rng, 30), "s"))
    for i in (300, 301):
        w = list(fuzzy)
        w[20 + i % 2] = "changed"
        del w[60 + i % 2]
        rows.append((i, words(rng, 25) + " " + " ".join(w), "s"))
    rows += [(400, words(rng, 200), "s")]
    rows += [(i, rows[-1][1], "s") for i in (401, 402)]
    out = substring.repeated_passages(table(spark, rows)).collect()
    text = {d: t.translate(LOWER).encode().split() for d, t, _ in rows if t}
    for r in out:
        a = text[r.doc_id][r.start:r.start + r.n_words]
        b = text[r.other_id][r.other_start:r.other_start + r.other_n_words]
        assert min(len(a), len(b)) >= 50 and r.equal_words >= 0.8 * 50 and set(a) & set(b)
    assert {d for r in out for d in (r.doc_id, r.other_id)} == {200, 201, 202, 203, 300, 301, 400, 401, 402}
    for r in out:
        if {r.doc_id, r.other_id} <= {200, 201, 202, 203}:
            assert (r.start, r.n_words, r.other_start) == (40, 70, 40)
    assert substring.repeated_passages(table(spark, [])).count() == 0


def test_passages_of_stock_sentences(spark):
    rng = random.Random(16)
    rows, want = [], set()
    for g in range(8):
        sentences = [words(rng, 30), words(rng, 30)] if g % 2 else [words(rng, 20) for _ in range(3)]
        for i in (0, 1):
            want.add(1000 * g + i)
            rows.append((1000 * g + i, f"{words(rng, 20)} {' '.join(sentences)} {words(rng, 20)}", "s"))
        rows += [(1000 * g + 100 + i, f"{words(rng, 20)} {sentences[i % len(sentences)]} {words(rng, 20)}", "s") for i in range(90)]
    out = substring.repeated_passages(table(spark, rows)).collect()
    assert {d for r in out for d in (r.doc_id, r.other_id)} == want
    assert all((r.start, r.n_words) == (20, 60) for r in out)


def test_passages_held_several_times(spark):
    rng = random.Random(17)
    passage, phrase = words(rng, 60), words(rng, 300)
    parts = passage.split()
    early = " ".join(f"{words(rng, 3)} {' '.join(parts[i:i + 8])}" for i in range(0, 56, 4))  # phrases of the passage, ahead of it
    rows = [(1, f"{passage} {words(rng, 200)} {passage} {words(rng, 200)} {passage} {words(rng, 9)}", "s"),
            (2, f"{words(rng, 30)} {passage} {words(rng, 30)}", "s"), (3, f"{early} {words(rng, 100)} {passage} {words(rng, 5)}", "s"),
            (4, phrase, "s")]
    out = substring.repeated_passages(table(spark, rows)).collect()
    spans = {(r.doc_id, r.start, r.n_words) for r in out} | {(r.other_id, r.other_start, r.other_n_words) for r in out}
    lead = len(early.split()) + 100
    assert {(1, 0, 60), (1, 260, 60), (1, 520, 60), (2, 30, 60), (3, lead, 60)} <= spans
    assert {d for d, _, _ in spans} == {1, 2, 3} and len(out) == len(set(out))


def test_bit_filter_keeps_members(spark):
    members = spark.range(0, 500, 7).withColumnRenamed("id", "_key")
    rows = spark.range(2000).withColumnRenamed("id", "_key").withColumn("_word", F.lit(1)).withColumnRenamed("_word", "w")
    f = BitFilter(members, "_key", bits=1 << 12)
    kept = {r["_key"] for r in f.keep(rows).collect()}
    assert kept >= set(range(0, 500, 7)) and len(kept) < 600
    maybe, clear = f.split(rows)
    assert {r["_key"] for r in maybe.collect()} == kept and clear.count() == 2000 - len(kept)
    assert {r["_key"] for r in without(rows, members).collect()} == set(range(2000)) - set(range(0, 500, 7))


@pytest.mark.parametrize("n_words, equal", [(55, 0.95), (55, 0.85), (80, 0.9), (80, 0.82), (120, 0.85), (200, 0.82)])
def test_changed_passages_are_found(spark, n_words, equal):
    """Words changed at random places, other text around: at least nine of ten are found, and no pair that shares nothing."""
    rng = np.random.default_rng(n_words)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    rows, pairs = [], 40
    for i in range(pairs):
        passage = fresh(n_words)
        copy = list(passage)
        for at in rng.choice(n_words, round(n_words * (1 - equal)), replace=False):
            copy[at] = fresh(1)[0]
        rows += [(2 * i, " ".join(fresh(90) + passage + fresh(60))), (2 * i + 1, " ".join(fresh(40) + copy + fresh(150)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {tuple(sorted((r.doc_id, r.other_id))) for r in substring.repeated_passages(df).collect()}
    assert all(a % 2 == 0 and b == a + 1 for a, b in found)
    assert len(found) >= 0.9 * pairs, len(found)


@pytest.mark.parametrize("others", [0, 40])
def test_passages_of_short_equal_runs(spark, others):
    """Every fifth word changed, so no run is longer than four words; each run is held by ``others`` documents, too."""
    rng, rows, want = random.Random(19), [], set()
    fresh = lambda n: [f"w{rng.getrandbits(40)}" for _ in range(n)]
    for g in range(6):
        runs = [fresh(4) for _ in range(14)]
        want.add((1000 * g, 1000 * g + 1))
        for i in (0, 1):
            rows.append((1000 * g + i, " ".join(fresh(20 + 9 * i) + [w for run in runs for w in run + fresh(1)] + fresh(30)), "s"))
        rows += [(1000 * g + 100 + i, " ".join(w for run in rng.sample(runs, 14) for w in fresh(7) + run), "s") for i in range(others)]
    out = substring.repeated_passages(table(spark, rows)).collect()
    assert {tuple(sorted((r.doc_id, r.other_id))) for r in out} == want
    assert all(r.equal_words >= 0.8 * r.n_words for r in out)


def test_stock_text_links_all_changed_copies(spark):
    """Sixty texts, each with words of its own replaced, among documents that hold parts of them: all in one component."""
    rng = random.Random(20)
    passage, rows = words(rng, 70).split(), []
    for i in range(60):
        w = list(passage)
        for at in rng.sample(range(70), 3):
            w[at] = f"x{i}y{at}"
        rows.append((i, f"{words(rng, 20 + i)} {' '.join(w)} {words(rng, 30)}", "s"))
    rows += [(100 + i, f"{words(rng, 30)} {' '.join(passage[i % 30:i % 30 + 35])} {words(rng, 30)}", "s") for i in range(120)]
    out = substring.repeated_passages(table(spark, rows)).collect()
    up = list(range(300))
    for r in out:
        assert max(r.doc_id, r.other_id) < 60
        a, b = up[r.doc_id], up[r.other_id]
        up = [a if v == b else v for v in up]
    assert len({up[i] for i in range(60)}) == 1


def test_passages_of_one_repeated_word(spark):
    """A word repeated sixty times in many texts: each text is linked, without a row for every shift of every pair."""
    rng = random.Random(21)
    rows = [(i, f"{words(rng, 30)} {'the ' * (60 + i)} {words(rng, 30)} {'no yes ' * 40 if i % 2 else ''}", "s") for i in range(40)]
    rows += [(100, f"{words(rng, 9)} {'the ' * 30} {words(rng, 9)}", "s"), (101, f"{words(rng, 9)} {'the ' * 35}", "s")]
    out = substring.repeated_passages(table(spark, rows)).collect()
    the = [r for r in out if r.equal_words >= 60 and r.start == r.other_start == 30]
    assert {r.doc_id for r in out} | {r.other_id for r in out} == set(range(40))
    assert {r.doc_id for r in the} | {r.other_id for r in the} == set(range(40))
    up = list(range(40))
    for r in the:
        a, b = up[r.doc_id], up[r.other_id]
        up = [a if v == b else v for v in up]
    assert len(set(up)) == 1 and len(out) < 150, len(out)


def test_passages_of_repeated_phrases(spark):
    """Phrases of one to four words repeated, begun at any of their words; the longest holds the copies of others side by side."""
    rng, rows = random.Random(22), []
    for q in range(1, 5):
        phrase = [f"p{q}{x}" for x in "abcd"[:q]]
        for i in range(9):
            n = 64 + 3 * i if i < 8 else 230
            run = " ".join(phrase[(i + k) % q] for k in range(n))
            rows.append((100 * q + i, f"{words(rng, 7 * i)} {run} {words(rng, 9 if i % 2 else 0)}", "s"))
    out = substring.repeated_passages(table(spark, rows)).collect()
    assert all(r.doc_id // 100 == r.other_id // 100 and r.equal_words >= 50 for r in out)
    texts = {i: t.split() for i, t, _ in rows}
    for r in out:
        a, b = texts[r.doc_id][r.start:r.start + r.n_words], texts[r.other_id][r.other_start:r.other_start + r.other_n_words]
        assert r.n_words != r.other_n_words or sum(x == y for x, y in zip(a, b)) >= 0.8 * r.n_words
    for q in range(1, 5):
        up = list(range(9))
        for r in out:
            if r.doc_id // 100 == q:
                a, b = up[r.doc_id % 100], up[r.other_id % 100]
                up = [a if v == b else v for v in up]
        assert len(set(up)) == 1
        held = {w for r in out for i, s, n in ((r.doc_id, r.start, r.n_words), (r.other_id, r.other_start, r.other_n_words))
                if i == 100 * q + 8 for w in range(s, s + n)}
        assert len(held & set(range(56, 56 + 230))) >= 225, (q, len(held))


def test_stock_copies_link_without_all_pairs(spark):
    """120 texts with the same 50 words, and 120 near copies of one text: each group is connected, by few rows."""
    rng = random.Random(23)
    passage, text, rows = words(rng, 50), words(rng, 150).split(), []
    for i in range(120):
        copy = list(text)
        for at in rng.sample(range(150), 8):
            copy[at] = f"x{i}y{at}"
        rows += [(i, f"{words(rng, 30 + i % 7)} {passage} {words(rng, 30)}", "s"), (200 + i, " ".join(copy), "s")]
    out = substring.repeated_passages(table(spark, rows)).collect()
    up = list(range(400))
    for r in out:
        assert (r.doc_id < 200) == (r.other_id < 200) and r.n_words >= 50 and r.equal_words >= 0.8 * r.n_words
        a, b = up[r.doc_id], up[r.other_id]
        up = [a if v == b else v for v in up]
    assert len({up[i] for i in range(120)}) == len({up[200 + i] for i in range(120)}) == 1
    assert sum(r.doc_id < 200 for r in out) < 240 and len(out) < 5000, len(out)  # of 7,140 pairs in each


def test_compared_words_equal_brute_force():
    """Counts of equal words, word by word or pair by pair, leave out words beyond both texts; sure pairs have a passage."""
    rng = np.random.default_rng(24)
    kinds = rng.integers(0, 3, (60, 1))
    plain = np.where(rng.random((60, 99)) < 0.8, (np.arange(99) % 7 + 1 + 10 * kinds).astype(np.uint8), rng.integers(1, 255, (60, 99)).astype(np.uint8))
    for row, lead, trail in zip(plain, rng.integers(0, 50, 60), rng.integers(0, 50, 60)):
        row[:lead], row[99 - trail:] = 0, 0
    o = np.zeros((60, 104), np.uint8)
    o[:, :99] = plain
    outside = substring._beyond(o)
    x, y = (v.ravel() for v in np.meshgrid(np.arange(60), np.arange(60), indexing="ij"))
    equal = (plain[x] == plain[y]) & (plain[x] > 0)
    dense = np.concatenate([e for _, e in substring._enough(o, outside, np.arange(60), np.arange(60), 34, tile=16)])
    assert (dense.ravel() == (equal.sum(1) >= 34)).all()
    near, sure = substring._alike(o, outside, np.zeros(len(x), bool), x, y, 34, 50, 0.8, size=100)
    assert (near == [max(e[i:i + 50].sum() for i in range(50)) >= 34 for e in equal]).all()
    assert 0 < sure.sum() < near.sum()
    for e in equal[sure]:
        i, j = substring._longest(e, 0.8)
        assert j - i >= 50 and e[i:j].sum() >= 0.8 * (j - i)


def test_telling_shifts_keep_all_equal_words():
    rng = np.random.default_rng(25)
    o = rng.integers(1, 3, (300, 8)).astype(np.uint8)
    x, y = np.arange(290) // 29, np.arange(10, 300)
    same = o[x] == o[y]
    for rounds in (1, 9):
        kept = set(substring._telling_shifts(o, x, y, (x, y % 2), rounds=rounds, size=7).tolist())
        assert len(kept) < 290
        for i in set(range(290)) - kept:
            assert any(x[j] == x[i] and y[j] % 2 == y[i] % 2 and (same[j] | ~same[i]).all() for j in kept)


def test_least_matched_words_of_all_stretches():
    """Every pattern of 50 to 99 columns, four in five equal, has LONE matched words in runs of SEED on, of which
    no more than SEED + AHEAD words count; one has no more."""
    most = substring.SEED + substring.AHEAD
    count = lambda run: min(run, most) if run >= substring.SEED else 0
    least = []
    for n in range(50, 100):
        states = {(0, 0): 0}  # (run, unequal columns): least words counted before the run
        for _ in range(n):
            later = {}
            for (run, bad), words_ in states.items():
                for state, v in (((min(run + 1, most), bad), words_), ((0, bad + 1), words_ + count(run))):
                    if state[1] <= n // 5:
                        later[state] = min(v, later.get(state, 1000))
            states = later
        least.append(min(v + count(run) for (run, _), v in states.items()))
    assert min(least) == substring.LONE


def test_least_matched_words():
    """Every pattern of 50 to 99 columns, four in five equal, has SURE matched words in some stretch; one has no more."""
    join = int(substring.SEED / substring.GAP)  # words between matches of one stretch

    def held(n, most):
        # (equal columns up to here, matched words of the stretch, columns since): least unequal columns
        states = {(0, 0, join + 1): 0}
        for _ in range(n):
            later = {}
            for (run, cover, since), bad in states.items():
                steps = [((0, cover, min(join + 4, since + 1)), bad + 1)]
                if run < 3:
                    steps.append(((run + 1, cover, min(join + 4, since + 1)), bad))
                else:
                    steps.append(((4, cover + 1 if run == 4 else 4 + cover * (since - 3 <= join), 0), bad))
                for state, b in steps:
                    if b <= n // 5 and state[1] <= most and later.get(state, n) > b:
                        later[state] = b
            states = later
        return bool(states)

    assert not any(held(n, substring.SURE - 1) for n in range(50, 100))
    assert any(held(n, substring.SURE) for n in range(50, 60))


def test_columns_side_by_side_equal_one_by_one():
    """The longest dense stretches of many arrays at once are those of each."""
    rng = np.random.default_rng(26)
    for _ in range(20):
        parts = [rng.random(n) < rng.choice([0.1, 0.5, 0.8, 0.9, 1.0], p=[0.2, 0.2, 0.2, 0.2, 0.2]) for n in rng.integers(1, 200, 30)]
        offs = np.cumsum([0] + [len(x) for x in parts])
        i, j = substring._longest_of_each(np.concatenate(parts), offs[:-1], offs[1:], 0.8)
        assert [(a - o, b - o) for a, b, o in zip(i, j, offs)] == [substring._longest(x, 0.8) for x in parts]
        for x, s, e, equal in substring._dense(parts, 50, 0.8):
            assert e - s >= 50 and equal == parts[x][s:e].sum() >= 0.8 * (e - s)


def test_passage_query_lists_every_pair(spark, tmp_path):
    """Holders of stock text, its near copies and a word repeated sixty times are listed pair by pair, not only connected."""
    rng = random.Random(27)
    passage, rows, texts = words(rng, 60).split(), [], {}
    for i in range(40):
        w = list(passage)
        for at in rng.sample(range(60), 2):
            w[at] = f"x{i}y{at}"
        texts[i] = f"{words(rng, 20 + i)} {' '.join(w if i % 2 else passage)} {words(rng, 30)}"
        texts[100 + i] = f"{words(rng, 10)} {'the ' * (60 + i % 9)}{words(rng, 30)}"
        texts[200 + i] = f"{words(rng, 30)} {' '.join(passage[i % 20:i % 20 + 35])} {words(rng, 30)}"
    rows = [(i, t, "s") for i, t in texts.items()]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op8_passages"](spark, str(tmp_path)).collect()
    pairs = {tuple(sorted((r.doc_id, r.other_id))) for r in out}
    assert pairs == {(a + g, b + g) for g in (0, 100) for a in range(40) for b in range(a + 1, 40)}
    assert len(out) == len(set(out))


def test_end_of_repeated_words(spark):
    """A word repeated fifty times beside one repeated a hundred times: a word behind the end, equal by its byte, makes no longer run."""
    rng = random.Random(28)
    byte = lambda w: int(substring._bytes(substring.tokenize(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0])[0])
    like = next(w for w in (f"w{x}" for x in range(10_000)) if byte(w) == byte("the"))
    rows = [(1, f"{words(rng, 20)} {'the ' * 50}{like} {words(rng, 20)}", "s"), (2, f"{words(rng, 30)} {'the ' * 100}{words(rng, 20)}", "s")]
    for every_pair in (True, False):
        out = substring.repeated_passages(table(spark, rows), every_pair=every_pair).collect()
        assert {(r.doc_id, r.other_id) for r in out} <= {(1, 2), (2, 1)} and out


def test_passages_leave_no_shuffle_files(spark):
    """Shuffle files of a step go when it ends; the session's setting is as before."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with shuffles_freed(spark.range(1)):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name) == before
