"""Mixing sources to target weights as a min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold
them). A small network routes token capacity from patterns to source quotas:
the first pass over a pattern is free, each repetition costs more than the one
before (convex), so nothing is repeated while fresh text is left that can fill
a quota. The flow of a pattern then becomes whole passes over all its
documents plus a seeded selection that fills the rest.

The network (patterns x sources) and the ends of each selection are all that
reaches the driver, bounded by ``max_patterns``. The selection goes in rounds
over a seeded order. A round passes over documents that are too large for it
and takes the rest until one would overrun the quota. Behind that one, the
largest document that fits is taken if it fills half of what is still open;
otherwise another round follows. Open tokens halve each time, so there are few
rounds; in the end no document fits. One document alone, or the first round with the
document closest to its rest, stands instead where that comes nearer. An end is found without sorting a
pattern: token sums by the first four hex digits of the hash (65,536 buckets a
pattern at most) locate the bucket, and only that bucket is ordered. Rows equal
in all columns are counted, not ordered: a third of all rows may be copies.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.common import WORD, packed, staged, unpacked


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``cap`` times its size; the
    excess is shared again by weight until none is above."""
    out, free, rest = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while free:
        unit = rest / sum(weights[i] for i in free)
        full = [i for i in sorted(free) if weights[i] * unit > cap * sizes[i]]
        if not full:
            for i in free:
                out[i] = weights[i] * unit
            break
        for i in full:
            out[i] = float(cap * sizes[i])
            rest -= out[i]
            free.discard(i)
    return out


def min_cost_flow(capacity: dict, members: dict, quota: dict, max_passes: int, costs) -> dict:
    """Tokens routed per pattern, by successive shortest paths.

    ``capacity``: tokens of one pass over each pattern; ``members``: sources
    of a pattern; ``quota``: tokens wanted by a source; pass i costs
    ``costs(i)`` a token, increasing. Maximises routed tokens, then minimises
    cost.
    """
    # nodes: "S", ("p", pattern), ("s", source), "T"
    arcs: list[list] = []  # to, residual, cost; the arc's partner is at index ^ 1
    out: dict = {}

    def arc(a, b, cap, cost):
        for x, y, r, c in ((a, b, cap, cost), (b, a, 0, -cost)):
            out.setdefault(x, []).append(len(arcs))
            arcs.append([y, r, c])

    for p in sorted(capacity):
        for i in range(max_passes):
            arc("S", ("p", p), capacity[p], costs(i))
        for s in members[p]:
            arc(("p", p), ("s", s), max_passes * capacity[p], 0)
    for s in sorted(quota, key=str):
        arc(("s", s), "T", quota[s], 0)
    height = dict.fromkeys([*out, "S", "T"], 0)
    while True:
        # Dijkstra over reduced costs
        dist, via, heap, n = {"S": 0}, {}, [(0, 0, "S")], 0
        while heap:
            d, _, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for k in out.get(u, ()):
                v, r, c = arcs[k]
                if r and (e := d + c + height[u] - height[v]) < dist.get(v, float("inf")):
                    dist[v], via[v], n = e, k, n + 1
                    heapq.heappush(heap, (e, n, v))
        if "T" not in dist:
            break
        far = max(dist.values())
        for v in height:
            height[v] += dist.get(v, far)
        v, path = "T", []
        while v != "S":
            path.append(via[v])
            v = arcs[via[v] ^ 1][0]
        push = min(arcs[k][1] for k in path)
        for k in path:
            arcs[k][1] -= push
            arcs[k ^ 1][1] += push
    return {p: sum(arcs[k ^ 1][1] for k in out[("p", p)] if k % 2 == 0 and arcs[k][0][0] == "s") for p in capacity}


def _selection(units: DataFrame, rest: dict) -> tuple[list, list]:
    """Which units (``_pattern``, ``_hash``, ``_size``, ``_n`` equal rows) fill
    ``rest`` tokens of each pattern: rounds (pattern, low, high, limit), which
    take all units between low and high, both exclusive, of at most ``limit``
    tokens, and single units (pattern, hash, rows taken)."""
    spark = units.sparkSession
    upto = Window.partitionBy("_pattern").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = Window.partitionBy("_pattern").orderBy("_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    now = {p: ("", r) for p, r in rest.items() if r}  # last hash, open tokens
    rounds, single, open_ = [], {}, {}

    def picked():
        return F.broadcast(spark.createDataFrame([(*k, n) for k, n in single.items()], "_pattern string, _hash string, _some long"))

    def closest(left: dict) -> dict:
        """(distance, hash) of the document not taken that is closest to what is open."""
        gap = "abs(_size - _open)"
        close = (units.join(F.broadcast(spark.createDataFrame(list(left.items()), "_pattern string, _open long")), "_pattern")
                 .where(f"{gap} < _open").join(F.broadcast(_by_pattern(spark, rounds)), "_pattern", "left")
                 .join(picked(), ["_pattern", "_hash"], "left").where(f"NOT {_TAKEN} AND coalesce(_some, 0) < _n")
                 .groupBy("_pattern").agg(F.min(F.expr(f"struct({gap} AS gap, _hash)")).alias("best")))
        return {r["_pattern"]: (r.best.gap, r.best["_hash"]) for r in close.collect()} if left else {}

    early = {p: (left, None) for p, (_, left) in now.items()}
    early |= closest({p: left for p, (_, left) in now.items()})
    start, ends_at = None, dict.fromkeys(early, 0)
    while now:
        # at most max_patterns rows
        state = F.broadcast(spark.createDataFrame([(p, *v) for p, v in now.items()], "_pattern string, _low string, _rest long"))
        fit = (units.join(state, "_pattern").where("_hash > _low AND _size <= _rest").join(picked(), ["_pattern", "_hash"], "left")
               .withColumn("_n", F.expr("_n - coalesce(_some, 0)")).where("_n > 0").withColumn("_bucket", F.substring("_hash", 1, 4)))
        sums = (fit.groupBy("_pattern", "_bucket", "_rest").agg(F.sum(F.expr("_size * _n")).alias("_sum"), F.min(F.expr("struct(-_size AS s, _hash)")).alias("_big"))
                .withColumn("_upto", F.sum("_sum").over(upto)).groupBy("_pattern").agg(
                    F.max("_upto").alias("total"), F.min("_big").alias("big"),
                    F.min(F.expr("IF(_upto > _rest, struct(_bucket, _upto - _sum AS before), NULL)")).alias("cut")))
        sums = {r["_pattern"]: r for r in sums.collect()}
        fills = {p: r.big for p, r in sums.items() if now[p][0] and -2 * r.big.s >= now[p][1]}
        cut = [(p, r.cut["_bucket"], r.cut["before"]) for p, r in sums.items() if r.cut and p not in fills]
        ends = {}
        if cut:
            run = (fit.join(F.broadcast(spark.createDataFrame(cut, "_pattern string, _bucket string, _before long")), ["_pattern", "_bucket"])
                   .withColumn("_run", F.col("_before") + F.sum(F.expr("_size * _n")).over(inner)).where("_run > _rest"))
            ends = {r["_pattern"]: r.end for r in run.groupBy("_pattern").agg(
                F.min(F.struct("_hash", "_size", F.expr("_run - _size * _n AS before"))).alias("end")).collect()}
        after = {}
        for p, (low, left) in now.items():
            if p not in sums:  # nothing fits any more
                open_[p] = left
                continue
            high = low
            if p in fills:
                one, got = fills[p]["_hash"], -fills[p].s
                single[p, one] = single.get((p, one), 0) + 1
            else:
                high, got = "~", sums[p].total  # behind every hash
                if p in ends:
                    high, size, before = ends[p]
                    copies = (left - before) // size
                    got = before + copies * size
                    if copies:
                        single[p, high] = single.get((p, high), 0) + copies
                rounds.append((p, low, high, left))
            if left > got:
                after[p] = high, left - got
        now = after
        if start is None:
            start = list(rounds), dict(single)
            once = {p: (left, None) for p, (_, left) in after.items()}
            once |= closest({p: left for p, (left, _) in once.items()})
            for p in once:
                if once[p][0] < early[p][0]:
                    early[p], ends_at[p] = once[p], 1
    start = start or ([], {})  # no quota at all
    last = closest(open_)
    for p, left in open_.items():
        last.setdefault(p, (left, None))
    # the end, or the first round's with its closest document, whichever is nearer
    sooner = {p for p in early if early[p][0] <= last.get(p, (0,))[0]}
    rounds = [r for r in rounds if r[0] not in sooner] + [r for r in start[0] if r[0] in sooner and ends_at[r[0]]]
    single = {k: n for k, n in single.items() if k[0] not in sooner} | {k: n for k, n in start[1].items() if k[0] in sooner and ends_at[k[0]]}
    for p, (_, one) in (last | {p: early[p] for p in sooner}).items():
        if one is not None:
            single[p, one] = single.get((p, one), 0) + 1
    return rounds, [(*k, n) for k, n in single.items()]


def _by_pattern(spark: SparkSession, rounds: list) -> DataFrame:
    """One row per pattern with its rounds: not more of them, nor of single
    units, than its quota has binary digits, plus two."""
    return (spark.createDataFrame(rounds, "_pattern string, low string, high string, lim long")
            .groupBy("_pattern").agg(F.collect_list(F.struct("low", "high", "lim")).alias("_rounds")))


_TAKEN = "coalesce(exists(_rounds, r -> _hash > r.low AND _hash < r.high AND _size <= r.lim), false)"


def _last_copies(rows: DataFrame, single: list) -> DataFrame:
    """(pattern, hash, ``_last``): of the rows of a unit of which only some are
    taken, those with ``_copy`` up to ``_last``. Copies are counted by the
    partition that numbered them; only one partition's are ordered, a unit."""
    some = F.broadcast(rows.sparkSession.createDataFrame(single, "_pattern string, _hash string, _some long"))
    key = ["_pattern", "_hash"]
    part = F.shiftright("_copy", 33).alias("_part")
    rows = rows.join(some, key).select(*key, "_some", "_copy", part)
    upto = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (rows.groupBy(*key, "_some", "_part").agg(F.count("*").alias("_c")).withColumn("_upto", F.sum("_c").over(upto))
           .where("_upto >= _some AND _upto - _c < _some").select(*key, "_part", F.expr("_some - _upto + _c AS _nth")))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("_copy"))
    return (rows.drop("_some").join(F.broadcast(staged(cut, "mix-copies")), [*key, "_part"]).withColumn("_rank", rank)
            .where("_rank = _nth").select(*key, F.col("_copy").alias("_last")))


def mix(docs: DataFrame, id_col: str = "doc_id", size_name: str = "size", sources_col: str = "sources",
        weights: tuple = (5, 2, 1), total_ratio: float = 1.5, max_passes: int = 2, seed: int = 17,
        max_patterns: int = 100_000) -> DataFrame:
    """Adds ``taken`` (tokens the mix takes from the row, repeats counted: the
    size times the passes), ``source_size`` and ``target`` (of the row's first
    source in code point order, null last) to ``docs``.

    ``size_name`` is a non-negative count, ``sources_col`` an array of sources
    (null elements are a source of their own; an empty or null array cannot be
    drawn and takes nothing). Weights repeat over the sources in code point
    order; the sources share ``total_ratio`` of all sizes, none more than
    ``max_passes`` times its size. What a pattern takes differs from its flow
    by less than the smallest document left over. Rows that repeat an id, or
    have none, are ordered by their other columns (maps aside); of rows equal
    in all columns it is open which are taken, not how many. Sizes of 0 and
    null sizes take 0. An empty table stays empty.
    """
    spark: SparkSession = docs.sparkSession
    d = packed(docs, "source_size", "target", "taken")
    row, size_col = F.col("_row"), "_size"
    told = [row.getField(f.name) for f in d.schema["_row"].dataType if not any(t in f.dataType.simpleString() for t in ("map<", "variant", "interval"))]
    # the seeded order: the id decides, other columns tell rows of one id apart
    order_by = F.concat(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(row.getField(id_col).cast("string"), F.lit("")))),
                        F.lpad(F.lower(F.hex(F.xxhash64(*told))), 16, "0"))
    d = d.select("_row", F.coalesce(row.getField(size_name), F.lit(0)).cast("long").alias(size_col), F.sort_array(F.array_distinct(F.coalesce(
        row.getField(sources_col), F.array().cast("array<string>"))), asc=False).alias("_sources"),
        order_by.alias("_hash"), F.monotonically_increasing_id().alias("_copy"))
    # written: a row keeps its number whatever is computed again
    d = staged(d.withColumn("_pattern", F.to_json("_sources")), "mix-rows")
    per = (d.groupBy("_pattern").agg(F.sum(size_col).alias("n"), F.first("_sources").alias("src"))
           .limit(max_patterns + 1).collect())
    if len(per) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    members = {r["_pattern"]: list(dict.fromkeys(r.src or [])) for r in per}
    sizes: dict = {}
    for r in per:
        for s in members[r["_pattern"]]:
            sizes[s] = sizes.get(s, 0) + (r.n or 0)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    total = total_ratio * sum(r.n or 0 for r in per if members[r["_pattern"]])
    want = targets([sizes[s] for s in order], [weights[i % len(weights)] for i in range(len(order))], total, max_passes)
    want = dict(zip(order, want))
    flow = min_cost_flow({r["_pattern"]: r.n or 0 for r in per if members[r["_pattern"]]}, members,
                         {s: round(t) for s, t in want.items()}, max_passes, lambda i: i * i)
    plan, open_ = [], {}
    for r in per:
        p, n = r["_pattern"], r.n or 0
        first = min(members[p], key=lambda s: (s is None, s or ""), default=None)
        passes, rest = divmod(flow.get(p, 0), n) if n else (0, 0)
        open_[p] = int(rest)
        plan.append((p, int(passes), int(rest), int(sizes.get(first, 0)), float(want.get(first, 0.0))))
    # one row per pattern: at most max_patterns rows
    plan = F.broadcast(spark.createDataFrame(plan, "_pattern string, _passes long, _rest long, source_size long, target double"))
    d = d.join(plan, "_pattern", "left")
    units = staged(d.where(f"_rest > 0 AND {size_col} > 0").groupBy("_pattern", "_hash", size_col).agg(F.count("*").alias("_n")), "mix-units")
    rounds, single = _selection(units, open_)
    last = staged(_last_copies(d, single), "mix-last")
    d = d.join(F.broadcast(_by_pattern(spark, rounds)), "_pattern", "left").join(F.broadcast(last), ["_pattern", "_hash"], "left")
    picked = F.expr(f"{_TAKEN} OR coalesce(_copy <= _last, false)")
    return (d.withColumn("taken", F.col(size_col) * (F.coalesce("_passes", F.lit(0)) + picked.cast("long")))
            .transform(lambda x: unpacked(x, "source_size", "target", "taken")))
