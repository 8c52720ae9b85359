"""Comparing the members of large groups block by block.

A group (bucket, family) may hold a large part of all rows, so no task gets a
whole one and not all its pairs are compared:

1. Its rows are dealt to blocks of about ``size``; every block is compared
   with itself and with the group's hub, one member chosen by hash. Rows that
   this joins to the hub, directly or through others of their block, are
   *settled*: they are all in one component.
2. Rows that are not settled are compared with every block of the group.
   Two settled rows need no comparison, so nothing is lost.

Groups of one block are done after the first step. The work of a group is
linear in its rows times the few that are not near the rest. Tasks compare
pairs as arrays, and return only spanning links, never pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import BitFilter, Groups, sorted_runs, staged

RUN = ["_key", "_i", "_j"]
# joins members of a run: (table slice, which side of the comparison, groups) -> None
Compare = Callable[[pa.Table, np.ndarray, Groups], None]
# for runs of two rows at once: which of the pairs (i, i + 1) pass
Pairs = Callable[[pa.Table, np.ndarray], np.ndarray]


def _task(compare: Compare, pairs: Pairs | None, first: bool):
    """Links (a, b) between ids of a run; in the first step also (a, key) of rows not settled."""
    def run(batches):
        for t, at in sorted_runs(batches, RUN):
            ids, side, key, many = (t[c].to_numpy() for c in ("id", "_side", "_key", "_many"))
            a, b, loose, of = [], [], [], []
            start, end = at[:-1], at[1:]
            if pairs:  # most groups are pairs: no loop for them
                two = (end - start == 2) & ~many[start]
                hit = start[two][pairs(t, start[two])]
                a.append(ids[hit + 1])
                b.append(ids[hit])
                start, end = start[~two], end[~two]
            for s, e in zip(start.tolist(), end.tolist()):
                g = Groups(e - s)
                compare(t.slice(s, e - s), side[s:e], g)
                label = g.labels()
                moved = np.flatnonzero(label != np.arange(e - s))
                a.append(ids[s:e][moved])
                b.append(ids[s:e][label[moved]])
                if first and many[s]:
                    hub = np.flatnonzero(side[s:e])
                    out = ~np.isin(label, label[hub])
                    loose.append(ids[s:e][out])
                    of.append(key[s:e][out])
            cat = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
            a, b, loose, of = cat(a), cat(b), cat(loose), cat(of)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([True, False], [len(a), len(loose)])), pa.array(np.concatenate([a, loose])), pa.array(np.concatenate([b, of]))],
                ["link", "a", "b"])
    return run


def group_links(rows: DataFrame, key: str, columns: list[str], compare: Compare, size: int = 2048,
                pairs: Pairs | None = None) -> DataFrame:
    """Spanning links (a, b) between the ``id``s of rows that share ``key``
    and that ``compare`` joins. ``columns`` are handed to ``compare``, which
    must join every pair of rows that passes its test and whose sides differ,
    or any pair when no side is 2 (1 marks the hub). ``pairs`` may decide runs
    of two rows all at once."""
    schema = "link boolean, a long, b long"
    rows = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), "id", *columns)
    counts = staged(rows.groupBy("_key").agg(F.count("*").alias("_n"), F.min_by("id", F.xxhash64("id")).alias("_hub"))
                    .where("_n > 1").select("_key", "_hub", F.ceil(F.col("_n") / size).alias("_m")), "group-sizes")
    rows = BitFilter(counts, "_key").keep(rows).join(counts, "_key")
    block = F.pmod(F.xxhash64("id", F.lit(3)), F.col("_m"))
    dealt = (rows.withColumn("_many", F.col("_m") > 1).withColumn("_own", block)
             # the hub joins every block, at side 1
             .withColumn("_i", F.explode(F.expr("IF(_many AND id = _hub, sequence(0L, _m - 1), array(_own))")))
             .withColumn("_side", F.expr("IF(_many AND id = _hub, 1, 0)")).withColumn("_j", F.col("_i")))
    cols = [*RUN, "id", "_side", "_many", *columns]
    # the hub may appear twice among equal rows; a run stays small
    one = staged(dealt.select(*cols).repartition(*RUN).sortWithinPartitions(*RUN, "id").mapInArrow(_task(compare, pairs, True), schema), "group-links")
    links = one.where("link").select("a", "b")
    loose = staged(one.where("NOT link").select(F.col("b").alias("_key"), F.col("a").alias("id")).distinct(), "group-loose")
    per = staged(loose.groupBy("_key").agg(F.ceil(F.count("*") / size).alias("_k")), "group-loose-sizes")
    if per.isEmpty():
        return links.distinct()
    whole = (rows.join(per, "_key").withColumn("_j", block)
             .withColumn("_i", F.explode(F.expr("sequence(0L, _k - 1)"))).withColumn("_side", F.lit(0)))
    left = (rows.join(loose, ["_key", "id"]).join(per, "_key").withColumn("_i", F.pmod(F.xxhash64("id", F.lit(5)), F.col("_k")))
            .withColumn("_j", F.explode(F.expr("sequence(0L, _m - 1)"))).withColumn("_side", F.lit(2)))
    two = whole.withColumn("_many", F.lit(True)).select(*cols).unionByName(left.withColumn("_many", F.lit(True)).select(*cols))
    two = two.repartition(*RUN).sortWithinPartitions(*RUN, "_side", "id").mapInArrow(_task(compare, pairs, False), schema)
    return links.unionByName(two.where("link").select("a", "b")).distinct()
