"""Connected components of a link table by alternating stars.

Each round rewires every link to the smallest known neighbour; the number of
rounds grows with the logarithm of the longest path. A round is two
aggregates (map-side combined, so a hub is no hot key) and two joins back on
the node, whose hot keys AQE splits because both sides are plain exchanges of
staged tables. Nothing is collected but one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import staged


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(e: DataFrame) -> DataFrame:
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    return (e.join(low, "a").select(F.explode(F.expr(
        "IF(b = m, array(struct(a, m AS b)), array(struct(a, m AS b), struct(b AS a, m AS b)))")).alias("e"))
        .select("e.a", "e.b"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``links``: pairs of long ids. Returns (node, component) with the
    smallest id of its component, for every id in a link between two
    different ids. Nulls and self-links are ignored; an empty table gives an
    empty one."""
    e = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    e, last = staged(e, "cc"), None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == last or not now[0]:
            break
        last = tuple(now)
        e = staged(_small(_large(e).where("a > b").distinct()).distinct(), "cc")
    return (e.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
