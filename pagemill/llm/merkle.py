"""Merkle manifest of a dataset, built by slot pivots.

Every row has a leaf digest. The rows of a group, in a total order, are the
leaves of a tree; every ``fanout`` consecutive nodes (the last run may be
shorter, even one node) become one parent, until one node is left: the group's
subroot. The subroots, ordered by group, are the leaves of a last tree, whose
top is the root.

A level is one aggregate: conditional aggregates spread the children of each
parent into ``fanout`` slot columns. Concatenating the columns and hashing
gives the parent; the columns before and after a child's own slot are its
siblings. Going down again, each child takes the path of its parent and puts
its own siblings in front. Several levels share one shuffle, by blocks of
consecutive leaves, and each block's table is ``BLOCK`` times smaller than the
one below; texts are read once, by the leaf digest.

Ranks come from a range partitioning: a row's rank is its place in its sorted
partition plus the rows of its group in the partitions before (a table of one
row per partition and group), so no task sorts a whole group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import staged

BLOCK = 16  # leaves of the levels that one stage builds
_PLACE = (1 << 33) - 1  # monotonically_increasing_id: partition << 33 | place


def digest(*values: Column) -> Column:
    """Lower-case hex SHA-256 of the values, concatenated."""
    return F.sha2(F.concat(*values), 256)


def leaf_digest(*fields: Column) -> Column:
    """Digest of a row: each field is ``-`` if null, else its length in UTF-8
    bytes, ``:`` and its text, so no two rows give the same input."""
    text = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (_g, _o, _h, _row) with the rank ``_pos`` in group ``_g`` by
    (_o, _h) and the group's size ``_n``. Rows equal in all three are
    interchangeable; ``_tie`` lets a large set of them be split."""
    rows = staged(rows.withColumn("_tie", F.monotonically_increasing_id()), "merkle-leaves")
    order = ["_g", "_o", "_h", "_tie"]
    placed = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_o", "_tie")
                    .withColumn("_at", F.monotonically_increasing_id()), "merkle-placed")
    placed = placed.withColumn("_p", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit(_PLACE)))
    own = Window.partitionBy("_g")
    bases = staged(placed.groupBy("_g", "_p").agg(F.min("_at").alias("_first"), F.count("*").alias("_c"))
                   .select("_g", "_p", (F.sum("_c").over(own.orderBy("_p")) - F.col("_c") - F.col("_first")).alias("_base"),
                           F.sum("_c").over(own).alias("_n")), "merkle-bases")
    return placed.join(bases, ["_g", "_p"]).select("_g", (F.col("_at") + F.col("_base")).alias("_pos"), "_n", "_h", "_row")


def _pivot(nodes: DataFrame, fanout: int) -> DataFrame:
    """One row per parent: its children's slot columns, its rank and digest,
    the number of children (``_m``) and of parents (``_n``) of the group. The
    top of a finished group stays as it is."""
    slot = F.pmod("_pos", F.lit(fanout))
    child = F.struct("_h", *[c for c in nodes.columns if c not in ("_g", "_block", "_pos", "_n", "_h")])
    wide = nodes.groupBy("_g", "_block", F.floor(F.col("_pos") / fanout).alias("_pos")).agg(
        F.max("_n").alias("_m"), *[F.max(F.when(slot == j, child)).alias(f"c{j}") for j in range(fanout)])
    together = digest(*[F.coalesce(F.col(f"c{j}._h"), F.lit("")) for j in range(fanout)])
    return wide.withColumn("_n", F.ceil(F.col("_m") / fanout)).withColumn("_h", F.when(F.col("_m") > 1, together).otherwise(F.col("c0._h")))


def _children(wide: DataFrame, fanout: int) -> DataFrame:
    """The children of the parents in ``wide``, each with its path: the
    siblings before and after it, then the parent's path."""
    near = lambda js: F.concat(F.lit(""), *[F.coalesce(F.col(f"c{i}._h"), F.lit("")) for i in js])
    own = lambda j: F.when(F.col("_m") > 1, F.array(F.struct(near(range(j)).alias("l"), near(range(j + 1, fanout)).alias("r")))).otherwise(_no_path())
    each = [F.struct((F.col("_pos") * fanout + j).alias("_pos"), F.col(f"c{j}").alias("_c"), F.concat(own(j), F.col("_path")).alias("_path"))
            for j in range(fanout)]
    out = wide.select("_g", F.explode(F.filter(F.array(*each), lambda s: s["_c"].isNotNull())).alias("s"))
    return out.select("_g", "s._pos", "s._path", "s._c.*")


def _no_path() -> Column:
    return F.expr("cast(array() as array<struct<l: string, r: string>>)")


def _tree(rows: DataFrame, fanout: int) -> tuple[DataFrame, DataFrame]:
    """(rows with ``_path``, one row ``_g``, ``_h`` per group: its top).

    A block of levels, up to ``BLOCK`` leaves wide, is one stage: its nodes are
    brought together once, by block, and the rows of a parent hold its
    children's slots. Between blocks only the digests go on."""
    nodes = _ranked(rows)
    most = nodes.agg(F.max("_n")).first()[0] or 0
    depth = max(1, int(math.log(BLOCK, fanout) + 1e-9))
    blocks = []
    while most > 1 or not blocks:
        steps = 0
        nodes = nodes.withColumn("_block", F.floor(F.col("_pos") / fanout ** depth)).repartition("_g", "_block")
        while steps < depth and (most > 1 or not steps):
            nodes, most, steps = _pivot(nodes, fanout), -(-most // fanout), steps + 1
        wide = staged(nodes.drop("_block"), "merkle-block")
        blocks.append((wide, steps))
        nodes = wide.select("_g", "_pos", "_n", "_h")
    paths = None
    for wide, steps in reversed(blocks):
        wide = wide.withColumn("_path", _no_path()) if paths is None else wide.join(paths.select("_g", "_pos", "_path"), ["_g", "_pos"])
        for _ in range(steps):
            wide = _children(wide, fanout)
        paths = wide
    return paths.select("_g", "_h", "_row", "_path"), nodes.select("_g", "_h")


def fold(leaf: Column, path: Column) -> Column:
    """The digest at the end of ``path`` from ``leaf``."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["l"], h, s["r"]))


def proof(path: Column) -> Column:
    """All siblings on ``path``, concatenated from the leaf up, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), "")


def manifest(rows: DataFrame, leaf_col: str = "leaf", group_col: str = "lang", order_col: str = "doc_id", fanout: int = 2) -> DataFrame:
    """``rows`` with ``subroot``, ``root`` and ``path``, an array of
    (``l``, ``r``): the digests of the siblings left and right of the node, level
    by level from the leaf to the root.

    Groups are ordered by their text, bytewise in UTF-8, a null group first
    (a group of its own, as an empty one is). Leaves are ordered by
    ``order_col``, nulls first, rows of equal order by their leaf; equal rows
    count as often as they stand. A null leaf counts as an empty digest. A group
    of one row has that leaf as its subroot, a table of one group that subroot
    as its root. An empty table gives an empty result. Columns named like the
    new ones are replaced, others stay.
    """
    if fanout < 2:
        raise ValueError("fanout must be at least 2")
    rows = rows.drop("subroot", "root", "path")
    group = F.col(f"`{group_col}`").cast("string")
    leaves, subroots = _tree(rows.select(
        F.coalesce(F.concat(F.lit("="), group), F.lit("-")).alias("_g"), F.col(f"`{order_col}`").alias("_o"),
        F.coalesce(F.col(f"`{leaf_col}`"), F.lit("")).alias("_h"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row")), fanout)
    top, root = _tree(subroots.select(F.lit("").alias("_g"), F.col("_g").alias("_o"), "_h", F.struct("_g").alias("_row")), fanout)
    ends = staged(top.select("_row._g", F.col("_h").alias("subroot"), F.col("_path").alias("_rest"), F.lit(1).alias("_one"))
                  .join(root.select(F.col("_h").alias("root"), F.lit(1).alias("_one")), "_one").drop("_one"), "merkle-subroots")
    return leaves.join(ends, "_g").select(*[F.col("_row").getField(c).alias(c) for c in rows.columns], "subroot", "root",
                                          F.concat("_path", "_rest").alias("path"))
