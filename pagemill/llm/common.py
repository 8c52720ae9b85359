"""Shared helpers of the training-data operators.

* JVM side: ASCII lower-casing, table reading, staging, and ``BitFilter``, a
  fixed-size membership filter that lets a wide table drop most
  non-members *before* a shuffle (an exact join follows).
* Task side: numpy tokenising and hashing straight on Arrow string buffers,
  and ``sorted_runs``, which streams a sorted partition in whole key runs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.session import stage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and reread: later steps restart from the
    table, and the planner knows its size."""
    return stage(df, f"llm-{name}")


def emptied(table: DataFrame) -> None:
    """Give back the room of a staged table that no later step reads."""
    for path in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        table.sparkSession.createDataFrame([], table.schema).write.mode("overwrite").parquet(path)


def packed(df: DataFrame, *new: str) -> DataFrame:
    """All columns in one struct ``_row``, so that working columns can't clash
    with them; columns that an operator is about to add (``new``) are dropped."""
    df = df.drop(*new)
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))


def unpacked(df: DataFrame, *new: str, **replaced: Column) -> DataFrame:
    """The columns of ``_row`` again, some of them replaced, and ``new`` ones."""
    names = df.schema["_row"].dataType.names
    return df.select(*[replaced.get(c, F.col("_row").getField(c)).alias(c) for c in names], *new)


def bounded_batches(df: DataFrame, rows: int = 2000) -> DataFrame:
    """``df``, in a session that hands at most ``rows`` rows at once to
    Python: whole texts are sent, and both sides hold a batch."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    return df


@contextmanager
def batch_rows(df: DataFrame, rows: int):
    """Another number of rows handed to Python at once, for what runs within."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, rows)
    try:
        yield
    finally:
        conf.set(name, before)


@contextmanager
def shuffles_freed(df: DataFrame):
    """Shuffle files go when the write or query that made them ends, not when
    the driver happens to collect its garbage. For staged steps: none of them
    reads another one's shuffle."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        yield
    finally:
        conf.set(name, before)


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does that for pure ASCII text (a fast
    path in Spark); other text goes through ``translate``."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


class BitFilter:
    """Bloom-style filter with one hash, of a fixed number of bits.

    Built by an aggregate (at most ``bits / 64`` rows, whatever the input), so
    broadcasting it has a proven bound: 2**22 bits are 65,536 rows of 16 bytes.
    ``keep`` never loses a member; false positives are left to the exact join
    that must follow. A saturated filter keeps everything.
    """

    def __init__(self, members: DataFrame, *keys: str, bits: int = 1 << 22):
        self.bits, self.keys = bits, keys
        slot = self._slot(*keys)
        table = (members.select(slot.alias("slot"))
                 .groupBy((F.shiftright("slot", 6)).alias("_word"))
                 .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("_bits")))
        self.table = staged(table.coalesce(1), "bitfilter")

    def _slot(self, *keys) -> Column:
        return F.pmod(F.xxhash64(F.lit(7), *keys), F.lit(self.bits))

    def keep(self, df: DataFrame, *keys: str) -> DataFrame:
        """Rows of ``df`` whose key may be a member (key columns default to
        the names the filter was built from)."""
        slot = self._slot(*(keys or self.keys))
        return (df.withColumn("_slot", slot).withColumn("_word", F.shiftright("_slot", 6))
                .join(F.broadcast(self.table), "_word")
                .where(F.expr("(shiftrightunsigned(_bits, cast(_slot & 63 as int)) & 1) = 1"))
                .drop("_word", "_bits", "_slot"))

    def split(self, df: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
        """Rows of ``df`` whose key may be a member, and rows whose key is none."""
        slot = self._slot(*(keys or self.keys))
        marked = (df.withColumn("_slot", slot).withColumn("_word", F.shiftright("_slot", 6))
                  .join(F.broadcast(self.table), "_word", "left")
                  .withColumn("_maybe", F.expr("coalesce((shiftrightunsigned(_bits, cast(_slot & 63 as int)) & 1) = 1, false)"))
                  .drop("_word", "_bits", "_slot"))
        return marked.where("_maybe").drop("_maybe"), marked.where("NOT _maybe").drop("_maybe")


def without(docs: DataFrame, gone: DataFrame, key: str = "_key") -> DataFrame:
    """``docs`` less the rows whose ``key`` is in ``gone``. Only rows that the
    bit filter can't clear are shuffled, not the whole table."""
    gone = gone.select(key)
    maybe, clear = BitFilter(gone, key).split(docs)
    return clear.unionByName(maybe.join(gone, key, "left_anti"))


def bounded_sample(rows: DataFrame, id_col: str, n: int) -> DataFrame:
    """At most ``n`` rows, those with the smallest hash of ``id_col`` (ties by
    the id). A hash threshold chosen from the row count cuts the table to
    about ``n`` rows before they are ordered, so the tasks hand over about
    ``n`` rows together, not each."""
    total = rows.count()
    share = min(1.0, (n + 4 * n ** 0.5 + 16) / max(1, total))
    h = F.shiftrightunsigned(F.xxhash64(id_col), 1)
    return rows.where(h <= F.lit(min(2 ** 63 - 1, int(share * 2 ** 63)))).orderBy(h, id_col).limit(n)


# --- numpy side -----------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# fixed random odd constants: hashes agree across tasks, runs and machines
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(1 << 62, 1 << 63, dtype=np.uint64)) | 1
_POS = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | U64(1)
_POWERS = [np.ones(0, U64), np.ones(0, U64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, elementwise."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int):
    if len(_POWERS[0]) < n:
        m = max(n, 1 << 16)
        inv = pow(_BASE, -1, 1 << 64)
        for k, b in ((0, _BASE), (1, inv)):
            p = np.full(m, b, U64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def text_chunks(column: pa.Array, max_bytes: int = 1 << 18, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (first row, end row, bytes, lower-cased unless ``lower`` is off,
    offsets) of a string column, cut between rows so that a slice holds about
    ``max_bytes`` (one longer text makes a slice of its own). Null reads as
    empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + max_bytes, "right")) - 1)
        j = min(j, n)
        part = data[offs[i]:offs[j]]
        yield i, j, _LOWER[part] if lower else part, (offs[i:j + 1] - offs[i])
        i = j
    pa.default_memory_pool().release_unused()


def tokenize(buf: np.ndarray, offs: np.ndarray, space: np.ndarray = _SPACE):
    """Words of the texts of one slice: (hash, start byte, end byte) per word
    and the word offsets per text. ``space`` says which bytes separate words."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return np.zeros(0, U64), z, z, np.zeros(len(offs), np.int64)
    word = ~space[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    before = np.empty(len(buf), bool)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(len(buf), bool)
    after[-1], after[:-1] = False, word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    p, inv = _powers(len(buf))
    c = np.empty(len(buf) + 1, U64)
    c[0] = 0
    np.cumsum(_BYTE[buf] * p, out=c[1:])
    h = mix64((c[ends] - c[starts]) * inv[starts] + (ends - starts).astype(U64) * _POS[63])
    return h, starts, ends, np.searchsorted(starts, offs)


def kgrams(h: np.ndarray, woffs: np.ndarray, k: int):
    """Hash of the k words starting at each word that has k-1 successors in
    its text: (hashes, word index, k-gram offsets per text)."""
    n = np.diff(woffs)
    count = np.maximum(n - k + 1, 0)
    koffs = np.concatenate(([0], np.cumsum(count)))
    at = np.arange(koffs[-1]) + np.repeat(woffs[:-1] - koffs[:-1], count)
    g = np.zeros(len(at), U64)
    for i in range(k):
        g += h[at + i] * _POS[i]
    return mix64(g), at, koffs


def sorted_runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Stream a partition sorted by ``keys`` as tables that hold only whole
    runs of equal keys, each with the run offsets. Memory: one batch plus the
    longest run. Keys must be non-null longs."""
    def cut(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in keys:
            v = t[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if not t.num_rows:
            continue
        t = pa.concat_tables([rest, t]) if rest is not None and rest.num_rows else t
        at = cut(t)
        if len(at) > 1:
            yield t.slice(0, int(at[-1])), at
            rest = t.slice(int(at[-1])).combine_chunks()
        else:
            rest = t
    if rest is not None and rest.num_rows:
        rest = rest.combine_chunks()
        yield rest, np.append(cut(rest), rest.num_rows)


def ragged(starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the ranges [start, start + len), one after another, and the
    offsets of the ranges among them."""
    offs = np.concatenate(([0], np.cumsum(lens)))
    return np.arange(offs[-1]) + np.repeat(starts - offs[:-1], lens), offs


def binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow binary array whose row i holds values[offsets[i]:offsets[i+1]]."""
    w = values.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [
        None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64) * w), pa.py_buffer(np.ascontiguousarray(values))
    ]).cast(pa.binary())


class Groups:
    """Union-find over 0..n-1 with the smallest member as root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True

    def labels(self) -> np.ndarray:
        up = self.up
        while True:
            nxt = up[up]
            if (nxt == up).all():
                self.up = up
                return up
            up = nxt
