"""Near-duplicate detection with b-bit MinHash.

1. Every text becomes its set of distinct 5-word shingles (64-bit hashes) and
   128 minima. Bands of 4 minima give 32 bucket keys; of each minimum only
   the two low bits are retained, packed into 32 bytes.
2. Equal sets collapse to one class, represented by its smallest id.
3. Classes that share a bucket are compared by bit counts of their packed
   signatures, corrected for chance collisions (a quarter of unequal minima
   agree in two bits). Spanning links of the pairs that may reach the
   threshold (4.5 standard deviations of slack) give candidate families.
4. The full shingle sets of family members only are rebuilt and compared
   exactly; verified spanning links give the components.

At a similarity of 0.75 a pair shares no bucket with probability 5e-6 and
falls below the estimate's slack with 3e-6. Groups of any size are compared
block by block (``blocks``); no step emits the pairs of a group, no text of a
document outside a family is shuffled, and the driver sees only checksums.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.blocks import group_links
from pagemill.llm.common import (BitFilter, Groups, U64, binary, bounded_batches, kgrams, mix64, staged, text_chunks,
                                 tokenize)
from pagemill.llm.components import components

K, BANDS, ROWS, LOW_BITS = 5, 32, 4, 2
PERMS = BANDS * ROWS
_RNG = np.random.default_rng(75)
_MUL = _RNG.integers(1, 1 << 63, PERMS, dtype=np.uint64) | U64(1)
_ADD = _RNG.integers(1, 1 << 63, PERMS, dtype=np.uint64)
_ROW = _RNG.integers(1, 1 << 63, ROWS, dtype=np.uint64) | U64(1)


def shingle_sets(buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes per text; fewer than K words make one shingle, none an empty set."""
    h, _, _, woffs = tokenize(buf, offs)
    g, _, koffs = kgrams(h, woffs, K)
    out = []
    for i, n in enumerate(np.diff(woffs)):
        if n >= K:
            out.append(np.unique(g[koffs[i]:koffs[i + 1]]))
        elif n:
            one, _, _ = kgrams(h[woffs[i]:woffs[i + 1]], np.array([0, n]), int(n))
            out.append(mix64(one + U64(n)))
        else:
            out.append(np.zeros(0, U64))
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """PERMS minima of each of some non-empty sets."""
    x = np.concatenate(sets)
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), PERMS), U64)
    for p in range(PERMS):
        out[:, p] = np.minimum.reduceat(x * _MUL[p] + _ADD[p], at)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    b = (m.reshape(len(m), BANDS, ROWS) * _ROW).sum(2, dtype=U64)
    return mix64(b + np.arange(1, BANDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)).view(np.int64)


def pack(m: np.ndarray) -> np.ndarray:
    """The low bits of the minima as bit planes: PERMS bits a plane, 64 to a word."""
    planes = [np.packbits(((m >> U64(k)) & U64(1)).astype(bool), axis=1) for k in range(LOW_BITS)]
    return np.ascontiguousarray(np.hstack(planes)).view(U64)


def unequal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the packed minima of ``a`` and ``b`` (broadcast), how many differ in their low bits."""
    n = PERMS // 64
    total = 0
    for w in range(n):
        d = a[..., w] ^ b[..., w]
        for k in range(1, LOW_BITS):
            d = d | (a[..., w + k * n] ^ b[..., w + k * n])
        total = total + np.bitwise_count(d).astype(np.int16)
    return total


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimate of packed signatures."""
    chance = 0.5 ** LOW_BITS
    return (1 - unequal(a, b) / PERMS - chance) / (1 - chance)


def most_unequal(threshold: float, slack: float = 4.5) -> int:
    """The largest count of unequal minima that a pair at ``threshold`` may show."""
    p = (1 - threshold) * (1 - 0.5 ** LOW_BITS)
    return int(PERMS * p + slack * (PERMS * p * (1 - p)) ** 0.5)


def sketch(docs: DataFrame, id_col: str, text_col: str, cols: dict[str, str], sets: bool = False) -> DataFrame:
    """Per row: the columns named in ``cols`` (name: type), ``n``, a 128-bit
    ``k1``, ``k2`` key of the shingle set, the packed signature ``sig`` and
    either the band keys or, with ``sets``, the set itself."""
    names = list(cols)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in text_chunks(batch["_text"]):
                all_sets = shingle_sets(buf, offs)
                full = np.array([k for k, s in enumerate(all_sets) if len(s)], int)
                n = np.array([len(s) for s in all_sets], np.int64)
                keys, sig, bands = np.zeros((2, len(n)), np.int64), np.zeros((len(n), 4), U64), np.zeros((len(n), BANDS), np.int64)
                if len(full):
                    own = [all_sets[k] for k in full]
                    m = minima(own)
                    x, at = np.concatenate(own), np.concatenate(([0], np.cumsum(n[full])[:-1]))
                    for q in range(2):
                        keys[q, full] = np.add.reduceat(mix64(x ^ _MUL[q]), at).view(np.int64)
                    sig[full], bands[full] = pack(m), band_keys(m)
                out = [batch[c].slice(i, j - i) for c in names]
                out += [pa.array(n), pa.array(keys[0]), pa.array(keys[1]), binary(sig.ravel(), np.arange(len(n) + 1) * 4)]
                if sets:
                    out.append(binary(np.concatenate(all_sets) if len(all_sets) else np.zeros(0, U64), np.concatenate(([0], np.cumsum(n)))))
                else:
                    out.append(pa.ListArray.from_arrays(pa.array((np.arange(len(n) + 1) * BANDS).astype(np.int32)), pa.array(bands.ravel())))
                yield pa.RecordBatch.from_arrays(out, names + ["n", "k1", "k2", "sig", "shingles" if sets else "bands"])

    schema = ", ".join(f"`{c}` {t}" for c, t in cols.items()) + ", n long, k1 long, k2 long, sig binary, " + (
        "shingles binary" if sets else "bands array<long>")
    return bounded_batches(docs).select(*names, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def _words(column: pa.ChunkedArray) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offs = np.frombuffer(a.buffers()[1], np.int32)[a.offset:a.offset + len(a) + 1]
    return np.frombuffer(a.buffers()[2], np.uint8)[offs[0]:offs[-1]].copy().view(U64).reshape(len(a), -1)


def _pairs(sig: np.ndarray, side: np.ndarray, most: int, rows: int = 256):
    """Index pairs due in a run whose signatures may be similar enough, some
    rows at a time: of unequal sides where a side 2 is compared, else all."""
    n, across = len(sig), (side == 2).any()
    for i in range(0, n, rows):
        d = unequal(sig[i:i + rows, None, :], sig[None, i:, :])
        a, b = np.nonzero(d <= most)
        near = d[a, b]
        a, b = a + i, b + i
        due = (a < b) & (side[a] != side[b]) if across else a < b
        yield a[due], b[due], near[due]


def _similar(most: int):
    """Joins members of a bucket whose signatures may be similar enough."""
    def compare(t: pa.Table, side: np.ndarray, g: Groups) -> None:
        for x, y, _ in _pairs(_words(t["sig"]), side, most):
            label = g.labels()
            open_ = label[x] != label[y]
            for i, j in zip(x[open_].tolist(), y[open_].tolist()):
                g.join(i, j)
    return compare


def _similar_pairs(most: int):
    def pairs(t: pa.Table, at: np.ndarray) -> np.ndarray:
        sig = _words(t["sig"])
        return unequal(sig[at], sig[at + 1]) <= most
    return pairs


class _Overlap:
    """Exact intersection sizes among the sets of one run, as bit rows over
    the shingles that at least two of them hold."""

    def __init__(self, sets: list[np.ndarray], max_bytes: int = 128 << 20):
        x = np.concatenate(sets)
        own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        _, inv, cnt = np.unique(x, return_inverse=True, return_counts=True)
        col = np.cumsum(cnt > 1) - 1
        keep = cnt[inv] > 1
        own, col = own[keep], col[inv[keep]]
        words = int(col.max() // 64 + 1) if len(col) else 0
        self.sets, self.bits = sets, None
        if len(sets) * words * 8 <= max_bytes:
            self.bits = np.zeros((len(sets), words), U64)
            np.bitwise_or.at(self.bits, (own, col // 64), U64(1) << (col % 64).astype(U64))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.array([len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True)) for i, j in zip(a, b)], np.int64)
        out = np.empty(len(a), np.int64)
        step = max(1, (1 << 22) // max(1, self.bits.shape[1]))
        for i in range(0, len(a), step):
            out[i:i + step] = np.bitwise_count(self.bits[a[i:i + step]] & self.bits[b[i:i + step]]).sum(1, dtype=np.int64)
        return out


def _linked(most: int, percent: int):
    """Joins members of a family whose shingle sets reach the threshold."""
    def compare(t: pa.Table, side: np.ndarray, g: Groups) -> None:
        sets = [np.frombuffer(v.as_buffer(), U64) for v in t["shingles"].combine_chunks()]
        sizes, overlap = np.array([len(x) for x in sets]), _Overlap(sets)
        for x, y, near in _pairs(_words(t["sig"]), side, most):
            order = np.argsort(near, kind="stable")
            for k in range(0, len(order), 1 << 15):
                i, j = x[order[k:k + (1 << 15)]], y[order[k:k + (1 << 15)]]
                label = g.labels()
                i, j = i[label[i] != label[j]], j[label[i] != label[j]]
                both = overlap(i, j)
                link = 100 * both >= percent * (sizes[i] + sizes[j] - both)
                for p, q in zip(i[link].tolist(), j[link].tolist()):
                    g.join(p, q)
    return compare


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75,
                    block: int = 2048) -> DataFrame:
    """One row per input row: ``id_col`` (an integer), ``n_shingles``,
    ``component_id`` (smallest id reachable over links), ``kept`` and
    ``text_hash`` (of the text as it is, to tell rows that repeat an id).

    Two rows are linked when 100 * |A & B| >= ``percent`` * |A | B| over their
    sets of distinct 5-word shingles (A-Z lower-cased, words without ASCII
    white space; fewer than 5 words are one shingle). Null, empty and blank
    texts have no shingles, are linked with nothing and kept. A row with a null
    id is linked with nothing, has a null component and is kept. Rows that
    repeat an id and text are one class and share the mark. An empty table
    gives an empty result; other columns are ignored.
    """
    most = most_unequal(percent / 100)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_t"), F.xxhash64(text_col).alias("text_hash"))
    sig = staged(sketch(docs, "id", "_t", {"id": "long", "text_hash": "long"}), "minhash")
    classes = staged(sig.where("n > 0 AND id IS NOT NULL").groupBy("n", "k1", "k2")
                     .agg(F.min(F.struct("id", "sig", "bands")).alias("r"))
                     .select("n", "k1", "k2", "r.*"), "minhash-classes")
    buckets = classes.select("id", "sig", F.explode("bands").alias("bucket"))
    near = staged(group_links(buckets, "bucket", ["sig"], _similar(most), block, _similar_pairs(most)), "minhash-near")
    family = staged(components(near), "families").select(F.col("node").alias("id"), F.col("component").alias("family"))
    texts = BitFilter(family, "id").keep(docs).join(family, "id")
    members = staged(sketch(texts, "id", "_t", {"id": "long", "family": "long"}, sets=True)
                     .dropDuplicates(["id", "n", "k1", "k2"]), "minhash-members")
    links = staged(group_links(members, "family", ["sig", "shingles"], _linked(most, percent), block), "minhash-links")
    comp = components(links).select(F.col("node").alias("id"), "component")
    comp = staged(classes.select("n", "k1", "k2", "id").join(comp, "id", "left")
                  .select("n", "k1", "k2", F.coalesce("component", "id").alias("component")), "minhash-components")
    out = sig.select("id", "text_hash", "n", "k1", "k2").join(comp, ["n", "k1", "k2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"), "text_hash")
