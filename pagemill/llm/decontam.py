"""Benchmark decontamination with SimHash windows and a multi-index.

Benchmark items are a stated query set, taken in blocks of bounded size; every
document is compared with each block in one narrow ``mapInArrow`` (no
shuffle). For an item of n words, windows of n words slide over a document
wherever it shares a 5-word shingle with the item (a window without one has
similarity 0, so nothing is lost); an item of under 5 words is one shingle, and
so is each window of its size. A window's 64-bit SimHash over its weighted
shingles is looked up in a multi-index: fingerprints are cut into four blocks
of 16 bits, two fingerprints within a radius of 19 differ by at most 4 bits in
one of them, and each block's table lists the items within 4 bits of every
value, so all fingerprints within the radius are found. Candidates are then
compared exactly by weighted shingle similarity.

A shingle's weight is the sum over its words of round(8 ln(1 + bytes)), so
that long words count more than short ones; similarity is the weighted Jaccard
of the two multisets.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pagemill.llm.common import U64, bounded_batches, kgrams, mix64, text_chunks, tokenize

K, BLOCKS, RADIUS = 5, 4, 19
_TABLE = 1 << 22
_PIECE = 4096  # windows whose fingerprints are made at once


@dataclass
class Item:
    id: object
    words: int
    shingles: np.ndarray  # hashes in order
    weights: np.ndarray


def _shingles(h: np.ndarray, sizes: np.ndarray, woffs: np.ndarray):
    """Shingle hashes, weights and offsets per text; 1 to 4 words make one shingle."""
    g, at, koffs = kgrams(h, woffs, K)
    per_word = np.rint(8 * np.log1p(sizes)).astype(np.int64)
    c = np.concatenate(([0], np.cumsum(per_word)))
    return g, c[at + K] - c[at], koffs, per_word


def _whole(h: np.ndarray, woffs: np.ndarray, n: int):
    """Hash of every window of ``n`` words, n under 5, as the one shingle it
    has, and the window offsets per text."""
    g, _, koffs = kgrams(h, woffs, n)
    return mix64(g + U64(n)), koffs


def fingerprints(g: np.ndarray, w: np.ndarray, span: int) -> np.ndarray:
    """SimHash of every run of ``span`` consecutive shingles."""
    bits = np.unpackbits(np.ascontiguousarray(mix64(g)).view(np.uint8).reshape(-1, 8), axis=1)
    c = np.zeros((len(g) + 1, 64), np.int32)
    np.cumsum((bits.astype(np.int32) * 2 - 1) * w[:, None].astype(np.int32), axis=0, out=c[1:])
    return np.ascontiguousarray(np.packbits(c[span:] > c[:-span], axis=1)).view(U64).ravel()


def similarity(a: Counter, weight: dict, b: Counter) -> float:
    """Weighted Jaccard of two shingle multisets."""
    low = sum(min(n, b[g]) * weight[g] for g, n in a.items() if g in b)
    total = sum(n * weight[g] for g, n in a.items()) + sum(n * weight[g] for g, n in b.items())
    return low / (total - low) if total else 0.0


class MultiIndex:
    """Finds all items whose fingerprint lies within ``RADIUS`` bits."""

    def __init__(self, prints: np.ndarray):
        self.prints, self.tables = prints, []
        flips = [sum(1 << i for i in c) for n in range(RADIUS // BLOCKS + 1) for c in combinations(range(16), n)]
        near = np.array(flips, np.uint16)
        for b in range(BLOCKS):
            key = (self._block(prints, b)[:, None] ^ near).astype(np.int64).ravel()
            order = np.argsort(key, kind="stable")
            self.tables.append((np.searchsorted(key[order], np.arange(65537)), order // len(near)))

    @staticmethod
    def _block(f: np.ndarray, b: int) -> np.ndarray:
        return ((f >> U64(16 * b)) & U64(0xFFFF)).astype(np.uint16)

    def find(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all pairs within the radius."""
        pairs = []
        for b, (at, items) in enumerate(self.tables):
            v = self._block(f, b).astype(np.int64)
            n = at[v + 1] - at[v]
            win = np.repeat(np.arange(len(f)), n)
            pairs.append(win * len(self.prints) + items[np.arange(len(win)) + np.repeat(at[v] - np.cumsum(n) + n, n)])
        win, item = np.divmod(np.unique(np.concatenate(pairs)), len(self.prints))
        d = np.bitwise_count(f[win] ^ self.prints[item])
        return win[d <= RADIUS], item[d <= RADIUS], d[d <= RADIUS]


class Block:
    """One block of items, indexed; built once per task."""

    def __init__(self, texts: list[tuple[object, str]]):
        self.items: list[Item] = []
        for key, text in texts:
            for _, _, buf, offs in text_chunks(pa.array([text], pa.string())):
                h, s, e, woffs = tokenize(buf, offs)
                if len(h):
                    g, w, _, per = _shingles(h, e - s, woffs)
                    if len(h) < K:
                        g, w = _whole(h, woffs, len(h))[0], np.array([per.sum()])
                    self.items.append(Item(key, len(h), g, w))
        self.sizes = np.array([i.words for i in self.items], np.int64)
        self.index = MultiIndex(np.concatenate([fingerprints(i.shingles, i.weights, len(i.shingles)) for i in self.items])) if self.items else None
        self.bags = [Counter(i.shingles.tolist()) for i in self.items]
        g = np.concatenate([i.shingles for i in self.items]) if self.items else np.zeros(0, U64)
        own = np.repeat(np.arange(len(self.items)), [len(i.shingles) for i in self.items])
        order = np.argsort(g, kind="stable")
        self.g, self.own = g[order], own[order]
        self.table = np.zeros(_TABLE, bool)
        self.table[(self.g % U64(_TABLE)).astype(np.int64)] = True

    def seeds(self, g: np.ndarray):
        """(position, item) of every shingle of ``g`` that an item has."""
        at = np.flatnonzero(self.table[(g % U64(_TABLE)).astype(np.int64)])
        lo, hi = np.searchsorted(self.g, g[at], "left"), np.searchsorted(self.g, g[at], "right")
        n = hi - lo
        return np.repeat(at, n), self.own[np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)]

    def short_matches(self, h: np.ndarray, woffs: np.ndarray):
        """(text, (item, first word, words, similarity)): windows equal to an
        item of under 5 words, the first of each text and item. Such a window
        is one shingle, so its similarity is 1 or 0."""
        for n in np.unique(self.sizes[self.sizes < K]).tolist():
            g, koffs = _whole(h, woffs, n)
            pos, item = self.seeds(g)
            pos, item = pos[self.sizes[item] == n], item[self.sizes[item] == n]
            doc = np.searchsorted(koffs, pos, "right") - 1
            _, first = np.unique(doc * len(self.items) + item, return_index=True)
            for d, i, x in zip(doc[first].tolist(), item[first].tolist(), (pos - koffs[doc])[first].tolist()):
                yield d, (i, x, n, 1.0)

    def matches(self, g: np.ndarray, w: np.ndarray, words: int, threshold: float):
        """(item, first word, words, similarity): the best window of each item
        of at least 5 words in one text."""
        pos, item = self.seeds(g)
        best: dict = {}
        for n in np.unique(self.sizes[item][self.sizes[item] >= K]).tolist():
            span = min(max(n - K + 1, 1), len(g))  # shingles of a window
            seeds = np.unique(pos[self.sizes[item] == n])
            last = len(g) - span
            lo, hi = np.clip(seeds - span + 1, 0, last), np.clip(seeds, 0, last)
            # windows around the seeds, as disjoint stretches
            cut = np.flatnonzero(lo[1:] > hi[:-1] + 1) + 1
            ends = zip(lo[np.concatenate(([0], cut))].tolist(), hi[np.append(cut, len(hi)) - 1].tolist())
            # in pieces, so that memory follows the item and not the text
            for a, b in ((x, min(x + _PIECE, b + 1) - 1) for a, b in ends for x in range(a, b + 1, _PIECE)):
                f = fingerprints(g[a:b + span], w[a:b + span], span)
                win, near, dist = self.index.find(f)
                ok = self.sizes[near] == n
                for x, i in zip((win[ok] + a).tolist(), near[ok].tolist()):
                    gs, ws = g[x:x + span].tolist(), w[x:x + span].tolist()
                    weight = dict(zip(gs, ws)) | dict(zip(self.items[i].shingles.tolist(), self.items[i].weights.tolist()))
                    s = similarity(Counter(gs), weight, self.bags[i])
                    if s >= threshold and (i not in best or (-s, x) < (-best[i][2], best[i][0])):
                        best[i] = x, min(n, words), s
        return [(i, *best[i]) for i in sorted(best)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text: str = "text", threshold: float = 0.75,
               block_items: int = 500) -> DataFrame:
    """One row per document and benchmark item of which a window reaches
    ``threshold``: ``id_col``, ``item_col``, ``start`` (first word, from 0),
    ``n_words`` and ``similarity`` of the best window (the first of equals).

    Texts are lower-cased (A-Z) and split at ASCII white space. A document
    shorter than an item is one window; fewer than 5 words are one shingle.
    ``id_col`` and ``item_col`` must differ. Null, empty and blank texts and items match nothing; rows and items that
    repeat an id are compared each. An empty table gives an empty result;
    other columns are ignored.
    """
    if id_col.lower() == item_col.lower():
        raise ValueError("id_col and item_col name one column of the result")
    spark = docs.sparkSession
    types = {c: t for c, t in [*docs.select(id_col).dtypes, *benchmark.select(item_col).dtypes]}
    schema = f"`{id_col}` {types[id_col]}, `{item_col}` {types[item_col]}, start long, n_words long, similarity double"
    result = None
    # a stated query set: its items pass through the driver block by block
    items = benchmark.select(item_col, item_text).where(F.col(item_text).isNotNull())
    rows = items.orderBy(item_col, item_text).toLocalIterator()
    block: list = []

    def compare(texts):
        arrow_type = to_arrow_type(benchmark.schema[item_col].dataType)

        def run(batches):
            index = Block(texts)
            for batch in batches:
                ids = batch[id_col]
                doc, found = [], []
                for i, j, buf, offs in text_chunks(batch["_text"]):
                    h, s, e, woffs = tokenize(buf, offs)
                    if not index.items or not len(h):
                        continue
                    g, w, koffs, per = _shingles(h, e - s, woffs)
                    words = np.diff(woffs)
                    for d in np.unique(np.searchsorted(koffs, index.seeds(g)[0], "right") - 1).tolist():
                        for m in index.matches(g[koffs[d]:koffs[d + 1]], w[koffs[d]:koffs[d + 1]], int(words[d]), threshold):
                            doc.append(i + d)
                            found.append(m)
                    for d, m in index.short_matches(h, woffs):
                        doc.append(i + d)
                        found.append(m)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(doc, pa.int64())), pa.array([index.items[m[0]].id for m in found], arrow_type),
                     pa.array([m[1] for m in found], pa.int64()), pa.array([m[2] for m in found], pa.int64()),
                     pa.array([m[3] for m in found], pa.float64())],
                    [id_col, item_col, "start", "n_words", "similarity"])

        return bounded_batches(docs).select(id_col, F.col(text_col).alias("_text")).mapInArrow(run, schema)

    def add(texts):
        nonlocal result
        part = compare(texts)
        result = part if result is None else result.unionByName(part)

    for r in rows:
        block.append((r[0], r[1]))
        if len(block) == block_items:
            add(block)
            block = []
    if block:
        add(block)
    return result if result is not None else spark.createDataFrame([], schema)
