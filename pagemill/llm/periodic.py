"""Runs of periodic repetition in the words of a text.

A run is a stretch of consecutive words with smallest period q, at least
``min_repeats`` periods and ``min_words`` words long, that no neighbouring word
extends.

* **Longest common extensions (LCE)**: of the suffixes of the word sequence,
  only those at places of a difference cover modulo ``V`` are sorted (by pairs
  of words, then by prefix doubling, ties only). Their neighbours' common
  prefixes fill a sparse table for range minima. Any two places i, j have a
  shift below ``V`` that brings both into the cover: at most so many words are
  compared one by one, the sorted samples tell the rest at once.
* **Enumeration**: a run of period p contains two places of the grid 0, p,
  2p, ... in its first two periods, so LCE(i, i + p) over the grids of all p
  (n/1 + n/2 + ..., n log n in all) meets every run. The run's start follows
  from LCE by bisection. Runs found under a multiple of their period have the
  same ends; the smallest period stays.

Texts are read in slices whose texts share one sorted sample, with an end
marker of its own after each text: a narrow pass without a shuffle. A task
holds one slice, a very long text is a slice of its own (about 100 bytes a
word).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import bounded_batches, packed, ragged, text_chunks, tokenize, unpacked

V, COVER = 21, (3, 6, 7, 12, 14)  # a perfect difference set: each difference modulo 21 occurs
GRID = 1 << 20  # grid places looked at together


def _shifts() -> np.ndarray:
    """For residues a, b: the smallest shift that brings both into the cover."""
    within = np.isin(np.arange(V), COVER)
    both = within[(np.arange(V)[:, None, None] + np.arange(V)) % V] & within[(np.arange(V)[None, :, None] + np.arange(V)) % V]
    return both.argmax(2)


_SHIFT = _shifts()
_NTH = np.searchsorted(COVER, np.arange(V))


class LCE:
    """Longest common extensions of places in ``words`` (codes from 0), whose
    last code must occur nowhere else."""

    def __init__(self, words: np.ndarray):
        n, k = len(words), len(COVER)
        at = (np.arange(-(-n // V))[:, None] * V + np.array(COVER)).ravel()
        top = int(words.max()) + 1
        self.w = w = np.concatenate((words, top + np.arange(int(at[-1]) + 2 * V + 2 - n)))
        base, m = int(w[-1]) + 1, len(at)
        name, tied = np.zeros(m, np.int64), np.arange(m)
        for t in range(0, V, 2):
            if not len(tied):
                break
            key = w[at[tied] + t] * base + (w[at[tied] + t + 1] if t + 1 < V else 0)
            tied = self._split(name, tied, key)
        names, step = [name.copy()], 1  # names[x] agree where V << x words do
        while len(tied):
            tied = self._split(name, tied, name[tied + step * k])
            names.append(name.copy())
            step *= 2
        order = np.empty(m, np.int64)
        order[name] = np.arange(m)
        self.rank, self.table = name, self._minima(self._neighbours(order, names, at))

    @staticmethod
    def _split(name: np.ndarray, tied: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Refine the names (first slot of the group in sorted order) of the
        ``tied`` samples by ``key``; the samples still tied."""
        order = np.lexsort((key, name[tied]))
        tied, key = tied[order], key[order]
        group, slot = name[tied], np.arange(len(tied))
        new = np.ones(len(tied), bool)
        new[1:] = group[1:] != group[:-1]
        old_first = np.maximum.accumulate(np.where(new, slot, 0))
        new[1:] |= key[1:] != key[:-1]
        first = np.maximum.accumulate(np.where(new, slot, 0))
        name[tied] = group + first - old_first
        return tied[~(new & np.append(new[1:], True))]

    def _neighbours(self, order: np.ndarray, names: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """Common prefix, in words, of each two neighbours in sorted order."""
        a, b = order[:-1].copy(), order[1:].copy()
        out = np.zeros(len(a), np.int64)
        for x in reversed(range(len(names))):
            same = names[x][a] == names[x][b]
            a += same * (len(COVER) << x)
            b += same * (len(COVER) << x)
            out += same * (V << x)
        live = np.arange(len(a))
        for t in range(V):
            live = live[self.w[at[a[live]] + t] == self.w[at[b[live]] + t]]
            out[live] += 1
        return out

    @staticmethod
    def _minima(values: np.ndarray) -> np.ndarray:
        rows = [values.astype(np.int32)]
        while 2 << len(rows) - 1 <= len(values):
            h, last = 1 << len(rows) - 1, rows[-1]
            row = last.copy()
            row[:-h] = np.minimum(last[:-h], last[h:])
            rows.append(row)
        return np.array(rows)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of words equal from i and from j on (i and j differ)."""
        out, shift = np.zeros(len(i), np.int64), _SHIFT[i % V, j % V]
        live, met, t = np.arange(len(i)), [], 0
        while len(live):
            there = shift[live] == t
            met.append(live[there])
            live = live[~there]
            same = self.w[i[live] + t] == self.w[j[live] + t]
            out[live[~same]] = t
            live, t = live[same], t + 1
        if met:
            x = np.concatenate(met)
            a, b = (self.rank[(p // V) * len(COVER) + _NTH[p % V]] for p in (i[x] + shift[x], j[x] + shift[x]))
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            level = np.frexp((hi - lo).astype(np.float64))[1] - 1
            out[x] = shift[x] + np.minimum(self.table[level, lo], self.table[level, hi - (1 << level)])
        return out


def find_runs(words: np.ndarray, offs: np.ndarray, min_words: int = 24, min_repeats: int = 3) -> np.ndarray:
    """Runs of texts whose words (codes) stand between ``offs``: rows (text,
    start, length, period), by text, start and period."""
    n = np.diff(offs)
    texts = np.flatnonzero(n >= max(min_words, min_repeats))
    found = [np.zeros((0, 4), np.int64)]
    if not len(texts):
        return found[0]
    # the texts with a marker behind each, none like another
    n = n[texts]
    at, start = ragged(offs[texts], n + 1)
    seq = np.append(words, 0)[at]
    ends, start = start[1:] - 1, start[:-1]
    seq[ends] = int(seq.max()) + 1 + np.arange(len(ends))
    lce = LCE(seq)
    periods, _ = ragged(np.ones(len(texts), np.int64), n // min_repeats)
    text = np.repeat(np.arange(len(texts)), n // min_repeats)
    need = np.maximum((min_repeats - 2) * periods + 1, min_words - 2 * periods + 1)
    places = np.maximum((n[text] - periods - need) // periods + 1, 0)
    upto = np.concatenate(([0], np.cumsum(places)))
    lo = 0
    while lo < len(places):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + GRID, "right")) - 1)
        nth, _ = ragged(np.zeros(hi - lo, np.int64), places[lo:hi])
        row = np.repeat(np.arange(lo, hi), places[lo:hi])
        p, first = periods[row], start[text[row]]
        i = first + nth * p
        keep = lce.w[i] == lce.w[i + p]
        i, p, row, first = i[keep], p[keep], row[keep], first[keep]
        f = lce(i, i + p)
        keep = f >= need[row]
        i, p, f, row, first = i[keep], p[keep], f[keep], row[keep], first[keep]
        # the first place of the grid in the run
        keep = i == first
        rest = np.flatnonzero(~keep)
        keep[rest] = lce(i[rest] - p[rest], i[rest]) < p[rest]
        i, p, f, row, first = i[keep], p[keep], f[keep], row[keep], first[keep]
        low, high = np.zeros(len(i), np.int64), np.minimum(p - 1, i - first)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_] + 1) // 2
            ok = lce(i[open_] - mid, i[open_] + p[open_] - mid) >= mid
            low[open_[ok]] = mid[ok]
            high[open_[~ok]] = mid[~ok] - 1
        length = low + p + f
        ok = length >= np.maximum(min_words, min_repeats * p)
        found.append(np.column_stack((texts[text[row]], i - first - low, length, p))[ok])
        lo = hi
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :3] != runs[:-1, :3]).any(1)
    runs = runs[new]
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def collapse(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, woffs: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words outside of the later periods of runs, joined by one space:
    bytes and offsets per text."""
    change = np.zeros(len(starts) + 1, np.int64)
    base = woffs[runs[:, 0]] + runs[:, 1]
    np.add.at(change, base + runs[:, 3], 1)
    np.add.at(change, base + runs[:, 2], -1)
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    at, offs = ragged(starts[kept], lens[kept] + 1)
    data = np.append(buf, np.uint8(32))[np.minimum(at, len(buf))]
    data[offs[1:] - 1] = 32
    first = np.searchsorted(kept, woffs)
    whole = np.ones(len(data), bool)
    some = first[1:] > first[:-1]
    whole[offs[first[1:][some]] - 1] = False  # no space after a text's last word
    size = offs[first[1:]] - offs[first[:-1]] - some
    return data[whole], np.concatenate(([0], np.cumsum(size)))


def periodic_runs(docs: DataFrame, text_col: str = "text", min_words: int = 24, min_repeats: int = 3) -> DataFrame:
    """``docs`` with ``runs``, an array of (``start``, ``length``, ``period``)
    in words, by start and period, and ``collapsed``, the text's words without
    those that a run holds after its first period, joined by one space.

    Words are split at ASCII white space and compared exactly. Null, empty and
    short texts have no runs; of a null text ``collapsed`` is empty. Runs of
    one text may overlap. Each row stands for itself: repeated rows and ids,
    other columns and empty tables pass; columns named ``runs`` or
    ``collapsed`` are replaced.
    """
    if min_repeats < 2:
        raise ValueError("a run has at least two periods")
    sent = packed(docs, "runs", "collapsed").withColumn("_text", F.col("_row").getField(text_col))
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = sent.select("_row", F.expr("cast(array() as array<struct<start: long, length: long, period: long>>)").alias("runs"),
                         F.lit("").alias("collapsed")).schema

    def run(batches):
        for batch in batches:
            for i, j, buf, offs in text_chunks(batch["_text"], 1 << 20, lower=False):
                _, starts, ends, woffs = tokenize(buf, offs)
                lens = ends - starts
                at, where = ragged(starts, lens)
                whole = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(where), pa.py_buffer(buf[at])])
                codes = whole.dictionary_encode().indices.to_numpy().astype(np.int64)
                runs = find_runs(codes, woffs, min_words, min_repeats)
                data, ends = collapse(buf, starts, lens, woffs, runs)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(runs[:, 0], np.arange(j - i + 1)).astype(np.int32)),
                                                 pa.StructArray.from_arrays([pa.array(runs[:, c].copy()) for c in (1, 2, 3)], fields=list(run_type)))
                text = pa.Array.from_buffers(pa.large_string(), j - i, [None, pa.py_buffer(ends), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([batch["_row"].slice(i, j - i), lists, text.cast(pa.string())], ["_row", "runs", "collapsed"])

    return unpacked(bounded_batches(sent).mapInArrow(run, schema), "runs", "collapsed")
