"""Toxicity by approximate lexicon matching and context windows.

A lexicon is learned from a bounded sample of labelled documents: words, and
word stems (prefixes of 4 to 10 bytes, for languages that inflect and join
words), far more frequent in toxic documents than in clean ones. A word of a
text matches a term exactly, by one edit, or by beginning with a stem. Edits
are found by a Levenshtein automaton of the word (bit parallel) intersected
with the trie of the lexicon; words that clean labelled documents use are
never taken for misspellings.

Every hit is weighed by its context window: one within quotation marks or
after a reporting word counts as quotation, others as abuse. A logistic model
over (exact, misspelled, quoted and stem hits) gives the score.

Only few words can be within one edit of a term. An exact necessary condition
(the two share a word after at most one deletion each) is tested for all words
of a slice at once through a bit table over hashes; the automaton runs on
distinct words that pass. Scoring is narrow, with no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import (U64, _BYTE, _POS, _powers, bounded_batches, bounded_sample, mix64, packed, staged, text_chunks, tokenize,
                                 unpacked)

# bytes that are no part of a word: all but a-z, 0-9 and UTF-8's multi-byte range
_BREAK = np.ones(256, bool)
_BREAK[[*range(97, 123), *range(48, 58), *range(128, 256)]] = False
_TABLE = 1 << 22
_STEM = range(4, 11)
FEATURES = 4  # exact, misspelled, quoted, stem
# words that introduce what somebody else said
REPORTING = frozenset(b"said says say called calls call word words term terms quote quoted quotes wrote writes".split())
_QUOTES = (b'"', "“".encode(), "”".encode(), "«".encode(), "»".encode())


class Trie:
    """A lexicon as nested dicts of bytes; terms end at key -1."""

    def __init__(self, terms):
        self.root: dict = {}
        for t in terms:
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[-1] = t

    def nearest(self, word: bytes, edits: int = 1) -> tuple[bytes, int] | None:
        """The term within ``edits`` of ``word`` (fewest edits, then smallest).

        The automaton's states after a trie path are bit sets, one per number
        of edits: bit i says that the path matches the first i bytes of the
        word with that many edits.
        """
        mask: dict = {}
        for i, c in enumerate(word):
            mask[c] = mask.get(c, 0) | 1 << i
        end, best = 1 << len(word), None
        stack = [(self.root, [(1 << e + 1) - 1 for e in range(edits + 1)])]
        while stack:
            node, state = stack.pop()
            for c, nxt in node.items():
                if c == -1:
                    e = next((e for e in range(edits + 1) if state[e] & end), None)
                    if e is not None and (best is None or (e, nxt) < (best[1], best[0])):
                        best = nxt, e
                    continue
                m, new = mask.get(c, 0), []
                for e in range(edits + 1):
                    s = (state[e] & m) << 1
                    if e:  # a byte more in the term, a changed byte, a byte more in the word
                        s |= state[e - 1] | state[e - 1] << 1 | new[e - 1] << 1
                    new.append(s & (end << 1) - 1)
                if new[-1]:
                    stack.append((nxt, new))
        return best


def _deletions(word: bytes) -> set[bytes]:
    return {word[:i] + word[i + 1:] for i in range(len(word))}


def _hash_words(words: list[bytes]) -> np.ndarray:
    words = [w for w in words if w]
    if not words:
        return np.zeros(0, U64)
    buf = np.frombuffer(b" ".join(words), np.uint8)
    return tokenize(buf, np.array([0, len(buf)]), _BREAK)[0]


@dataclass
class ToxicModel:
    lexicon: dict[bytes, float] = field(default_factory=dict)  # term: log odds
    stems: dict[bytes, float] = field(default_factory=dict)
    clean: frozenset = frozenset()  # words near a term that clean documents use
    weights: tuple = (0.0, 0.0, 0.0, 0.0)
    bias: float = -3.0
    min_fuzzy: int = 5  # shorter words match exactly only


class Matcher:
    """Finds lexicon hits in slices of text; one per task."""

    def __init__(self, model: ToxicModel):
        self.model, self.trie, self.known = model, Trie(model.lexicon), {}
        near = set(model.lexicon)
        for t in model.lexicon:
            near |= _deletions(t)
        self.near = np.zeros(_TABLE, bool)
        self.near[(_hash_words([w for w in near if w]) % U64(_TABLE)).astype(np.int64)] = True
        self.stem = np.zeros(_TABLE, bool)
        self.stem[(_hash_words(list(model.stems)) % U64(_TABLE)).astype(np.int64)] = True
        self.lengths = sorted({len(x) for x in model.stems})
        self.longest = max(map(len, model.lexicon), default=0)

    def _maybe(self, buf, h, starts, ends) -> np.ndarray:
        """Words that share a word with some term after at most one deletion each."""
        hit = self.near[(h % U64(_TABLE)).astype(np.int64)]
        size = ends - starts
        short = np.flatnonzero((size > 1) & (size <= self.longest + 1))  # longer words are no term and one edit
        hit &= size <= self.longest + 1
        p, inv = _powers(len(buf) + 2)
        c = np.empty(len(buf) + 1, U64)
        c[0] = 0
        np.cumsum(_BYTE[buf] * p[:len(buf)], out=c[1:])
        n = size[short]
        word = np.repeat(short, n)
        at = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n) + starts[word]
        s, e = starts[word], ends[word]
        g = mix64(((c[at] - c[s]) + (c[e] - c[at + 1]) * inv[1]) * inv[s] + (e - s - 1).astype(U64) * _POS[63])
        one = self.near[(g % U64(_TABLE)).astype(np.int64)]
        hit[word[one]] = True
        for n in self.lengths:
            w = np.flatnonzero(size >= n)
            s = starts[w]
            g = mix64((c[s + n] - c[s]) * inv[s] + np.full(1, n, U64) * _POS[63])
            hit[w[self.stem[(g % U64(_TABLE)).astype(np.int64)]]] = True
        return hit

    def lookup(self, word: bytes) -> tuple[float, int] | None:
        """(weight, feature) of a word that hits."""
        m = self.model
        if word in m.lexicon:
            return m.lexicon[word], 0
        if len(word) >= m.min_fuzzy and word not in m.clean:
            found = self.trie.nearest(word)
            if found and len(found[0]) >= m.min_fuzzy:
                return m.lexicon[found[0]], 1
        for n in self.lengths:
            if word[:n] in m.stems:
                return m.stems[word[:n]], 3
        return None

    def features(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """(texts, FEATURES): weights of the hits of each kind."""
        out = np.zeros((len(offs) - 1, FEATURES))
        h, starts, ends, woffs = tokenize(buf, offs, _BREAK)
        if not len(h) or not (self.model.lexicon or self.model.stems):
            return out
        for w in np.flatnonzero(self._maybe(buf, h, starts, ends)).tolist():
            key = int(h[w])
            if key not in self.known:
                if len(self.known) > 1_000_000:
                    self.known.clear()
                self.known[key] = self.lookup(buf[starts[w]:ends[w]].tobytes())
            if (found := self.known[key]) is None:
                continue
            d = int(np.searchsorted(woffs, w, "right")) - 1
            quoted = self._quoted(buf, offs, woffs, starts, ends, d, w)
            out[d, 2 if quoted else found[1]] += found[0]
        return out

    @staticmethod
    def _quoted(buf, offs, woffs, starts, ends, d, w, words: int = 4, reach: int = 160) -> bool:
        """A reporting word among the few words before, or an odd number of
        quotation marks before the hit and one after it, on its line."""
        lo, hi = max(offs[d], starts[w] - reach), min(offs[d + 1], ends[w] + reach)
        before = buf[lo:starts[w]].tobytes().rpartition(b"\n")[2]
        after = buf[ends[w]:hi].tobytes().partition(b"\n")[0]
        if sum(before.count(q) for q in _QUOTES) % 2 and any(q in after for q in _QUOTES):
            return True
        return any(buf[starts[k]:ends[k]].tobytes() in REPORTING for k in range(max(int(woffs[d]), w - words), w))


def _predict(model: ToxicModel, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(np.log1p(x) @ np.array(model.weights) + model.bias)))


def score_toxicity(docs: DataFrame, model: ToxicModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) added or replaced.

    Only the text decides; a null or empty text, and any text under a model
    without a lexicon, scores as a text without hits. Edits count bytes of
    UTF-8 after lower-casing A-Z. Rows and other columns stay as they are.
    """
    sent = packed(docs, "score").withColumn("_text", F.col("_row").getField(text_col))
    schema = sent.select("_row").withColumn("score", F.lit(0.0)).schema

    def run(batches):
        match = Matcher(model)
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for i, j, buf, offs in text_chunks(batch["_text"]):
                score[i:j] = _predict(model, match.features(buf, offs))
            yield pa.RecordBatch.from_arrays([batch["_row"], pa.array(score)], ["_row", "score"])

    return unpacked(bounded_batches(sent).mapInArrow(run, schema), "score")


def _words_of(docs: DataFrame, text_col: str) -> DataFrame:
    """Distinct words and stems of each labelled document, with its label."""
    def run(batches):
        for batch in batches:
            for i, j, buf, offs in text_chunks(batch["_text"]):
                h, starts, ends, woffs = tokenize(buf, offs, _BREAK)
                toxic, text = batch["_toxic"].slice(i, j - i).to_pylist(), buf.tobytes()
                words, stems, label = [], [], []
                for d in range(j - i):
                    own = {text[s:e] for s, e in zip(starts[woffs[d]:woffs[d + 1]], ends[woffs[d]:woffs[d + 1]])}
                    # a word as long as a stem is one of its uses
                    part = {w[:n] for w in own for n in _STEM if len(w) >= n}
                    words += [*own, *part]
                    stems += [False] * len(own) + [True] * len(part)
                    label += [toxic[d]] * (len(own) + len(part))
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(stems), pa.array(label, pa.int32())],
                                                 ["word", "stem", "toxic"])
    return bounded_batches(docs).select(F.col(text_col).alias("_text"), "_toxic").mapInArrow(run, "word binary, stem boolean, toxic int")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_docs: int = 8_000, max_terms: int = 2_000, min_docs: int = 3, min_lift: float = 20.0,
        max_near: int = 50_000) -> ToxicModel:
    """Learn lexicon, clean words and weights from at most ``max_docs``
    documents of ``labels`` (id, 0/1; one labelled both ways is toxic), drawn in
    the order of a hash of the id. A term occurs in at
    least ``min_docs`` toxic documents, ``min_lift`` times as often as in
    clean ones. Null labels are no evidence; without both labels the model has
    no lexicon and gives every text the same score."""
    ids = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
           .groupBy(id_col).agg(F.max(label_col).cast("int").alias("_toxic")))
    ids = staged(bounded_sample(ids, id_col, max_docs), "toxic-sample")
    sample = staged(docs.select(id_col, text_col).join(F.broadcast(ids), id_col), "toxic-texts")  # max_docs rows
    counts = ids.groupBy("_toxic").count().collect()
    n = {r["_toxic"]: r["count"] for r in counts}
    if not n.get(1) or not n.get(0):
        return ToxicModel()
    words = (_words_of(sample, text_col).groupBy("word", "stem")
             .agg(F.sum(F.col("toxic")).alias("t"), F.sum(1 - F.col("toxic")).alias("c")))
    words = staged(words, "toxic-words")
    lift = ((F.col("t") + 0.5) / (n[1] + 1)) / ((F.col("c") + 0.5) / (n[0] + 1))
    found = words.where((F.col("t") >= min_docs) & (lift >= min_lift)).select("word", "stem", "t", F.log(lift).alias("w"))
    terms, stems = (found.where(c).orderBy(F.desc("t"), "word").limit(max_terms).collect()
                    for c in ("NOT stem AND octet_length(word) >= 3", "stem"))
    model = ToxicModel({bytes(r.word): float(r.w) for r in terms})
    for r in sorted(stems, key=lambda r: (len(r.word), r.word)):  # the shortest stem stands for longer ones
        if not any(bytes(r.word[:n]) in model.stems for n in _STEM):
            model.stems[bytes(r.word)] = float(r.w)

    def near(batches):  # words of clean documents that would pass for misspellings
        match = Matcher(model)
        for batch in batches:
            keep = [(x := match.lookup(bytes(w))) is not None and x[1] == 1 for w in batch["word"].to_pylist()]
            yield batch.filter(pa.array(keep))

    longest = max(map(len, model.lexicon), default=0)
    some = words.where(f"c > 0 AND NOT stem AND octet_length(word) BETWEEN 4 AND {longest + 1}").select("word")
    model.clean = frozenset(bytes(r.word) for r in some.mapInArrow(near, "word binary").limit(max_near).collect()) - set(model.lexicon)

    def features(batches):
        match = Matcher(model)
        for batch in batches:
            x = np.zeros((batch.num_rows, FEATURES))
            for i, j, buf, offs in text_chunks(batch["_text"]):
                x[i:j] = match.features(buf, offs)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, k]) for k in range(FEATURES)] + [batch["_toxic"]], ["a", "b", "c", "d", "y"])

    rows = sample.select(F.col(text_col).alias("_text"), "_toxic").mapInArrow(features, "a double, b double, c double, d double, y int").collect()
    data = np.array(sorted(tuple(r) for r in rows))
    x, y = np.log1p(data[:, :FEATURES]), data[:, FEATURES]
    w, b = np.zeros(FEATURES), 0.0
    for _ in range(200):  # Newton steps with a weak prior
        p = 1 / (1 + np.exp(-(x @ w + b)))
        a = np.column_stack([x, np.ones(len(x))])
        grad = a.T @ (p - y) + 0.1 * np.append(w, 0)
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag([0.1] * FEATURES + [1e-6])
        step = np.linalg.solve(hess, grad)
        w, b = w - step[:-1], b - step[-1]
        if np.abs(step).max() < 1e-8:
            break
    # hits never speak against toxicity
    model.weights, model.bias = tuple(np.maximum(w, 0)), float(b)
    return model
