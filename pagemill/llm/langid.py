"""Language identification with a byte convolutional network.

Filters of 2, 3 and 4 bytes slide over fixed-length windows of the lower-cased
bytes; ReLU, max pooling over the window and a softmax give the window's
language. The network is trained in numpy on a bounded sample of labelled
texts. A text is predicted from all its windows: their probabilities are
averaged by bytes covered. Prediction is a narrow ``mapInArrow`` (no shuffle);
a task holds one slice of about a megabyte of text at a time.

A filter over one-hot bytes is a sum of table rows, one per position; for
prediction the tables of neighbouring positions are folded into tables over
byte pairs, so a window costs a few gathers instead of a matrix product.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import bounded_batches, bounded_sample, packed, staged, text_chunks, unpacked

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
UNKNOWN = "und"


@dataclass
class ByteCNN:
    """Weights: per width a table (width, 256, FILTERS), a bias, and the softmax layer."""

    languages: list[str]
    conv: list[np.ndarray] = field(default_factory=list)
    bias: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray | None = None
    out_bias: np.ndarray | None = None
    seen: np.ndarray | None = None  # bits of the byte trigrams in the training windows


def windows(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts of one slice: bytes (n, WINDOW) padded with
    spaces, the text of each window, the bytes each covers."""
    size = np.diff(offs)
    count = -(-size // WINDOW)
    text = np.repeat(np.arange(len(size)), count)
    start = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    at = (offs[:-1][text] + start)[:, None] + np.arange(WINDOW)
    covered = np.minimum(size[text] - start, WINDOW)
    w = buf[np.minimum(at, len(buf) - 1)] if len(text) else np.zeros((0, WINDOW), np.uint8)
    return np.where(np.arange(WINDOW) < covered[:, None], w, np.uint8(32)), text, covered


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(samples: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 6, batch: int = 64,
          rate: float = 0.01, seed: int = 5) -> ByteCNN:
    """Fit by Adam on windows ``samples`` (n, WINDOW) with class indices ``labels``; classes weigh alike."""
    rng, c = np.random.default_rng(seed), len(languages)
    net = ByteCNN(languages,
                  [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
                  [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
                  rng.normal(0, 0.1, (FILTERS * len(WIDTHS), c)).astype(np.float32), np.zeros(c, np.float32))
    params = [*net.conv, *net.bias, net.out, net.out_bias]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = (len(labels) / (c * np.maximum(np.bincount(labels, minlength=c), 1))).astype(np.float32)
    step, cols = 0, np.arange(FILTERS)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for s in range(0, len(order), batch):
            x, y = samples[order[s:s + batch]], labels[order[s:s + batch]]
            n, rows, pooled, best = len(x), np.arange(len(x))[:, None], [], []
            for w, table, b in zip(WIDTHS, net.conv, net.bias):
                span = WINDOW - w + 1
                z = sum(table[k][x[:, k:k + span]] for k in range(w)) + b
                best.append(z.argmax(1))
                pooled.append(np.maximum(np.take_along_axis(z, best[-1][:, None], 1)[:, 0], 0))
            hidden = np.hstack(pooled)
            g = _softmax(hidden @ net.out + net.out_bias)
            g[np.arange(n), y] -= 1
            g *= (weight[y] / n)[:, None]
            back = (g @ net.out.T) * (hidden > 0)
            dconv, dbias = [], []
            for i, (w, table) in enumerate(zip(WIDTHS, net.conv)):
                part, d = back[:, i * FILTERS:(i + 1) * FILTERS], np.zeros_like(table)
                for k in range(w):
                    np.add.at(d[k], (x[rows, best[i] + k], np.broadcast_to(cols, part.shape)), part)
                dconv.append(d)
                dbias.append(part.sum(0))
            step += 1
            for p, d, a, v in zip(params, [*dconv, *dbias, hidden.T @ g, g.sum(0)], m1, m2):
                a += 0.1 * (d - a)
                v += 0.01 * (d * d - v)
                p -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
    return net


_DIGIT = np.arange(256, dtype=np.uint8)
_DIGIT[48:58] = 48


def _trigrams(buf: np.ndarray) -> np.ndarray:
    """Codes of the byte trigrams along the last axis; digits are all alike."""
    b = _DIGIT[buf].astype(np.int32)
    return b[..., :-2] << 16 | b[..., 1:-1] << 8 | b[..., 2:]


def familiarity(buf: np.ndarray, offs: np.ndarray, seen: np.ndarray, least_bytes: int = 4) -> np.ndarray:
    """Share of each text's byte trigrams that the training windows hold, 1
    for a text without any. A text of 64 bytes and more with fewer than
    ``least_bytes`` different ones is in no language: 0."""
    t = _trigrams(buf) if len(buf) > 2 else np.zeros(0, np.int32)
    known = np.concatenate(([0], np.cumsum(seen[t >> 3] >> (t & 7).astype(np.uint8) & 1, dtype=np.int64)))
    n = np.maximum(np.diff(offs) - 2, 0)
    lo = np.minimum(offs[:-1], len(t))
    share = np.where(n > 0, (known[lo + n] - known[lo]) / np.maximum(n, 1), 1.0)
    size = np.diff(offs)
    kinds = (np.bincount(np.repeat(np.arange(len(size)), size) * 256 + buf, minlength=len(size) * 256).reshape(-1, 256) > 0).sum(1)
    return np.where((size >= 64) & (kinds < least_bytes), 0.0, share)


class Predictor:
    """The network with its filters folded into byte-pair tables."""

    def __init__(self, net: ByteCNN):
        pair = lambda a, b: (a[:, None] + b[None, :]).reshape(65536, -1)
        two, three, four = net.conv
        self.net = net
        self.head = np.hstack([pair(two[0], two[1]), pair(three[0], three[1]), pair(four[0], four[1])])
        self.third, self.tail = three[2], pair(four[2], four[3])

    def __call__(self, x: np.ndarray, step: int = 64) -> np.ndarray:
        net, f, out = self.net, FILTERS, []
        for s in range(0, len(x), step):
            w = x[s:s + step]
            pairs = w[:, :-1].astype(np.int32) * 256 + w[:, 1:]
            z = self.head[pairs]
            z[:, :-1, f:2 * f] += self.third[w[:, 2:]]
            z[:, :-2, 2 * f:] += self.tail[pairs[:, 2:]]
            h = np.hstack([z[:, :WINDOW - n + 1, i * f:(i + 1) * f].max(1) + net.bias[i] for i, n in enumerate(WIDTHS)])
            out.append(_softmax(np.maximum(h, 0) @ net.out + net.out_bias))
        return np.vstack(out) if out else np.zeros((0, len(net.languages)), np.float32)


def has_letters(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        max_docs: int = 3000, per_doc: int = 3) -> ByteCNN:
    """Train on ``per_doc`` windows each of at most ``max_docs`` labelled
    texts, drawn in the order of a hash of the id. Rows without id, letters or
    language are no evidence; without any the network knows no language."""
    n = F.char_length(text_col)
    parts = F.array(*[F.substring(F.col(text_col), (F.greatest(n - WINDOW, F.lit(0)) * i / max(1, per_doc - 1)).cast("int") + 1,
                                  F.lit(WINDOW)) for i in range(per_doc)])
    some = labelled.select(F.col(id_col).alias("i"), F.col(lang_col).alias("lang"), F.col(text_col)).where("lang IS NOT NULL")
    ids = staged(bounded_sample(some.select("i").distinct(), "i", max_docs), "language-sample")  # max_docs ids
    # an id may stand in any number of rows: the first max_docs of them all
    rows = (some.join(F.broadcast(ids), "i").where(has_letters(text_col))
            .select(F.xxhash64("i").alias("h"), "i", "lang", parts.alias("parts")).orderBy("h", "i", "lang", "parts").limit(max_docs).collect())
    languages = sorted({r.lang for r in rows})
    x, y = [], []
    for r in rows:
        for part in dict.fromkeys(r.parts):
            for _, _, buf, offs in text_chunks(pa.array([part])):
                x.append(windows(buf, offs)[0][:1])
                y.append(languages.index(r.lang))
    seen = np.zeros(1 << 24, bool)
    for w in x:
        seen[_trigrams(w)] = True
    net = train(np.vstack(x), np.array(y), languages) if len(languages) > 1 else ByteCNN(languages)
    net.seen = np.packbits(seen, bitorder="little")
    return net


def identify(docs: DataFrame, net: ByteCNN, text_col: str = "text", familiar: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the mean probability of the
    prediction, 0 to 1); of equal probabilities the first language, by name.
    ``familiar`` adds a column of that name, the text's ``familiarity``: the
    network must choose a language, this tells a text in none of them.

    Only the text decides. A null, empty or letterless text, and any text
    under a network that knows no language, is ``und`` with score 0; a network
    of one language gives it with score 1. Rows and other columns stay as they
    are (columns named ``lang_pred`` or ``score`` are replaced).
    """
    new = ["lang_pred", "score", *(["familiar"] if familiar else [])]
    seen, net = net.seen if familiar else None, replace(net, seen=None)
    sent = (packed(docs, *new).withColumn("_text", F.col("_row").getField(text_col))
            .withColumn("_letters", has_letters("_text")))
    schema = sent.select("_row").withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0))
    schema = (schema.withColumn("familiar", F.lit(0.0)) if familiar else schema).schema

    def run(batches):
        predict = Predictor(net) if net.conv else None
        names = np.array([*net.languages, UNKNOWN], object)
        for batch in batches:
            lang, score, known = np.full(batch.num_rows, len(net.languages)), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            ok = batch["_letters"].to_numpy(zero_copy_only=False)
            if predict:
                for i, j, buf, offs in text_chunks(batch["_text"], 1 << 17):
                    w, text, covered = windows(buf, offs)
                    total = np.zeros((j - i, len(net.languages)))
                    np.add.at(total, text, predict(w) * covered[:, None])
                    total /= np.maximum(np.diff(offs), 1)[:, None]
                    lang[i:j], score[i:j] = total.argmax(1), total.max(1)
                    if familiar:
                        known[i:j] = familiarity(buf, offs, seen)
            elif net.languages:
                lang[:], score[:] = 0, 1
            lang[~ok], score[~ok] = len(net.languages), 0
            yield pa.RecordBatch.from_arrays(
                [batch["_row"], pa.array(names[lang], pa.string()), pa.array(np.clip(score, 0, 1)), *([pa.array(known)] if familiar else [])],
                ["_row", *new])

    return unpacked(bounded_batches(sent).mapInArrow(run, schema), *new)
