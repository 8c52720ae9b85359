"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the model holds a white-space marker behind another character, nor
a line feed, so pieces cross neither: a text falls into chunks (a run of
markers with the word behind it, or a run of line feeds) whose pieces can be
found one by one. That is checked on the model.

1. All texts: the distinct chunks of each slice, counted; one aggregate gives
   the number of slices that hold each chunk.
2. Chunks that several slices hold are segmented once, by the model, in Spark
   tasks, into the table; the ``table_chunks`` most frequent of those of at most
   ``LONGEST`` bytes are sent to the tasks (at most about 25 MB).
3. All texts again: each slice looks its distinct chunks up, segments once
   those the table lacks (a chunk of one slice only is met here alone), and
   joins the ids by position.

So each chunk of the table is segmented once for the whole corpus, any other
once a slice, whatever the number of its copies. Joining the rest of the table
by a shuffle would move every text with a rare word, more than all else here.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import bounded_batches, packed, ragged, staged, text_chunks, unpacked

MARK = "▁"
LONGEST = 64  # bytes of a chunk in the table
SLICE = 1 << 21
ROWS = 640  # handed to Python at once: a task of encode and decode holds some batches in two workers and in the JVM
IDS = 1 << 18  # decoded at once


@lru_cache(1)
def load(model: str) -> sentencepiece.SentencePieceProcessor:
    """The model, if its pieces keep to chunks and its normaliser only marks
    spaces; else an error."""
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) and (MARK in p.lstrip(MARK) or "\n" in p):
            raise ValueError(f"piece {i} crosses a white-space marker or line feed")
    probe = "  Aé Å é  \t\n "
    if sp.decode(sp.encode(probe)) != probe or sp.encode("x")[:1] != sp.encode(" \nx".strip() or "x")[:1] or not sp.is_byte(sp.encode("\n")[-1]):
        raise ValueError("the model changes texts or has no byte pieces")
    return sp


def cut(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the chunks that the bytes of a slice's texts fall into, and
    the offsets of the texts among them. A chunk starts with a text, at a
    space behind another byte, at a line feed behind another byte and behind
    the last of a run of line feeds."""
    if not len(buf):
        return np.zeros(1, np.int64), np.zeros(len(offs), np.int64)
    space, feed = buf == 32, buf == 10
    new = np.zeros(len(buf) + 1, bool)
    new[1:-1] = (space[1:] & ~space[:-1]) | (feed[1:] != feed[:-1])
    new[offs] = True
    at = np.flatnonzero(new)
    return at, np.searchsorted(at, offs)


def distinct(buf: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct chunks and, for each place, which one stands there."""
    whole = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf))])
    coded = whole.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def segment(sp: sentencepiece.SentencePieceProcessor, chunks: pa.Array) -> list[list[int]]:
    """Ids of each chunk as it stands inside a text. A line feed in front
    takes the marker that the model puts before a text; both are cut off."""
    texts = ["\n" + c.decode() for c in chunks.to_pylist()]
    return [ids[2:] for ids in sp.encode(texts, num_threads=1)] if texts else []


def _marked(text_col: str):
    """The text as the model normalises it: a marker in front, all as spaces."""
    text = F.regexp_replace(F.col(text_col), MARK, " ")
    return F.when(text != "", F.concat(F.lit(" "), text)).otherwise("")


def chunk_table(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """(``chunk``, ``n``, ``ids``): chunks that at least two slices hold, the
    number of those slices, and the pieces. Each is segmented once."""
    def count(batches):
        for batch in batches:
            for _, _, buf, offs in text_chunks(batch["_text"], SLICE, lower=False):
                found = distinct(buf, cut(buf, offs)[0])[0].cast(pa.binary())
                yield pa.RecordBatch.from_arrays([found.filter(pc.less_equal(pc.binary_length(found), LONGEST))], ["chunk"])

    def ids(batches):
        sp = load(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["chunk"], batch["n"], pa.array(segment(sp, batch["chunk"]), pa.list_(pa.int32()))], ["chunk", "n", "ids"])

    seen = bounded_batches(docs).select(_marked(text_col).alias("_text")).mapInArrow(count, "chunk binary")
    often = seen.groupBy("chunk").agg(F.count("*").alias("n")).where("n > 1")
    return staged(often.mapInArrow(ids, "chunk binary, n long, ids array<int>"), "chunk-table")


class _Table:
    """Pieces of known chunks, and of others once segmented."""

    def __init__(self, model: str, chunks: pa.Array, ids: np.ndarray, offs: np.ndarray):
        self.sp, self.chunks, self.ids, self.offs = load(model), chunks, ids, offs

    def pieces(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks, one after another, and their offsets."""
        found = pc.index_in(chunks, self.chunks) if len(self.chunks) else pa.nulls(len(chunks), pa.int32())
        rare = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
        own = segment(self.sp, chunks.take(pa.array(rare)))
        where = found.fill_null(0).to_numpy().astype(np.int64)
        where[rare] = len(self.chunks) + np.arange(len(rare))
        lens = np.concatenate((np.diff(self.offs), np.array([len(x) for x in own], np.int64)))
        starts = np.concatenate((self.offs[:-1], self.offs[-1] + np.cumsum(lens[len(self.chunks):]) - lens[len(self.chunks):]))
        flat = np.concatenate((self.ids, np.array([i for x in own for i in x], np.int32)))
        at, offs = ragged(starts[where], lens[where])
        return flat[at], offs


def encode(docs: DataFrame, model: str, text_col: str = "text", table_chunks: int = 1 << 17, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``ids``, the pieces of the whole text as the sentencepiece
    library encodes it, without begin and end.

    Null and empty texts have no ids. Rows stand for themselves; repeated rows,
    other columns and empty tables pass, a column named ``ids`` is replaced.
    ``keep_text`` off drops the text column. ``model`` is a path that every
    executor can read. ``table_chunks`` bounds what is sent to the tasks; the
    result does not depend on it.
    """
    table = chunk_table(docs, model, text_col).orderBy(F.desc("n"), "chunk").limit(table_chunks).toArrow()
    known = table["chunk"].combine_chunks().cast(pa.large_binary())
    lists = table["ids"].combine_chunks()
    flat, bounds = lists.flatten().to_numpy().astype(np.int32), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy()))).astype(np.int64)
    sent = packed(docs, "ids").withColumn("_text", F.col("_row").getField(text_col)).withColumn("_text", _marked("_text"))
    if not keep_text:
        sent = sent.withColumn("_row", F.col("_row").dropFields(f"`{text_col}`"))
    schema = sent.select("_row", F.expr("cast(array() as array<int>)").alias("ids")).schema

    def run(batches):
        own = _Table(model, known, flat, bounds)
        for batch in batches:
            for i, j, buf, offs in text_chunks(batch["_text"], SLICE, lower=False):
                at, texts = cut(buf, offs)
                chunks, code = distinct(buf, at)
                ids, per = own.pieces(chunks)
                places, ends = ragged(per[:-1][code], np.diff(per)[code])
                lists = pa.ListArray.from_arrays(pa.array(ends[texts].astype(np.int32)), pa.array(ids[places]))
                yield pa.RecordBatch.from_arrays([batch["_row"].slice(i, j - i), lists], ["_row", "ids"])

    return unpacked(bounded_batches(sent, ROWS).mapInArrow(run, schema), "ids")


def decode(rows: DataFrame, model: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of ``ids_col`` as the sentencepiece library
    decodes it: pieces joined, markers as spaces, the one in front dropped.
    Ids outside the model are an error. Null and empty lists give an empty
    text; an existing ``out_col`` is replaced."""
    sent = packed(rows, out_col)
    whole = dict(rows.dtypes).get(ids_col) == "array<int>"  # then the row's own list is read, not sent twice
    if not whole:
        sent = sent.withColumn("_ids", F.col("_row").getField(ids_col).cast("array<int>"))
    schema = sent.select("_row", F.lit("").alias(out_col)).schema

    def run(batches):
        sp = load(model)
        size = sp.get_piece_size()
        byte = np.array([sp.is_byte(i) for i in range(size)])
        part = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if byte[i] else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(size)]
        # rows with these need the library: controls, unknown pieces, bytes of longer characters
        other = np.array([sp.is_control(i) or sp.is_unknown(i) or (byte[i] and part[i] >= b"\x80") for i in range(size)])
        marked = np.array([sp.id_to_piece(i).startswith(MARK) for i in range(size)])
        data = np.frombuffer(b"".join(part), np.uint8)
        lens = np.array([len(p) for p in part], np.int64)
        starts = np.cumsum(lens) - lens
        for batch in batches:
            col = batch["_row"].field(ids_col) if whole else batch["_ids"]
            n = np.where(col.is_null().to_numpy(zero_copy_only=False), 0, col.value_lengths().fill_null(0).to_numpy())
            ids, ends = col.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(n)))
            if len(ids) and (ids.min() < 0 or ids.max() >= size):
                raise ValueError("an id outside the model")
            lo = 0
            while lo < len(n):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + IDS, "right")) - 1)
                own, off = ids[ends[lo]:ends[hi]], ends[lo:hi + 1] - ends[lo]
                some = off[1:] > off[:-1]
                head = np.zeros(len(own), np.int64)
                head[off[:-1][some]] = marked[own[off[:-1][some]]]
                at, to = ragged(starts[own] + head, lens[own] - head)
                text = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(to[off]), pa.py_buffer(data[at])])
                rare = np.flatnonzero(np.add.reduceat(np.append(other[own], False), off[:-1]) * some) if hi > lo else []
                if len(rare):
                    fixed = text.to_pylist()
                    for r in rare:
                        fixed[r] = sp.decode(own[off[r]:off[r + 1]].tolist()).encode()
                    text = pa.array(fixed, pa.large_binary())
                yield pa.RecordBatch.from_arrays([batch["_row"].slice(lo, hi - lo), text.cast(pa.string())], ["_row", out_col])
                lo = hi

    return unpacked(bounded_batches(sent, ROWS).mapInArrow(run, schema), out_col)
