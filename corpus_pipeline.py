"""Corpus pipeline: from raw documents to a training mix.

``STAGES`` are applied in order; each works on all that its predecessor kept,
is written as a table in the shared folder and reread, so a lost executor
never costs more than the stage at hand. All stages but the last return the
columns of ``documents``; rows keep their place in no order.

Rows that repeat an id are told apart by their text; null ids, texts and
sources, empty tables and extra columns pass through every stage as its
operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import decontam, langid, line_dedup, minhash, mixing
from pagemill.llm.common import BitFilter, read_table, staged, without

# below this no language stands out; a text of two languages scores about 0.5
MIN_LANGUAGE_SCORE = 0.35
# share of a text's byte trigrams that the training texts hold: held-out texts of
# the learned languages have 0.87 and more (99 of 100 have 0.97), Hungarian 0.52,
# code 0.29, random consonants 0.11, Latin 0.65, other scripts none
MIN_FAMILIARITY = 0.75


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_key", F.xxhash64("doc_id", "text"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language the byte network, trained on a bounded
    sample of those with a language, tells with enough certainty. Texts
    without letters go, and those in none of the learned languages: the network
    must name one of them, so how familiar a text's bytes are decides. Without
    any labelled text nothing is known and nothing stays."""
    net = langid.fit(docs)
    judged = langid.identify(docs, net, familiar=True)
    good = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE) & (F.col("familiar") >= MIN_FAMILIARITY)
    return judged.where(good).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that are boilerplate of their source; no document goes."""
    out = line_dedup.drop_boilerplate(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that with the
    smallest id, and one of rows that repeat id and text."""
    found = staged(minhash.near_duplicates(docs), "near-duplicates")
    gone = staged(found.where("NOT kept").select("doc_id", "text_hash"), "near-gone")
    again = staged(found.where("kept").groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash"), "near-again")
    key = F.xxhash64("doc_id", "text_hash").alias("_key")
    rows = docs.withColumn("_key", F.xxhash64("doc_id", F.xxhash64("text")))
    maybe, clear = BitFilter(gone.unionByName(again).select(key), "_key").split(rows)
    kept = maybe.join(gone.select(key), "_key", "left_anti").dropDuplicates(["doc_id", "text"])
    return clear.unionByName(kept).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a window close to a benchmark item."""
    rows = _keyed(docs)
    leaks = decontam.find_leaks(rows, read_table(spark, sf_dir, "benchmark"), id_col="_key")
    return without(rows, staged(leaks.select("_key").distinct(), "leaks")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with ``size`` and ``taken`` (words drawn,
    repeats counted), their source's ``source_size`` and ``target``. Rows of
    which the mix takes nothing go."""
    own = staged(docs.withColumn("size", mixing.word_count("text")).withColumn("_sources", F.array("source")), "mix-sized")
    mixed = mixing.mix(own, sources_col="_sources")
    return mixed.where("taken > 0").select(*[c for c in docs.columns if c not in ("size", "source_size", "target", "taken")],
                                           "size", "source_size", "target", "taken")


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("mixture", mixture)]

# the trained network and seeded windows can't be expressed in SQL; tests compare each stage with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
