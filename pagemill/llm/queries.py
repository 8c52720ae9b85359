"""The registered queries of the training-data operators.

Each applies its operator, with production parameters, to the whole table and
derives compact columns (ids, counts, digests) from the operator's output.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import (decontam, exact_dedup, langid, line_dedup, merkle, minhash, mixing, periodic, pieces, pii, substring,
                          toxicity, url_filter)
from pagemill.llm.common import read_table, staged
from pagemill.llm.oracles import ORACLE  # noqa: F401

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(host, bad) per labelled page: a page shows the document whose id is
    the number at the end of its url's path; low quality or toxic is bad."""
    labels = read_table(spark, sf_dir, "labels").select(
        "doc_id", F.expr("CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN toxic = 0 OR quality = 1 THEN 0 END").alias("bad"))
    url = F.col("url")
    pages = read_table(spark, sf_dir, "pages").select(
        url_filter.host_of(url).alias("host"),
        F.regexp_extract(url_filter.path_of(url), r"/([0-9]{1,18})[^/]*$", 1).try_cast("long").alias("doc_id"))
    return pages.join(labels, "doc_id").select("host", "bad")


@query
def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), page_outcomes(spark, sf_dir)).select(
        "page_id", "host", "path", "rule", "verdict")


@query
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"), digest_all=True)


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_boilerplate(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


@query
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", F.array("source").alias("sources"), mixing.word_count("text").alias("size"), F.xxhash64("text").alias("text_hash"))
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@query
def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents")).drop("text_hash")


def remainder(n: int):
    """crc32 of the document id as text, modulo ``n``: the fold of a row."""
    return F.crc32(F.col("doc_id").cast("string")) % n


@query
def op7_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    net = langid.fit(docs.where(remainder(3) != 1))
    return langid.identify(docs.select("doc_id", "text"), net).select(
        "doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic").where(remainder(4) != 2)
    model = toxicity.fit(docs, labels)
    return toxicity.score_toxicity(docs, model).select(
        "doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op6_simhash_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.sanitise(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds, n = pii.span_kinds(), [F.expr(f"cast(size(filter(spans, x -> x.k = {i})) as long)").alias(f"n_{k}")
                                  for i, k in enumerate(pii.KINDS)]
    return out.select("doc_id", *n, F.sha2(pii.joined("filter(spans, x -> x.k < 4)", kinds), 256).alias("base_sha256"),
                      pii.joined("spans", kinds).alias("spans"))


@query
def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(read_table(spark, sf_dir, "documents"), every_pair=True)


@query
def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    ids = pieces.encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"), model, keep_text=False)
    return pieces.decode(ids, model).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    leaf = lambda n: merkle.leaf_digest(*map(F.col, ("doc_id", "source", "lang")), n, F.col("text"))
    tampered = F.coalesce(remainder(7) == 0, F.lit(False))
    rows = docs.select("doc_id", "lang", leaf(F.col("n_chars")).alias("leaf"),
                       F.when(tampered, leaf(F.col("n_chars") + 1)).alias("tampered"))
    out = merkle.manifest(rows)
    return (out.withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("path")))
            .select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")), 256).alias("proof_sha256"),
                    "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")))


def planted(text: str, key: str):
    """The text's words, those of a tenth of the documents made periodic from
    a word on, both chosen by a hash of the document id."""
    words = f"filter(split(coalesce({text}, ''), '[ \\\\t-\\\\r]+', -1), x -> x <> '')"
    place = ("transform(array(named_struct('w', {w}, 'g', crc32(cast({k} as string)) div 10)), d -> named_struct('w', d.w, 'g', d.g, "
             "'a', int(d.g % size(d.w))))[0]")
    again = ("transform(array({p}), d -> transform(array(1 + int((size(d.w) - d.a) div (3 + d.g % 8))), p -> array_join(transform("
             "sequence(0, size(d.w) - 1), i -> d.w[IF(i < d.a, i, d.a + (i - d.a) % p)]), ' '))[0])[0]")
    made = again.format(p=place.format(w=words, k=key))
    return F.expr(f"CASE WHEN crc32(cast({key} as string)) % 10 = 0 AND {text} RLIKE '[^ \\\\t-\\\\r]' THEN {made} ELSE {text} END")


@query
def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", planted("text", "doc_id").alias("text"))
    best = F.expr("array_sort(runs, (x, y) -> CASE WHEN x.length * y.period > y.length * x.period THEN -1 "
                  "WHEN x.length * y.period < y.length * x.period THEN 1 WHEN x.start <> y.start THEN IF(x.start < y.start, -1, 1) "
                  "WHEN x.period <> y.period THEN IF(x.period < y.period, -1, 1) ELSE 0 END)[0]")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, chr(10))), '')")
    out = periodic.periodic_runs(docs).withColumn("b", F.when(F.size("runs") > 0, best))
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "b.start", "b.length", "b.period",
                      F.expr("1000 * b.length div b.period").alias("exponent_milli"),
                      F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
