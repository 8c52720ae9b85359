"""Model replies as a table, joined to the rows that asked.

The original calls the model once per row. Here the prompts are a column,
replies come back as a table ``(key, response_text, status)`` and are
attached with one left equi-join; a missing reply is the "no model" case.

Scale: replies are reduced to one per key with a partial aggregate (map-side
combine, so a key with millions of replies still ships one row per map task).
The join must not reuse that aggregate's partitioning: Spark splits a hot
request key only where both sides of the join are plain exchanges, so the
reduced replies are exchanged once more (``_KEY``). Replies of two steps for the same rows are attached
by ONE join (``attach_reply_pair``): with two joins on one key Spark would
reuse the first one's partitioning for the second and leave a hot request
key unsplit; with one, AQE splits it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table

# the key behind an expression whose partitioning Spark does not track
_KEY = "element_at(array(_rkey), 1) AS _rkey"


def _best(responses: DataFrame, when: str = "true") -> F.Column:
    """The reply that counts: a good one before an error, then the latest
    ``seq`` (when the table has one), then the smallest text. One struct holds
    order and value, so the text is shuffled once."""
    seq = "coalesce(-seq, 9223372036854775807L)" if "seq" in responses.columns else "0L"
    return F.expr(f"min(named_struct('r', IF(status = 'ok' AND response_text IS NOT NULL, 0, 1), 'q', {seq}, "
                  f"'t', response_text, 's', status)) FILTER (WHERE {when})")


def one_reply_per_key(responses: DataFrame, key: str = "key") -> DataFrame:
    """Keep one reply per key (see ``_best``)."""
    return (responses.groupBy(F.col(key).alias("_rkey")).agg(_best(responses).alias("_reply"))
            .selectExpr(_KEY, "_reply.t AS _rtext", "_reply.s AS _rstatus"))


def attach_replies(df: DataFrame, responses: DataFrame | tuple[str, str] | None, key: str) -> DataFrame:
    """Add ``_rtext`` and ``_rstatus`` ('no_model' when no reply).
    ``responses`` may name the (text, status) columns that
    ``attach_reply_pair`` added."""
    if responses is None:
        return df.selectExpr("*", "CAST(NULL AS STRING) AS _rtext", "'no_model' AS _rstatus")
    if isinstance(responses, tuple):
        text, status = responses
        return df.selectExpr("*", f"`{text}` AS _rtext", f"coalesce(`{status}`, 'no_model') AS _rstatus")
    r = one_reply_per_key(responses)
    j = df.join(r, df[key] == r["_rkey"], "left").drop("_rkey")
    return j.selectExpr(*[f"`{c}`" for c in df.columns], "_rtext",
                        "coalesce(_rstatus, 'no_model') AS _rstatus")


PAIR = [("_analysis_text", "_analysis_status"), ("_article_text", "_article_status")]


def attach_reply_pair(df: DataFrame, first: DataFrame | None, second: DataFrame | None, key: str) -> DataFrame:
    """Attach the replies of both model steps with one join; pass ``PAIR[0]``
    and ``PAIR[1]`` as the ``responses`` of the steps. A missing table is the
    "no model" case for its step."""
    null = "CAST(NULL AS STRING)"
    sides = [(i, r) for i, r in enumerate((first, second)) if r is not None]
    if not sides:
        return df.selectExpr("*", *[f"{null} AS {c}" for pair in PAIR for c in pair])
    seq = any("seq" in r.columns for _, r in sides)
    rows = None
    for i, r in sides:
        part = r.selectExpr("key AS _rkey", "response_text", "status", f"{i} AS _step",
                            ("CAST(seq AS BIGINT)" if "seq" in r.columns else "CAST(NULL AS BIGINT)") + " AS seq")
        rows = part if rows is None else rows.unionByName(part)
    if not seq:
        rows = rows.drop("seq")
    best = rows.groupBy("_rkey").agg(*[_best(rows, f"_step = {i}").alias(f"_b{i}") for i in (0, 1)])
    cols = [_KEY] + [f"_b{i}.{f} AS {c}" for i, pair in enumerate(PAIR) for f, c in zip("ts", pair)]
    j = df.join(best.selectExpr(*cols), df[key] == F.col("_rkey"), "left")
    return j.selectExpr(*[f"`{c}`" for c in df.columns], *[c for pair in PAIR for c in pair])


def replies_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies keyed by conversation: the first assistant turn of each."""
    conv = read_table(spark, sf_dir, "conversations")
    return (conv.where("role = 'assistant'")
            .groupBy("conv_id")
            .agg(F.expr("min_by(text, turn)").alias("response_text"))
            .selectExpr("conv_id AS key", "response_text", "'ok' AS status"))
