"""Empirical-Bayes host reputation.

Labelled page outcomes are shrunk through beta-binomial priors, suffix towards
the corpus, registered domain towards its suffix, host towards its domain: a
level's prior has its parent's posterior mean and a concentration fitted to
the spread of that level by weighted moments. A page is blocked when the lower
bound of its host's posterior exceeds ``max_bad``; a host without labels
inherits its domain's, suffix's or the corpus's estimate. Fixed rules come
first: the longest matching one decides.

Pages are read twice (outcomes, verdicts). Statistics are partial aggregates,
one row per host, so a hot host is no hot key; verdicts come back by a join
on the host of a staged table, whose page side AQE can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import UPPER, staged

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
# under a country's two letters these labels are no owner's name, so the suffix has two labels
SECOND_LEVEL = ("ac", "co", "com", "edu", "gob", "gouv", "gov", "go", "ltd", "me", "mil", "net", "ne", "nom", "or", "org", "plc", "sch")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest fitting rule, null if none fits."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: (len(r[1]), r[1], r[0])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def _levels(df: DataFrame, suffixes=()) -> DataFrame:
    """``domain`` and ``suffix`` of ``host`` (a port is ignored). The longest
    of the ``suffixes`` that ends the host, of at most four labels, else by
    rule one or two labels. An address in numbers is all of them."""
    second = ",".join(f"'{s}'" for s in SECOND_LEVEL)
    listed = sorted({s.strip(". ").lower() for s in suffixes})
    df = (df.withColumn("_h", F.regexp_replace("host", ":[0-9]*$", "")).withColumn("_l", F.split("_h", "[.]"))
          .withColumn("_n", F.expr(f"IF(size(_l) > 1 AND length(_l[size(_l) - 1]) = 2 AND _l[size(_l) - 2] IN ({second}), 2, 1)")))
    last = lambda n: F.expr(f"array_join(slice(_l, -least({n}, size(_l)), {n}), '.')")
    for n in range(1, 5):
        some = [s for s in listed if s.count(".") == n - 1]
        if some:
            df = df.withColumn("_n", F.when(last(n).isin(some) & (F.size("_l") >= n), n).otherwise(F.col("_n")))
    number = F.expr(r"_h RLIKE '^[0-9]+([.][0-9]+){3}$' OR startswith(_h, '[')")
    return (df.withColumn("suffix", F.when(number, F.col("_h")).otherwise(last("_n")))
            .withColumn("domain", F.when(number, F.col("_h")).otherwise(last("(_n + 1)")))
            .drop("_h", "_l", "_n"))


def _concentration(groups: DataFrame) -> float:
    """The beta-binomial concentration of group rates (n, k) about their
    parent rate p, by weighted moments, between 1 and 1e6."""
    s = groups.agg(
        F.sum("n").alias("n"), F.sum(F.expr("cast(n as double) * n")).alias("nn"), F.count("*").alias("g"),
        F.sum(F.expr("n * p * (1 - p)")).alias("v"), F.sum(F.expr("n * (k / n - p) * (k / n - p)")).alias("between")).first()
    if not s.n:
        return 1e6
    v = s.v / s.n
    within = v * (s.n - s.nn / s.n - (s.g - 1))
    rho = (s.between - v * (s.g - 1)) / within if within else 0.0
    return 1 / min(max(rho, 1e-6), 0.5) - 1


def host_reputation(outcomes: DataFrame, suffixes=()) -> tuple[DataFrame, tuple[float, float] | None]:
    """``outcomes``: (host, bad 0/1 or null). One row per suffix, domain and
    host that has outcomes: ``level``, ``name``, ``rate`` (posterior mean of
    bad) and ``strength`` (its beta parameters' sum); and the corpus's (rate,
    strength), None without any outcome. Null outcomes are no evidence. Only
    sums over a level reach the driver."""
    per = (_levels(outcomes.where("bad IS NOT NULL"), suffixes)
           .groupBy("host", "domain", "suffix").agg(F.count("*").alias("n"), F.sum("bad").alias("k")))
    per = staged(per, "hosts")
    top = per.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    corpus = ((top.k + 0.5) / (top.n + 1.0), top.n + 1.0) if top.n else None
    out, parent = [], None
    for level, up in (("suffix", None), ("domain", "suffix"), ("host", "domain")):
        g = per.groupBy(level, *([up] if up else [])).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        g = g.join(parent, up) if up else g.withColumn("p", F.lit(corpus[0] if corpus else None).cast("double"))
        g = staged(g, f"level-{level}")
        m = _concentration(g)
        g = g.select(F.col(level).alias("name"), F.expr(f"(k + {m!r}D * p) / (n + {m!r}D)").alias("rate"),
                     F.expr(f"n + {m!r}D").alias("strength"))
        out.append(g.withColumn("level", F.lit(level)))
        parent = g.select(F.col("name").alias(level), F.col("rate").alias("p"))
    return out[0].unionByName(out[1]).unionByName(out[2]), corpus


def judge_urls(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url",
               rules=RULES, max_bad: float = 0.5, z: float = 1.645, suffixes=()) -> DataFrame:
    """One row per page: ``id_col``, host, path, rule, verdict, and the host's
    ``bad_bound`` (lower posterior bound of its bad rate; null when nothing is
    labelled at all, which allows).

    ``outcomes`` holds (host, bad); ``suffixes`` may list the names of a public
    suffix table (some ten thousand). A null url or one without ``://`` has
    empty host and path. Repeated pages and labels count as often as they
    occur; other columns are ignored. An empty table gives an empty one.
    """
    rep, corpus = host_reputation(outcomes, suffixes)
    rep = staged(rep, "reputation")
    url = F.col(url_col)
    p = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, action = match_rule(F.col("host"), F.col("path"), rules)
    # one row per distinct host carries the fallback through the levels
    hosts = _levels(p.select("host").distinct(), suffixes)
    for level in ("host", "domain", "suffix"):
        hosts = hosts.join(rep.where(F.col("level") == level).select(
            F.col("name").alias(level), F.struct("rate", "strength").alias(f"_{level}")), level, "left")
    rate, strength = corpus or (None, None)
    top = F.when(F.lit(corpus is not None), F.struct(F.lit(rate).cast("double").alias("rate"), F.lit(strength).cast("double").alias("strength")))
    hosts = staged(hosts.withColumn("_r", F.coalesce("_host", "_domain", "_suffix", top)).select(
        "host", F.expr(f"_r.rate - {z}D * sqrt(_r.rate * (1 - _r.rate) / (_r.strength + 1))").alias("bad_bound")), "verdicts")
    own = F.when(F.coalesce(F.col("bad_bound") > max_bad, F.lit(False)), "block").otherwise("allow")
    return (p.withColumn("rule", rule).withColumn("_action", action).join(hosts, "host", "left")
            .select(id_col, "host", "path", "rule", F.coalesce("_action", own).alias("verdict"), "bad_bound"))
