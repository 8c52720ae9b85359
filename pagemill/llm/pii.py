"""Information-theoretic sanitisation of personal data, all in SQL functions.

Base spans (email, ip, card, phone) are found by patterns. Their values are
the protected entities. A term, a lower-cased word near an entity that no base
span overlaps, discloses it when the corpus says so: with document frequencies df over all documents
and n(t, e) the number of distinct contexts of e that hold t,

    pmi(t, e) = ln(n(t, e) * N / (df(t) * df(e))),    ic(e) = ln(N / df(e)),

and pmi / ic is the share of the entity's information that the term gives
away. At ``remove_at`` or more the term is removed from documents of that
entity, at ``generalise_at`` it is generalised. A term needs ``min_contexts``
distinct contexts: words that appear once, or only in copies of one passage,
are no evidence.

Only documents with entities, their entities and their nearby terms are ever
shuffled; the corpus-wide count of those terms passes every document's words
through a fixed-size bit filter first. Patterns are single possessive runs,
so no text makes the regex engine backtrack or recurse: separators that stand
between two run characters are first turned into one marker character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import BitFilter, lower_ascii, packed, staged, unpacked

KINDS = ("email", "ip", "card", "phone")
_SPACE, _NOT_SPACE = r"[\\x20\\x09-\\x0D]", r"[^\\x20\\x09-\\x0D]"
_MARK = r"\\u0001"
# dots of a domain and separators of a card number, where they count, become the mark
_PREPARED = {
    "email": rf"regexp_replace(translate({{t}}, '\u0001', '\u0002'), '(?<=[A-Za-z0-9-])\\.(?=[A-Za-z0-9-])', '\u0001')",
    "ip": "{t}",
    "card": rf"regexp_replace(translate({{t}}, '\u0001', '\u0002'), '(?<=[0-9])[\\x20-](?=[0-9])', '\u0001')",
    "phone": "{t}",
}
_PATTERN = {
    "email": rf"(?:\\G|(?<![A-Za-z0-9._%+\\x01-]))[A-Za-z0-9._%+\\x01-]++@[A-Za-z0-9-]++\\x01[A-Za-z0-9\\x01-]++",
    "ip": r"(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": r"[0-9][0-9\\x01]++",
    "phone": r"\\+[0-9][\\x20().0-9-]+(?<=[0-9])(?<!\\+[0-9])",
}
_NEEDS = {"email": "instr({t}, '@') > 0", "ip": r"{t} RLIKE '[0-9]\\.[0-9]'", "card": "{t} RLIKE '[0-9]'", "phone": "instr({t}, '+') > 0"}
_VALID = {
    "email": "true",
    "ip": r"forall(split(x.v, '[.]'), p -> length(regexp_replace(p, '^0+', '')) <= 3 AND coalesce(try_cast(p AS decimal(38,0)), 0) <= 255)",
    "card": r"length(regexp_replace(x.v, '[^0-9]', '')) BETWEEN 14 AND 19 AND aggregate(split(reverse(regexp_replace(x.v, '[^0-9]', '')), ''), "
            "named_struct('s', 0, 'd', false), (a, c) -> IF(c = '', a, named_struct('s', a.s + IF(a.d, 2 * int(c) - IF(int(c) > 4, 9, 0), int(c)), 'd', NOT a.d)), "
            "a -> a.s % 10 = 0)",
    "phone": r"length(regexp_replace(x.v, '[^0-9]', '')) BETWEEN 10 AND 15",
}
_HOLE = r"'\u0003'"
SPAN = "array<struct<s: bigint, e: bigint, k: int, v: string>>"


def _found(text: str, pattern: str, rank: int, original: str) -> str:
    """SQL: spans of all matches of ``pattern`` in ``text``. Matches and the
    pieces between them give the positions; the value is ``original``'s."""
    return (f"aggregate(zip_with(split({text}, {pattern}, -1), regexp_extract_all({text}, {pattern}, 0), "
            "(p, m) -> named_struct('p', p, 'm', m)), "
            f"named_struct('at', 0L, 'out', cast(array() AS {SPAN})), (a, x) -> IF(x.m IS NULL, a, named_struct("
            "'at', a.at + length(x.p) + length(x.m), 'out', concat(a.out, array(named_struct("
            f"'s', a.at + length(x.p), 'e', a.at + length(x.p) + length(x.m), 'k', {rank}, "
            f"'v', substring({original}, int(a.at + length(x.p) + 1), length(x.m))))))), a -> a.out)")


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """Adds ``_base``: base spans by start, then kind. Null text is empty."""
    for i, k in enumerate(KINDS):
        # the prepared text in its own projection: computed once for documents that need it
        df = df.withColumn(f"_p_{k}", F.expr(f"CASE WHEN {_NEEDS[k].format(t=text)} THEN {_PREPARED[k].format(t=text)} END"))
    for i, k in enumerate(KINDS):
        df = df.withColumn(f"_s_{k}", F.expr(
            f"CASE WHEN _p_{k} IS NOT NULL THEN filter({_found(f'_p_{k}', repr_sql(_PATTERN[k]), i, text)}, x -> {_VALID[k]}) "
            f"ELSE cast(array() AS {SPAN}) END"))
    return (df.withColumn("_base", F.expr("array_sort(concat(" + ", ".join(f"_s_{k}" for k in KINDS) + "))"))
            .drop(*[f"_p_{k}" for k in KINDS], *[f"_s_{k}" for k in KINDS]))


def repr_sql(pattern: str) -> str:
    return "'" + pattern + "'"


def joined(spans: str, names: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.expr(f"array_join(transform({spans}, x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')")


def _entity(x: str = "x") -> str:
    """A protected entity: its kind and its value without case and separators."""
    return (f"concat({x}.k, ':', IF({x}.k = 0, lower({x}.v), IF({x}.k = 1, {x}.v, regexp_replace({x}.v, '[^0-9]', ''))))")


def _blanked(text: str, spans: str) -> str:
    """``text`` with every base span turned into as many ``_HOLE`` marks."""
    return (f"aggregate({spans}, named_struct('at', 0L, 'out', ''), (a, x) -> IF(x.e <= a.at, a, named_struct('at', x.e, 'out', concat(a.out, "
            f"substring({text}, int(a.at) + 1, int(greatest(x.s - a.at, 0))), repeat({_HOLE}, int(x.e - greatest(x.s, a.at)))))), "
            f"a -> concat(a.out, substring({text}, int(a.at) + 1, length({text}))))")


def _context(text: str, reach: int) -> str:
    """Distinct words within ``reach`` characters on either side of span x, without
    words cut at the outer edge and words that overlap a base span."""
    left = f"substring({text}, int(greatest(x.s - {reach}, 0)) + 1, int(least(x.s, {reach})))"
    right = f"substring({text}, int(x.e) + 1, {reach})"
    left = f"IF(x.s > {reach}, regexp_replace({left}, '^{_NOT_SPACE}+', ''), {left})"
    right = f"IF(x.e + {reach} < length({text}), regexp_replace({right}, '{_NOT_SPACE}+$', ''), {right})"
    return (f"array_sort(array_distinct(filter(concat(split({left}, '{_SPACE}+'), split({right}, '{_SPACE}+')), "
            f"w -> w <> '' AND instr(w, {_HOLE}) = 0)))")


def disclosing_terms(docs: DataFrame, held: DataFrame, reach: int = 64, min_contexts: int = 3, generalise_at: float = 0.6,
                     remove_at: float = 0.9) -> DataFrame:
    """``docs``: all rows, lower-cased as _low; ``held``: (_low, _base,
    _entities) of those with base spans. Returns (entity, term, action)."""
    held = held.withColumn("_open", F.expr(_blanked("translate(_low, '\\u0003', ' ')", "_base")))
    near = held.select(
        F.explode(F.expr(f"transform(_base, x -> named_struct('entity', {_entity()}, 'words', {_context('_open', reach)}))")).alias("c"),
        F.xxhash64("_low").alias("doc"))
    near = staged(near.select("c.entity", F.explode("c.words").alias("term"), F.xxhash64("c.words").alias("ctx"), "doc"), "pii-contexts")
    pairs = (near.select("entity", "term", "ctx").distinct().groupBy("entity", "term").agg(F.count("*").alias("n"))
             .where(F.col("n") >= min_contexts))
    total = docs.count()
    entities = staged(held.select(F.explode("_entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("df_e"))
                      .where(f"df_e < {total}"), "pii-entities")
    share = lambda df_t: F.expr(f"ln(n * {total}D / ({df_t} * df_e)) / ln({total}D / df_e)")
    words = F.explode(F.expr(f"array_distinct(split(_low, '{_SPACE}+'))")).alias("term")

    def within(texts: DataFrame, terms: DataFrame, name: str) -> DataFrame:
        some = BitFilter(terms, "term").keep(texts.select(words))
        return some.groupBy("term").agg(F.count("*").alias(name)).join(terms, "term", "left_semi")

    # a term is in at least the texts whose contexts hold it, and at least the
    # texts with entities that hold it: pairs whose share stays below the
    # threshold even so are settled without the corpus count
    least = near.select("term", "doc").distinct().groupBy("term").agg(F.count("*").alias("least"))
    pairs = staged(pairs.join(least, "term").join(entities, "entity").where(share("least") >= generalise_at).drop("least"), "pii-pairs")
    least = within(held, staged(pairs.select("term").distinct(), "pii-terms"), "least")
    pairs = staged(pairs.join(least, "term").where(share("least") >= generalise_at).drop("least"), "pii-pairs")
    terms = staged(pairs.select("term").distinct(), "pii-terms")
    counts = within(docs, terms, "df_t")
    return (pairs.join(staged(counts, "pii-counts"), "term").withColumn("share", share("df_t"))
            .where(F.col("share") >= generalise_at)
            .select("entity", "term", F.when(F.col("share") >= remove_at, 2).otherwise(1).alias("action")))


def sanitise(docs: DataFrame, text_col: str = "text", reach: int = 64, min_contexts: int = 3,
             generalise_at: float = 0.6, remove_at: float = 0.9) -> DataFrame:
    """``docs`` with ``spans`` (all spans as structs s, e, k, v: code points,
    end exclusive, k an index into ``span_kinds()``) and ``sanitised`` text
    added or replaced: base spans become their kind in brackets, generalised
    terms ``[term]``, removed ones nothing; where spans overlap the first
    counts. Rows and other columns stay as they are.

    A null text counts as empty: no spans, and ``sanitised`` is empty. Repeated
    rows count as documents of their own, their contexts once. An empty table
    stays empty. Terms apply to documents that hold the entity they disclose.
    """
    text = F.coalesce(F.col("_row").getField(text_col), F.lit("")).alias("_text")
    d = base_spans(packed(docs, "spans", "sanitised").select("_row", text), "_text")
    d = d.withColumn("_entities", F.expr(f"CASE WHEN size(_base) > 0 THEN array_sort(array_distinct(transform(_base, x -> {_entity()}))) END"))
    low = lower_ascii(F.col("_text"))
    # spans are searched for twice: for the documents that hold any, written once, and for the others
    held = staged(d.where("_entities IS NOT NULL").select("_row", "_base", "_entities"), "pii-held").select("*", text)
    terms = staged(disclosing_terms(packed(docs).select(text).select(low.alias("_low")), held.select(low.alias("_low"), "_base", "_entities"),
                                    reach, min_contexts, generalise_at, remove_at), "pii-disclosing")
    # the terms of each set of entities that one document holds
    sets = (held.select("_entities").distinct().withColumn("entity", F.explode("_entities"))
            .join(terms, "entity").groupBy("_entities")
            .agg(F.collect_set("term").alias("_all"), F.collect_set(F.when(F.col("action") == 2, F.col("term"))).alias("_gone")))
    sets = staged(sets, "pii-sets")
    # texts without entities take no part in the join
    d = (held.join(sets, "_entities", "left").select("_row", "_text", "_base", "_all", "_gone")
         .unionByName(d.where("_entities IS NULL").select("_row", "_text", "_base", F.expr("cast(NULL AS array<string>) AS _all"),
                                                          F.expr("cast(NULL AS array<string>) AS _gone"))))
    pattern = (f"concat('(?<!{_NOT_SPACE})(?:', array_join(transform(array_sort(_all), w -> concat('\\\\Q', replace(w, '\\\\E', '\\\\E\\\\\\\\E\\\\Q'), '\\\\E')), '|'), "
               f"')(?!{_NOT_SPACE})')")
    d = (d.withColumn("_low", F.when(F.col("_all").isNotNull(), low)).withColumn("_pat", F.expr(f"CASE WHEN _all IS NOT NULL THEN {pattern} END"))
         .withColumn("_terms", F.expr(
             f"CASE WHEN _all IS NOT NULL THEN transform({_found('_low', '_pat', 4, '_low')}, "
             f"x -> named_struct('s', x.s, 'e', x.e, 'k', IF(array_contains(_gone, x.v), 5, 4), 'v', x.v)) ELSE cast(array() AS {SPAN}) END"))
         .withColumn("spans", F.expr("array_sort(concat(_base, _terms))"))
         .withColumn("sanitised", F.expr(
             "CASE WHEN size(spans) = 0 THEN _text ELSE aggregate(spans, named_struct('at', 0L, 'out', ''), (a, x) -> IF(x.s < a.at, a, "
             "named_struct('at', x.e, 'out', concat(a.out, substring(_text, int(a.at) + 1, int(x.s - a.at)), "
             "CASE x.k WHEN 0 THEN '[email]' WHEN 1 THEN '[ip]' WHEN 2 THEN '[card]' WHEN 3 THEN '[phone]' WHEN 4 THEN '[term]' ELSE '' END))), "
             "a -> concat(a.out, substring(_text, int(a.at) + 1, length(_text)))) END")))
    return unpacked(d, "spans", "sanitised")


def span_kinds() -> str:
    """SQL array of kind names, indexed by a span's k."""
    return "array('email', 'ip', 'card', 'phone', 'term', 'term')"
