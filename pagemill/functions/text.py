"""Text helpers with Python ``str`` semantics, as Spark SQL expressions.

Builders named ``*_sql`` take SQL expression text and return SQL text; the
thin Column wrappers parse it once with ``F.expr``. Expressions are built as
text because constructing a large expression call by call through the
Python API costs one driver round trip per node.

Catalyst copies a sub-expression wherever it is referenced, so a value used
more than once is bound with :func:`let` (a one-element ``transform``) and
evaluated once.
"""

from __future__ import annotations

import html.entities
import itertools
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip()/str.split() treat as
# whitespace (str.isspace over the BMP), as a Java/RE2 character class.
WS_CLASS = (r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
WS_NO_NL = (r"[\x{09}\x{0b}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
STRIP_RE = f"^{WS_CLASS}+|{WS_CLASS}+\\z"
# the same set as characters, by rule (every BMP character str.isspace accepts)
WS_CHARS = "".join(ch for ch in map(chr, range(0x10000)) if ch.isspace())

_ids = itertools.count(1)


def var(prefix: str = "v") -> str:
    """A fresh lambda variable name."""
    return f"{prefix}{next(_ids)}"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value_sql: str, body) -> str:
    """Evaluate ``value_sql`` once and use it in ``body(name)``."""
    v = var("l")
    return f"transform(array({value_sql}), {v} -> {body(v)})[0]"


def expr(sql: str) -> Column:
    return F.expr(sql)


# ---------------------------------------------------------------- strings
def pystrip_sql(e: str) -> str:
    """``str.strip()``. Spark's one-argument ``trim`` only removes U+0020;
    ``btrim`` with the whole whitespace set is a plain scan from both ends."""
    return f"btrim({e}, {q(WS_CHARS)})"


def word_count_sql(e: str) -> str:
    """``len(s.split())`` -- Unicode whitespace tokens."""
    v = var()
    return f"size(filter(split({e}, {q(WS_CLASS + '+')}, -1), {v} -> {v} <> ''))"


def sentences_sql(e: str) -> str:
    """``[s.strip() for s in t.split('.') if s.strip()]``."""
    a, b = var(), var()
    return (f"filter(transform(split({e}, '[.]', -1), {a} -> {pystrip_sql(a)}), "
            f"{b} -> {b} <> '')")


def nonblank_lines_sql(e: str) -> str:
    """``[l.strip() for l in t.split('\\n') if l.strip()]``."""
    a, b = var(), var()
    return (f"filter(transform(split({e}, {q(chr(10))}, -1), {a} -> {pystrip_sql(a)}), "
            f"{b} -> {b} <> '')")


def join_lines_sql(e: str) -> str:
    """``'\\n\\n'.join(nonblank_lines(t))`` in one codegen'd regex pass: a
    whitespace run holding a newline is exactly a line boundary plus the
    stripped edges of both neighbours and any blank lines between, so it is
    replaced by a blank line, and the ends are stripped."""
    return pystrip_sql(f"regexp_replace({e}, {q(WS_NO_NL + '*' + chr(10) + WS_CLASS + '*')}, "
                       f"{q(chr(10) * 2)})")


# ---------------------------------------------------------------- entities
# Named references: the 252 names of html.entities.name2codepoint (the
# HTML 4 set an HTML parser decodes; a rule, not a hand-kept list) + apos.
_NAMED = dict(html.entities.name2codepoint)
_NAMED["apos"] = 0x27
# one JSON string literal, constant-folded once by the optimizer (a map()
# call would put ~500 nodes into every expression that decodes entities)
ENTITY_MAP_SQL = ("from_json(" + q(json.dumps({n: chr(_NAMED[n]) for n in sorted(_NAMED)}, ensure_ascii=True))
                  + ", 'map<string,string>')")

# the references most pages use, tested before the map look-up
_COMMON = ["amp", "lt", "gt", "quot", "nbsp"]

ENTITY_TOKEN = r"&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[A-Za-z][A-Za-z0-9]++;)|&|[^&]++"


def _cp_char(n: str) -> str:
    """Character of code point ``n`` (full Unicode range via UTF-32)."""
    return (f"CASE WHEN {n} BETWEEN 1 AND 1114111 "
            f"THEN decode(unhex(lpad(hex({n}), 8, '0')), 'UTF-32') ELSE {q(chr(0xFFFD))} END")


def decode_entities_sql(e: str) -> str:
    """Decode ``&name;``, ``&#N;`` and ``&#xH;`` in one pass: the string is
    cut into tokens (a reference, a lone ``&``, a run without ``&``), each
    reference replaced, tokens re-joined. One pass means ``&amp;lt;`` gives
    ``&lt;``, never ``<``. As in libxml2 before 2.14 (the parser of the
    original), a number needs no semicolon, a name does: ``&#169 x`` is a
    sign, ``&copy x`` stays, in text and attributes alike."""
    t = var("t")
    dec = let(f"coalesce(try_cast(rtrim(';', substring({t}, 3)) AS BIGINT), 0)", _cp_char)
    # more than 8 digits after leading zeros is no character
    hexa = let(let(f"ltrim('0', rtrim(';', substring({t}, 4)))",
                   lambda h: f"IF(length({h}) > 8, 0L, coalesce(try_cast(conv({h}, 16, 10) AS BIGINT), 0))"), _cp_char)
    common = " ".join(f"WHEN {q('&' + n + ';')} THEN {q(chr(_NAMED[n]))}" for n in _COMMON)
    tok = (f"CASE WHEN length({t}) = 1 OR substring({t}, 1, 1) <> '&' THEN {t} "
           f"ELSE CASE {t} {common} ELSE CASE "
           f"WHEN {t} RLIKE '^&[A-Za-z][A-Za-z0-9]*;$' "
           f"THEN coalesce(try_element_at({ENTITY_MAP_SQL}, substring({t}, 2, length({t}) - 2)), {t}) "
           f"WHEN {t} RLIKE '^&#[0-9]+;?$' THEN {dec} "
           f"WHEN {t} RLIKE '^&#[xX][0-9a-fA-F]+;?$' THEN {hexa} "
           f"ELSE {t} END END END")
    return f"array_join(transform(regexp_extract_all({e}, {q(ENTITY_TOKEN)}, 0), {t} -> {tok}), '')"


# ---------------------------------------------------------------- JSON
def json_span_sql(e: str) -> str:
    """``t[t.find('{'): t.rfind('}') + 1]`` when that is a non-empty span,
    else NULL (no span)."""
    def body(t):
        def inner(p):
            return (f"CASE WHEN {p}.s > 0 AND {p}.r > 0 AND {p}.e > {p}.s "
                    f"THEN substring({t}, {p}.s, {p}.e - {p}.s + 1) END")
        return let(f"named_struct('s', instr({t}, '{{'), 'r', instr(reverse({t}), '}}'), "
                   f"'e', length({t}) - instr(reverse({t}), '}}') + 1)", inner)
    return let(e, body)


def strict_json_object_sql(span: str) -> str:
    """True when ``json.loads(span)`` would accept the ``{...}`` span.
    Spark's JSON readers are lax (trailing text, single quotes), so the span
    is wrapped in brackets and parsed as a variant: a single valid value
    gives a one-element array."""
    return let(f"concat('[', {span}, ']')",
               lambda w: f"(try_parse_json({w}) IS NOT NULL AND json_array_length({w}) = 1)")


def json_has_key_sql(span: str, key: str) -> str:
    """Key presence (``key in obj``), which differs from a JSON null."""
    return f"coalesce(array_contains(json_object_keys({span}), {q(key)}), false)"


# ---------------------------------------------------------------- Column API
def pystrip(c: str) -> Column:
    return expr(pystrip_sql(c))


def word_count(c: str) -> Column:
    return expr(word_count_sql(c))


def sentences(c: str) -> Column:
    return expr(sentences_sql(c))


def nonblank_lines(c: str) -> Column:
    return expr(nonblank_lines_sql(c))


def join_lines(c: str) -> Column:
    return expr(join_lines_sql(c))


def decode_entities(c: str) -> Column:
    return expr(decode_entities_sql(c))


def json_span(c: str) -> Column:
    return expr(json_span_sql(c))


def strict_json_object(c: str) -> Column:
    return expr(strict_json_object_sql(c))
