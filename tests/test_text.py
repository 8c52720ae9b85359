import html
import json

from conftest import many

from pagemill.functions import text as T

TRICKY = ["  a b  ", "　x ", "\x1c\x1dy\x1e\x1f", " z ", "", " ", "a​b",
          "\t\nline\r\n", "\u0085q᠎", "é  ", "x "]


def test_pystrip_matches_python(spark):
    assert many(spark, T.pystrip_sql("s"), "s", TRICKY) == [s.strip() for s in TRICKY]


def test_word_count_matches_split(spark):
    items = TRICKY + ["one two  three", "a　b c", "x​y"]
    assert many(spark, T.word_count_sql("s"), "s", items) == [len(s.split()) for s in items]


def test_sentences(spark):
    items = ["A. B.. C", "3.14 is pi. Dr. No", "", "...", " x . y "]
    got = many(spark, T.sentences_sql("s"), "s", items)
    assert got == [[p.strip() for p in s.split(".") if p.strip()] for s in items]


def test_join_lines_equals_split_strip_filter(spark):
    items = ["a\n\n b \n\n\nc", " \n x 　\n y", "one", "", "\n\n", "a \r\n b"]
    want = ["\n\n".join(ln.strip() for ln in s.split("\n") if ln.strip()) for s in items]
    assert many(spark, T.join_lines_sql("s"), "s", items) == want


def test_decode_entities_single_pass(spark):
    items = ["a &amp; b", "&amp;lt;", "&lt;p&gt;", "&#233;&#xE9;", "&copy; &middot; &quot;x&quot;",
             "&#128512;", "&unknown; &", "&nbsp;x", "5 &lt 6", "&#0;"]
    got = many(spark, T.decode_entities_sql("s"), "s", items)
    # semicolon-terminated references decode like html.unescape; others stay
    assert got[:8] == [html.unescape(s) for s in items[:8]]
    assert got[8] == "5 &lt 6"
    assert got[9] == "�"


def _py_span(t):
    s, e = t.find("{"), t.rfind("}") + 1
    return t[s:e] if s != -1 and e > s else None


SPANS = ['x {"a": 1} y', "no braces", "} before {", '{"a": {"b": 2}}', "{", "}", "{}", 'a{"k":"}"}b']


def test_json_span(spark):
    assert many(spark, T.json_span_sql("t"), "t", SPANS) == [_py_span(t) for t in SPANS]


def _py_strict(s):
    try:
        json.loads(s)
        return True
    except ValueError:
        return False


def test_strict_json_gate(spark):
    items = ['{"a": 1}', '{"a": 1} trailing', "{'a': 1}", '{"a": 1} and {"b": 2}', '{"a": 1},{"b": 2}',
             '{"a": [1, 2,]}', '{"a": "x"}', "{}", '{"a": tru}', '{"a": null}']
    assert many(spark, T.strict_json_object_sql("s"), "s", items) == [_py_strict(s) for s in items]


def test_references_without_semicolon(spark):
    cases = {"&#169 2024": "\u00a9 2024", "&#xA9x": "\u00a9x", "&#65&#66;&#67": "ABC", "&copy 2024": "&copy 2024", "AT&ampT &amp; x": "AT&ampT & x",
             "?a=1&copy=2": "?a=1&copy=2", "&#;&#x;&#": "&#;&#x;&#", "&#0000000065x": "Ax", "a & b &": "a & b &"}
    assert many(spark, T.decode_entities_sql("s"), "s", list(cases)) == list(cases.values())
