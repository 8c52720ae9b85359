"""Request validation (O02) of the six request models: defaults, required
fields, enumerations, ranges and URL scheme as column expressions. Rows are never dropped here: each gets ``valid``
and the list of ``errors``; ``accepted`` / ``rejected`` split them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.httpurl import http_url_error_sql
from ..functions.text import q
from ..schemas import AUDIENCES, STYLES

# Validation messages (pydantic v2 wording).
URL_REQUIRED = "url: Field required"
STYLE_ENUM = "article_style: Input should be 'professional', 'casual' or 'news'"
AUDIENCE_ENUM = "target_audience: Input should be 'general', 'technical' or 'business'"
WORDS_MIN = "word_count: Input should be greater than or equal to 300"
WORDS_MAX = "word_count: Input should be less than or equal to 5000"

WORDS_INT = "word_count: Input should be a valid integer, unable to parse string as an integer"
FIELD_REQUIRED = "{}: Field required"
OBJECT_TYPE = "{}: Input should be a valid dictionary"

# Defaults of the request models (the author has no branded default).
DEFAULTS = {"article_style": "professional", "target_audience": "general", "word_count": 1000,
            "extract_images": True, "extract_links": True, "draft_only": False}

# The fields of each request model. Required text and required
# objects (JSON text of one) come first, then the options.
MODELS = {
    "crawl": ("url", (), (), ("extract_images", "extract_links")),
    "analyze": (None, ("title", "content"), (), ()),
    "write": (None, (), ("analysis_result",), ("article_style", "target_audience", "word_count")),
    "publish": (None, (), ("article",), ("draft_only",)),
    "url_to_article": ("url", (), (), tuple(DEFAULTS)),
    "url_to_wechat": ("url", (), (), ("article_style", "target_audience", "draft_only")),
}


def _in(e: str, values) -> str:
    return f"{e} IN ({', '.join(q(v) for v in values)})"


def validate_requests(df: DataFrame, kind: str = "url_to_article") -> DataFrame:
    """Apply the defaults of a request model (a key of ``MODELS``) and check
    its fields. A missing option column takes its default; a missing required
    column is an error on every row. ``word_count`` may be text: what is no
    integer is an error of its row, never of the job."""
    url, texts, objects, options = MODELS[kind]
    cols = set(df.columns)
    field = lambda c: f"`{c}`" if c in cols else "CAST(NULL AS STRING)"
    checks, out = [], [f"`{c}`" for c in df.columns if c not in options]
    if url:
        u = field(url)
        checks.append(f"CASE WHEN {u} IS NULL THEN {q(URL_REQUIRED)} ELSE concat('url: ', {http_url_error_sql(u)}) END")
    checks += [f"CASE WHEN {field(c)} IS NULL THEN {q(FIELD_REQUIRED.format(c))} END" for c in texts]
    checks += [f"CASE WHEN {field(c)} IS NULL THEN {q(FIELD_REQUIRED.format(c))} "
               f"WHEN json_object_keys({field(c)}) IS NULL THEN {q(OBJECT_TYPE.format(c))} END" for c in objects]
    s = df
    for c in options:
        d = DEFAULTS[c]
        default = str(d).lower() if isinstance(d, bool) else q(str(d))
        given = f"CAST(`{c}` AS STRING)" if c == "word_count" else f"`{c}`"
        s = s.selectExpr("*", f"coalesce({given}, {default}) AS _{c}" if c in cols else f"{default} AS _{c}")
    if "article_style" in options:
        checks.append(f"CASE WHEN NOT {_in('_article_style', STYLES)} THEN {q(STYLE_ENUM)} END")
        checks.append(f"CASE WHEN NOT {_in('_target_audience', AUDIENCES)} THEN {q(AUDIENCE_ENUM)} END")
    if "word_count" in options:
        s = s.selectExpr("*", "try_cast(_word_count AS BIGINT) AS _words")
        checks.append(f"CASE WHEN _words IS NULL THEN {q(WORDS_INT)} WHEN _words < 300 THEN {q(WORDS_MIN)} "
                      f"WHEN _words > 5000 THEN {q(WORDS_MAX)} END")
    errors = f"filter(array({', '.join(checks)}), e -> e IS NOT NULL)"
    out += [f"{'_words' if c == 'word_count' else '_' + c} AS {c}" for c in options]
    return s.selectExpr(*out, f"{errors} AS errors").selectExpr("*", "size(errors) = 0 AS valid")


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where("valid")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.where("NOT valid")
