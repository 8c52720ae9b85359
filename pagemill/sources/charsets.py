"""Pages as bytes (O01): which charset a page is in, and its text.

Order: byte order mark; the charset a ``<meta>`` within the first 1,024 bytes
names; UTF-8 where the bytes are valid; else windows-1252. A declared UTF-16
that could be read as ASCII is UTF-8, as browsers take it. UTF-8 and
windows-1252 are decoded by SQL functions; others (UTF-16, GBK, Shift_JIS, ...)
by Arrow batches, which hold the bytes of those pages alone. Bytes that are none of the
charset become U+FFFD. An unknown name counts as not declared.
"""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from ..functions.text import q

# Names that mean windows-1252 on the web.
_WESTERN = ["windows-1252", "cp1252", "iso-8859-1", "iso8859-1", "latin1", "latin-1", "us-ascii", "ascii"]
_META_RE = r"""(?is)<meta\s[^>]*?charset\s*=\s*["']?\s*([a-z0-9_:.\-]+)"""
# the characters of the bytes 80 to 9F; five of them have none and stay
_HIGH = bytes(range(0x80, 0xA0))
_C1 = [(chr(b), bytes([b]).decode("cp1252")) for b in _HIGH if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]


@F.pandas_udf(BooleanType())
def _known(names: pd.Series) -> pd.Series:
    def known(name):
        try:
            return bool(name) and codecs.lookup(name)._is_text_encoding
        except (LookupError, ValueError):
            return False
    return names.map({n: known(n) for n in names.unique()}).fillna(False).astype(bool)


@F.pandas_udf(StringType())
def _decoded(pages: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else b.decode(n, "replace") for b, n in zip(pages, names)], dtype=object)


def decode_pages(df: DataFrame, html: str = "html") -> DataFrame:
    """``df`` with the BINARY column ``html`` as text and ``charset``, its name
    (lower case, null where ``html`` is null). A mark is not part of the text.
    A string column is returned as it is, with a null charset; an existing
    ``charset`` column is replaced."""
    if df.schema[html].dataType.typeName() != "binary":
        return df.withColumn("charset", F.lit(None).cast("string"))
    b = f"`{html}`"
    western = ", ".join(q(w) for w in _WESTERN)
    name = f"lower(regexp_extract(decode(substring({b}, 1, 1024), 'ISO-8859-1'), {q(_META_RE)}, 1))"
    d = df.withColumn("_meta", F.expr(name))
    d = d.withColumn("_meta", F.expr(f"CASE WHEN _meta LIKE 'utf-16%' OR _meta = 'utf8' THEN 'utf-8' WHEN _meta IN ({western}) THEN 'windows-1252' ELSE _meta END"))
    plain = "_meta IN ('', 'utf-8', 'windows-1252')"
    d = d.withColumn("_other", _known(F.expr(f"IF({plain}, NULL, _meta)")))
    d = d.withColumn("charset", F.expr(
        f"CASE WHEN {b} IS NULL THEN NULL WHEN hex(substring({b}, 1, 3)) = 'EFBBBF' THEN 'utf-8' WHEN hex(substring({b}, 1, 2)) = 'FFFE' THEN 'utf-16le' "
        f"WHEN hex(substring({b}, 1, 2)) = 'FEFF' THEN 'utf-16be' WHEN _other OR (_meta <> '' AND {plain}) THEN _meta "
        f"WHEN is_valid_utf8({b}) THEN 'utf-8' ELSE 'windows-1252' END"))
    d = d.withColumn("_rest", _decoded(F.expr(f"IF(charset IN ('utf-8', 'utf-16le', 'utf-16be', 'windows-1252'), NULL, {b})"), F.col("charset")))
    even = f"substring({b}, 3, (length({b}) - 2) div 2 * 2)"  # an odd last byte is none of a character
    text = (f"CASE charset WHEN 'utf-8' THEN make_valid_utf8(IF(hex(substring({b}, 1, 3)) = 'EFBBBF', substring({b}, 4), {b})) "
            f"WHEN 'utf-16le' THEN _wide WHEN 'utf-16be' THEN _wide WHEN 'windows-1252' THEN translate(decode({b}, 'ISO-8859-1'), "
            f"{q(''.join(c for c, _ in _C1))}, {q(''.join(c for _, c in _C1))}) ELSE _rest END")
    # pages with a UTF-16 mark are few; Python replaces broken pairs, where decode() would fail
    d = d.withColumn("_wide", _decoded(F.expr(f"IF(charset LIKE 'utf-16%', {even}, NULL)"), F.col("charset")))
    return d.withColumn(html, F.expr(text)).drop("_meta", "_other", "_rest", "_wide")
