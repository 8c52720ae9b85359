from pagemill.operators.crawl import crawl
from pagemill.sources.charsets import decode_pages

BODY = "<html><head>{}</head><body><p>{}</p></body></html>"
META = '<meta charset="{}">'

# (bytes, charset, text)
PAGES = [
    (BODY.format("", "Käse – gut").encode(), "utf-8", "Käse – gut"),
    (b"\xef\xbb\xbf" + BODY.format(META.format("gbk"), "é").encode(), "utf-8", "é"),
    (b"\xff\xfe" + BODY.format("", "中文").encode("utf-16-le") + b"x", "utf-16le", "中文"),
    (b"\xfe\xff" + BODY.format("", "中文").encode("utf-16-be"), "utf-16be", "中文"),
    (BODY.format(META.format("ISO-8859-1"), "“é” – €").encode("cp1252"), "windows-1252", "“é” – €"),
    (BODY.format("", "caf\xe9").encode("latin-1"), "windows-1252", "café"),
    (BODY.format("<meta http-equiv='Content-Type' content='text/html; charset=gb2312'>", "中文").encode("gb2312"), "gb2312", "中文"),
    (BODY.format(META.format("shift_jis"), "日本").encode("shift_jis"), "shift_jis", "日本"),
    (BODY.format(META.format("no-such"), "ü").encode(), "utf-8", "ü"),
    (BODY.format(META.format("utf-16"), "ü").encode(), "utf-8", "ü"),
    (BODY.format(META.format("utf-8"), "a").encode() .replace(b">a<", b">a\xffb<"), "utf-8", "a�b"),
    (b"", "utf-8", None),
    (None, None, None),
]


def test_bytes_of_several_charsets(spark):
    rows = [(i, "http://h.example.com/", b) for i, (b, *_) in enumerate(PAGES)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html binary")
    got = {r.page_id: r for r in crawl(decode_pages(df)).collect()}
    for i, (_, charset, text) in enumerate(PAGES):
        assert (got[i].charset, got[i].content) == (charset, text), PAGES[i]


def test_text_passes(spark):
    df = spark.createDataFrame([(1, "x")], "page_id bigint, html string")
    assert decode_pages(df).collect()[0].asDict() == {"page_id": 1, "html": "x", "charset": None}
