from urllib.parse import urljoin

from conftest import many

from pagemill.functions import urls as U

VECTORS = [("http://a.com/x/y?q=1#f", "#top"), ("http://a.com/x/y?q=1", "?z=2"), ("http://a.com/x/y", "z"),
           ("http://a.com/x/y/", "../z"), ("http://a.com", "z"), ("http://a.com/x", "//b.com/k"),
           ("http://a.com/x", "HTTP://B.com/k"), ("http://a.com/x", "HTTPS://B.com/k"),
           ("http://a.com/x", "/a/./b/../c"), ("http://a.com/x", "../../../z"), ("http://a.com/x", "http:foo"),
           ("http://a.com/x", " /sp "), ("http://a.com/x", "javascript:void(0)"), ("http://a.com/x", "mailto:a@b"),
           ("http://a.com/b/c/d;p?q", "../../g"), ("http://a.com/b/c/", "."), ("http://a.com/b/c/", ".."),
           ("http://a.com/b/c", "g/"), ("http://a.com/b/c", "./g/."), ("http://a.com/b/c", ""),
           ("https://a.com/", "//[::1]/x"), ("http://a.com/b/c", "?"), ("http://a.com/b/c?x#y", "#"),
           ("http://a.com/b", "\tg\n/h"), ("https://a.com/p/q", "../../../../x/./y/"),
           ("http://a.com/x", "http://[bad/")]


def _py(base, ref):
    try:
        return urljoin(base, ref)
    except ValueError:
        return None


def test_resolve_url_matches_urljoin(spark):
    df = spark.createDataFrame([(i, b, r) for i, (b, r) in enumerate(VECTORS)], "i int, base string, ref string")
    got = [row.r for row in df.selectExpr("i", f"{U.resolve_url_sql('base', 'ref')} AS r").orderBy("i").collect()]
    assert got == [_py(b, r) for b, r in VECTORS]


def test_image_predicate(spark):
    urls = ["http://a.com/x.png", "http://a.com/catalogo.jpg", "http://a.com/pixel.gif", "http://a.com/x?w=1",
            "http://a.com/x", "http://a.com/X.JPEG", "http://cdn.icons.com/a.png", "http://a.com/a.svg\n"]

    def py(u):
        low = u.lower()
        if any(p in low for p in U.IMAGE_EXCLUDE):
            return False
        return any(low.endswith(e) for e in U.IMAGE_EXTENSIONS) or "?" in u
    assert many(spark, U.is_valid_image_url_sql("u"), "u", urls) == [py(u) for u in urls]


def test_link_predicate(spark):
    urls = ["http://a.com", "HTTPS://b.com", "javascript:void(0)", "mailto:a@b", "ftp://x", "tel:1", " http://x"]
    assert many(spark, U.is_valid_link_url_sql("u"), "u", urls) == [True, True, False, False, False, False, True]
