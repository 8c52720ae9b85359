"""URL validation against a vector of a WHATWG-style parser's decisions."""

from conftest import many

from pagemill.functions import httpurl as H

OK = ["http://a.com", "HTTPS://A.com/x?y#z", " http://a.com ", "https:example.com", "http:/a.com", "http:\\\\a.com\\x", "http://u:p@w@a.com:80/", "http://a.com:",
      "http://a.com:65535", "http://1.2.3.4", "http://1.2.3.4.", "http://0x7f.1", "http://017.0.0.1", "http://4294967295", "http://1.65536", "http://[::1]:8080/",
      "http://[1:2:3:4:5:6:7:8]", "http://[1::8]", "http://[::ffff:1.2.3.4]", "http://[1:2:3:4:5:6:7::]", "http://ex%61mple.com", "http://bücher.de",
      "ht\ntp://a\t.com", "http://a.b.c.", "http://localhost", "http://a_b.com", "http://1.2.3.x4", "http://a.com/ x y"]
BAD = {"": H.EMPTY_INPUT, "  ": H.NO_SCHEME, "a.com": H.NO_SCHEME, "//a.com": H.NO_SCHEME, "1http://a.com": H.NO_SCHEME, "ftp://a.com": H.SCHEME,
       "mailto:a@b.c": H.SCHEME, "http://": H.EMPTY_HOST, "http:///?x": H.EMPTY_HOST, "http://u@:80": H.EMPTY_HOST, "http://exa mple.com": H.BAD_DOMAIN,
       "http://a<b.com": H.BAD_DOMAIN, "http://a%2fb": H.BAD_DOMAIN, "http://a%zz": H.BAD_DOMAIN, "http://a|b": H.BAD_DOMAIN, "http://[::1": H.BAD_IPV6,
       "http://[1:2:3]": H.BAD_IPV6, "http://[1::2::3]": H.BAD_IPV6, "http://[::1.2.3.256]": H.BAD_IPV6, "http://[1:2:3:4:5:6:7:8:9]": H.BAD_IPV6,
       "http://1.2.3.256": H.BAD_IPV4, "http://1.2.3.4.5": H.BAD_IPV4, "http://256.1": H.BAD_IPV4, "http://4294967296": H.BAD_IPV4, "http://08.1.1.1": H.BAD_IPV4,
       "http://a.1": H.BAD_IPV4, "http://a.com:99999/": H.BAD_PORT, "http://a.com:x": H.BAD_PORT, "http://a:b:c": H.BAD_PORT, "http://[::1]x": H.BAD_PORT,
       "http://a.com/" + "x" * 2100: H.TOO_LONG}


def test_http_urls(spark):
    assert dict(zip(OK, many(spark, H.http_url_error_sql("s"), "s", OK))) == dict.fromkeys(OK)
    assert dict(zip(BAD, many(spark, H.http_url_error_sql("s"), "s", list(BAD)))) == BAD
    assert many(spark, H.http_url_error_sql("s"), "s", [None, "x", "http://a"])[0::2] == [None, None]
