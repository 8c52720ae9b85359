"""Pages whose tags cross: the second lane against a parser that repairs."""

import random

from htmlref import Repairing, extract

from pagemill.operators.crawl import crawl

NAMES = ["div", "p", "nav", "section", "article", "aside", "ul", "li", "table", "tr", "td", "header", "b", "main"]

# (body, text, crossed)
SHAPES = [
    ("<div><nav>menu</div>after</nav>", "after", True),
    ("<p><nav>menu</p>after</nav>x", "after\n\nx", True),
    ("<nav><div>a</nav>b</div>c</nav>d", "d", True),
    ("<article><div>a</article>b</div>c</article>d", "a\n\nb\n\nc", True),
    ("<section><div class=content>a</section>b</div>c</section>", "a\n\nb", True),
    ("<article><table><tr><td>a</article>b</table>c</article>d", "a\n\nb\n\nc", True),
    ("<ul><li><nav>m<li>n</li></nav>x</ul>", "x", False),
    ("<aside><p>a<p>b</aside>c", "c", False),
    ("<article>a</section></p>b</article>c", "a\n\nb", True),
    ("<table><tr><td><header>h</td></tr></table>z", "z", True),
    ("<nav><body><div>x</body></div>y</nav>z", "z", True),
]


def _crawled(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id bigint, html string").selectExpr("*", "'http://h.example.com/' AS url")
    return {r.page_id: r for r in crawl(df).collect()}


def test_shapes(spark):
    pages = [f"<html><body>{b}</body></html>" for b, *_ in SHAPES]
    got = _crawled(spark, pages)
    for i, (_, text, crossed) in enumerate(SHAPES):
        assert extract(pages[i], "http://h.example.com/", Repairing)["content"] == text, pages[i]
        assert (got[i].content, "crossed_elements" in got[i].shape_flags) == (text, crossed), pages[i]


def test_random_pages_equal_the_repairing_parser(spark):
    rng = random.Random(3)
    pages = []
    for _ in range(400):
        parts = ["<html><head><title>t</title></head><body>"]
        for k in range(rng.randint(4, 16)):
            name = rng.choice(NAMES)
            parts.append(rng.choice([f"<{name}>", f"</{name}>", f'<{name} class="x">']) + f"w{k} ")
            if rng.random() < 0.2:
                parts.append(f'<a href="/l{k}">l{k}</a><img src="i{k}.png">')
        pages.append("".join(parts) + "</body></html>")
    got, lanes, wrong = _crawled(spark, pages), 0, []
    for i, page in enumerate(pages):
        want, r = extract(page, "http://h.example.com/", Repairing), got[i]
        lanes += "crossed_elements" in r.shape_flags
        if (r.content, list(r.images), list(r.links)) != (want["content"], want["images"], want["links"]):
            wrong.append((page, want["content"], r.content, r.shape_flags))
    assert lanes > 100
    assert not wrong, (len(wrong), wrong[:3])


def test_long_page_in_the_second_lane(spark):
    body = "<div><nav>" + "<p><b>x</b></p>" * 20_000 + "</div><p>kept</p>" + "<p>y</p>" * 5_000 + "</nav>"
    assert _crawled(spark, [f"<html><body>{body}</body></html>"])[0].content == "\n\n".join(["kept"] + ["y"] * 5_000)
