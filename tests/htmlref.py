"""A small tree-building extractor on the standard library's html.parser,
used only as a differential oracle for the Spark expressions."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

from pagemill.functions.urls import IMAGE_EXCLUDE, IMAGE_EXTENSIONS

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
        "track", "wbr"}
BOILER = {"script", "style", "nav", "header", "footer", "aside", "iframe"}


class Node:
    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []


class Comment(str):
    pass


class Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {}, None)
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        d = {}
        for k, v in attrs:
            d.setdefault(k, v if v is not None else "")
        n = Node(tag, d, self.stack[-1])
        self.stack[-1].children.append(n)
        if tag not in VOID:
            self.stack.append(n)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.stack.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        self.stack[-1].children.append(data)

    def handle_comment(self, data):
        self.stack[-1].children.append(Comment(data))


class Repairing(Builder):
    """Nests as a repairing parser does; state and rules written apart from the expressions'."""

    RANK = {"div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180, "table": 190,
            "head": 200, "body": 200, "html": 220}
    CELL, GROUP = {"td", "th"}, {"thead", "tbody", "tfoot"}
    BLOCK = {"address", "blockquote", "center", "dir", "div", "dl", "fieldset", "form", "h1", "h2", "h3", "h4", "h5", "h6",
             "menu", "ol", "p", "pre", "table", "ul"}

    def __init__(self):
        super().__init__()
        self.ignored = 0

    def ends(self, new, old):
        if new in self.BLOCK:
            return old in ("p", "head")
        if new in self.GROUP:
            return old in self.CELL | self.GROUP | {"tr", "p"}
        return old in {"a": {"a"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"},
                       "td": self.CELL | {"p"}, "th": self.CELL | {"p"}, "tr": self.CELL | {"tr", "p"}, "body": {"head"}}.get(new, ())

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "head", "body") and any(n.tag == tag for n in self.stack):
            self.ignored += 1
            return
        while tag not in VOID and self.ends(tag, self.stack[-1].tag):
            self.stack.pop()
        super().handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in ("html", "head", "body") and self.ignored:
            self.ignored -= 1
            return
        rank = self.RANK.get(tag, 100)
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return
            if self.RANK.get(self.stack[i].tag, 100) > rank:
                return


def walk(n):
    for c in n.children:
        if isinstance(c, Node):
            yield c
            yield from walk(c)


def strings(n):
    for c in n.children:
        if isinstance(c, Node):
            if c.tag in ("script", "style"):
                continue
            yield from strings(c)
        elif not isinstance(c, Comment):
            yield c


def node_string(n):
    if len(n.children) != 1:
        return None
    c = n.children[0]
    if isinstance(c, Node):
        return node_string(c)
    return c


def extract(html: str, url: str, builder: type = Builder) -> dict:
    b = builder()
    b.feed(html)
    b.close()
    root = b.root
    nodes = list(walk(root))
    title = None
    t = next((n for n in nodes if n.tag == "title"), None)
    if t is not None and node_string(t):
        title = node_string(t).strip()
    if title is None:
        og = next((n for n in nodes if n.tag == "meta" and n.attrs.get("property") == "og:title"), None)
        if og is not None and og.attrs.get("content"):
            title = og.attrs["content"].strip()
    if title is None:
        h1 = next((n for n in nodes if n.tag == "h1"), None)
        title = "".join(strings(h1)).strip() if h1 is not None else "Untitled"
    for n in nodes:
        if n.tag in BOILER and n.parent is not None and n in n.parent.children:
            n.parent.children.remove(n)
    nodes = list(walk(root))
    tests = [lambda n: n.tag == "article", lambda n: n.tag == "main",
             lambda n: n.attrs.get("role") == "main",
             lambda n: "content" in (n.attrs.get("class") or "").split(),
             lambda n: "post-content" in (n.attrs.get("class") or "").split(),
             lambda n: n.attrs.get("id") == "content", lambda n: n.tag == "body"]
    box = None
    for test in tests:
        box = next((n for n in nodes if test(n)), None)
        if box is not None:
            break
    if box is None:
        box = root
    text = "\n".join(s.strip() for s in strings(box) if s.strip())
    content = "\n\n".join(ln.strip() for ln in text.split("\n") if ln.strip())

    def ordered(xs):
        seen, out = set(), []
        for x in xs:
            if x not in seen:
                seen.add(x)
                out.append(x)
        return out

    imgs = []
    for n in nodes:
        if n.tag == "img":
            ref = n.attrs.get("src") or n.attrs.get("data-src") or n.attrs.get("data-original")
            if ref:
                u = urljoin(url, ref)
                low = u.lower()
                if not any(p in low for p in IMAGE_EXCLUDE) and (
                        any(low.endswith(e) for e in IMAGE_EXTENSIONS) or "?" in u):
                    imgs.append(u)
    links = []
    for n in nodes:
        if n.tag == "a" and "href" in n.attrs and n.attrs["href"]:
            try:
                u = urljoin(url, n.attrs["href"])
            except ValueError:  # the original loses the page; we drop the link
                continue
            if u.split(":", 1)[0].lower().strip() in ("http", "https") and ":" in u:
                links.append(u)
    meta = {}
    for key, attr, val in [("description", "name", "description"), ("author", "name", "author"),
                           ("publish_date", "property", "article:published_time"), ("keywords", "name", "keywords")]:
        m = next((n for n in nodes if n.tag == "meta" and n.attrs.get(attr) == val), None)
        if m is not None and m.attrs.get("content"):
            meta[key] = m.attrs["content"]
    return {"title": title, "content": content, "images": ordered(imgs), "links": ordered(links),
            "metadata": meta}
