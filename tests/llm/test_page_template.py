import html
import random
import re

from fleetlens.llm import page_template, queries
from fleetlens.llm.page_blocks import read

COLUMNS = "page_id long, url string, html string"


def main_of(page):
    return "\n".join(b.text for b in page_template._main_blocks(read(page).blocks, set(), None))


def plain(page):
    """Heading and paragraphs of the article of a given page, read off its text."""
    inner = re.search("<article>(.*)</article>", page, re.S).group(1)
    parts = re.split(r"</?(?:h1|p)>", re.sub(r"</?(?:b|br)>", " ", inner))
    return "\n".join(t for p in parts if (t := " ".join(html.unescape(p).split())))


def test_given_pages(llm, sf):
    want = {r["page_id"]: (r["url"], plain(r["html"])) for r in llm.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r["page_id"]: (r["url"], r["text"]) for r in queries.op11_page_template(llm, sf).collect()}
    assert got == want


def test_zones_and_markup():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="with-sidebar"><!-- <p>no</p> -->
    <header><a href="/">Site</a><h1>Name</h1></header><nav><ul><li>One<li>Two</ul></nav><div id="cookie-notice">We use cookies</div>
    <main><div class="breadcrumb">Home &gt; News</div><article class="post"><header><h1>A &amp; B</h1></header>
    <p>First <b>bold</b><i>er</i> &lt;tag&gt;&nbsp; x<br>y<p>Second&#33; <script>var a = "<p>no</p>";</script><span class="ad">Buy</span>
    <ul><li>Item <a href="x>y">link</a><li>Other</ul><aside>Side</aside><form><input><p>Mail</p></form>
    <blockquote>Said <p>twice</p></blockquote><table><tr><td>1<td>2</table>
    <div class="post-comments"><article class="comment"><p>Nice</p></article></div><section id="comments"><p>Bad</p></section>
    <footer>By me</footer></article><div class="related-posts related">More</div></main>
    <div class="sidebar">S</div><footer>&copy; x</footer></body></html>"""
    assert main_of(page).split("\n") == ["A & B", "First bolder <tag> x y", "Second!", "Item link", "Other", "Said", "twice", "1", "2"]


def test_broken_markup_ends():
    assert main_of(None) == main_of("") == main_of("<p") == main_of("<!-- never closed <p>x</p>") == main_of("<script>x") == ""
    assert main_of("a < b & c") == "a < b & c"
    assert main_of("<article><p>one<p title='a>b\">two</article></p></b>three").startswith("one\n")
    assert main_of("<nav><ul><li>m<article><p>kept</article>") == "kept"
    assert main_of("<form><main><p>page in a form</p></main></form>") == "page in a form"
    assert main_of("<p>" + "x " * 200_000 + "<b " * 50_000).startswith("x x")
    assert main_of("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8))) for _ in range(n))


def site(rnd, host, n, build):
    return [(f"https://{host}/{k}", *build(rnd, k)) for k in range(n)]


def with_notices(rnd, k):
    body = [words(rnd, 30) for _ in range(rnd.randrange(2, 6))]
    paragraphs = [f"<p>{t}</p>" for t in body]
    page = f"<body><article><h1>{body[0]}</h1><p class=lead>Share this text with friends</p>{''.join(paragraphs)}<div><p class=end>Read more on our pages</p></div></article></body>"
    return page, "\n".join([body[0], *body])


def without_article(rnd, k):
    body = [words(rnd, 40) for _ in range(rnd.randrange(1, 4))]
    links = "".join(f"<div class=x{k}><a href=/{j}>{words(rnd, 4)}</a></div>" for j in range(3))
    page = f"<body><div class=top>{links}</div><div class=page><div class=text>{''.join(f'<p>{t}</p>' for t in body)}</div></div><div class=low><a href=/>{words(rnd, 3)}</a></div></body>"
    return page, "\n".join(body)


def moved(rnd, k):
    """The same line on all pages, before or after another: the order changes, so it's no template."""
    line, other, own = "<p class=one>The same line everywhere in it</p>", "<p class=two>Another line that is on all pages</p>", [words(rnd, 60) for _ in range(4)]
    pair = [line, other][:: 1 if k % 2 else -1]
    text = [re.sub("<.*?>", "", x) for x in pair]
    return f"<body><article>{''.join(pair)}{''.join(f'<p>{t}</p>' for t in own)}</article></body>", "\n".join(text + own)


def test_templates_of_hosts(llm):
    rnd = random.Random(1)
    rows = site(rnd, "a.example", 40, with_notices) + site(rnd, "b.example", 40, without_article) + site(rnd, "c.example", 20, moved)
    one = words(rnd, 50)
    rows += [(f"https://copies.example/{k}", f"<body><article><h1>{one[:20]}</h1><p>{one}</p></article></body>", f"{one[:20].strip()}\n{one}") for k in range(30)]
    rows += [(f"https://few.example/{k}", *with_notices(rnd, k)) for k in range(2)]
    few = {u for u, _, _ in rows if "few" in u}
    df = llm.createDataFrame([(k, u, p) for k, (u, p, _) in enumerate(rows)], COLUMNS)
    got = {r["url"]: r["text"] for r in page_template.extract_text(df).collect()}
    wrong = [u for u, _, t in rows if u not in few and got[u] != t]
    assert not wrong, (wrong[:3], got[wrong[0]])
    assert all("Share this text" in got[u] for u in few)  # two pages don't make a template


def test_large_host_in_parts(llm, monkeypatch):
    monkeypatch.setattr(page_template, "SALT", 7)
    rnd = random.Random(2)
    rows = site(rnd, "hot.example", 60, with_notices) + site(rnd, "cold.example", 9, with_notices)
    df = llm.createDataFrame([(k, u, p) for k, (u, p, _) in enumerate(rows)], COLUMNS)
    assert {r["url"]: r["text"] for r in page_template.extract_text(df).collect()} == {u: t for u, _, t in rows}


def test_odd_rows(llm):
    page = "<article><p>Text &copy; here</p></article>"
    rows = [(1, "http://a/", page), (1, "http://a/", page), (None, None, page), (2, "no address", None), (3, "", ""), (4, "http://b/", "<div>é漢😀</div>"), (5, None, "<nav>x</nav>")]
    df = llm.createDataFrame([(*r, "z", 9, "q") for r in rows], f"{COLUMNS}, text string, n_chars int, host string")
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in page_template.extract_text(df).collect()), key=repr)
    text = "Text © here"
    want = [(1, "http://a/", text, 11), (1, "http://a/", text, 11), (None, None, text, 11), (2, "no address", "", 0), (3, "", "", 0), (4, "http://b/", "é漢😀", 3), (5, None, "", 0)]
    assert got == sorted(want, key=repr)
    assert page_template.extract_text(df.limit(0)).collect() == []
