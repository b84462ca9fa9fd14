"""Pages by hand, and the vote of a host."""

import html
import random
import tracemalloc
from collections import Counter, defaultdict

import pytest

from ternary_rules.llm import html_extraction
from ternary_rules.llm.html_extraction import CONTAINERS, MOST_PATH, Page, extract

SCHEMA = "page_id long, url string, html string"
PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><article>";</script></head><body><nav><ul><li><a href="/a">menu</a></li></ul></nav>
<!-- <article>no</article> --><div class="ad">advert</div>%s<aside>side</aside><form>q<input></form><div id="comments"><p>comment of a reader</p></div><footer>&copy; foot</footer></body></html>"""


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<article><h1>T &amp; U</h1><p>A  b\n c&nbsp;d</p><p>E <b>f</b> g</p></article>", "T & U\nA b c d\nE f g"),
        ("<article><h1>T</h1><p><b>T<br><p>one<p>two</article>", "T\nT\none\ntwo"),
        ("<article><p>a<br>b</p><div class='related'>no</div><div class='newsletter-box'>no</div><p>c &lt;d&gt; &amp;amp; x < 3</p></article>", "a b\nc <d> &amp; x < 3"),
        ("<article><ul><li>1<li>2</ul><table><tr><td>a<td>b<tr><td>c</table><div role=navigation>no</div><p style='display:none'>no</p><p hidden>no</p></article>", "1\n2\na b\nc"),
        ("<article></article>", ""),
    ],
)
def test_text(body, text):
    assert Page(PAGE % body).text("body/article") == text


@pytest.mark.parametrize(("source", "text"), [("", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<article><p>cut off &am", "cut off &am"), ("<article><p>x</p><di", "x"), ("<article><p>a<!-- b", "a"), ("<article><p>a<script>b", "a"), ("</p></div>a", "a"), ("<" * 50, "<" * 50), ('<p a="' + '"' * 999 + ">t", "t"), ("<article>" + "<div>" * 3000 + "deep", "deep")])
def test_broken(source, text):
    assert Page(source).text(None) == text


def pages(n):
    out = []
    for i in range(n):
        lead = "short lead" if i % 2 else "a lead of one page that is longer than its text and would win there " * 3
        out.append((i, f"https://a.example.com/{i}", f"<body><div class='teaser-{i}'><p>{lead}</p></div><div class='post-{i}'><p>text of page {i} that goes on for a while, as articles do</p><p>and more</p></div></body>"))
    return out


def test_consensus(spark):
    """Most pages of the host vote for its articles' place; the odd one follows."""
    rows = [*pages(9)[1::2], pages(9)[0], (50, None, "<article><p>no host</p></article>"), (51, "https://b.example.com", None), (51, "https://b.example.com", None), (52, "https://a.example.com/x", "<body><main><p>elsewhere</p></main></body>")]
    found = extract(spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({}).selectExpr("*", "'x' AS host", "'y' AS path", "'z' AS text")).collect()
    text = {r["page_id"]: r["text"] for r in found}
    assert len(found) == len(rows)
    assert all(text[i] == f"text of page {i} that goes on for a while, as articles do\nand more" for i in (0, 1, 3, 5, 7))
    assert text[50] == "no host" and text[51] == "" and text[52] == "elsewhere"
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    assert extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_joined_paths(spark, monkeypatch):
    rows = spark.createDataFrame(pages(6), SCHEMA)
    shipped = sorted(map(tuple, extract(rows).collect()))
    monkeypatch.setattr(html_extraction, "BROADCAST_HOSTS", 0)
    assert sorted(map(tuple, extract(rows).collect())) == shipped


def test_long_page(spark):
    body = "".join(f"<p>paragraph {i} &eacute;</p>" for i in range(20_000))
    found = extract(spark.createDataFrame([(1, "http://h", PAGE % f"<article>{body}</article>")], SCHEMA)).first()
    assert found["text"] == "\n".join(html.unescape(f"paragraph {i} &eacute;") for i in range(20_000))


A, B = "words of the article that go on " * 20, "more words of it " * 20


@pytest.mark.parametrize(
    ("body", "text"),
    [
        (f"<article><h1>The title</h1><div class='entry-content'><p>{A}</p><p>{B}</p></div></article>", ["The title", A, B]),
        (f"<article><p>direct</p><section><p>{A}</p></section><section><p>{B}</p></section><p>end</p></article>", ["direct", A, B, "end"]),
        (f"<article><div class='part-a'><p>{A}</p></div><div class='part-b'><p>{B}</p></div></article>", [A, B]),
        (f"<div class='page'><h1>The title</h1><div class='a'><p>{A}</p></div><div class='b'><p>{B}</p></div><div class='c'><a href='/x'>a link</a></div></div>", ["The title", A, B, "a link"]),
        (f"<div class='page'><div class='a'><p>{A}</p></div><div class='c'>{'<p><a href=/x>a link to another page</a></p>' * 9}</div></div>", [A]),
        (f"<h1>The title</h1><div class='a'><p>{A}</p></div><p><a href='/'>home</a></p>", ["The title", A]),
        (f"<div class='wrap'><h1>The title</h1><article><section><p>{A}</p></section></article><div><p>teaser</p></div></div>", ["The title", A]),
    ],
)
def test_whole_article(spark, body, text):
    """The path that wins for a host is an anchor; the article around it is taken as a whole."""
    want = "\n".join(" ".join(t.split()) for t in text)
    found = extract(spark.createDataFrame([(i, f"http://h/{i}", PAGE % body) for i in range(2)], SCHEMA)).collect()
    assert [r["text"] for r in found] == [want] * 2


LINKS = "<ul><li><a href='/1'>one other page</a></li><li><a href='/2'>another page</a></li></ul>"


@pytest.mark.parametrize(
    ("body", "text"),
    [
        (f"<h2 id='related-work'>Related work</h2><p>{A}</p><h2 id='social-impact'>Impact</h2><p id='search-results-2'>{B}</p>", ["Related work", A, "Impact", B]),
        (f"<p>{A}</p><section id='discussion'><h2>Discussion</h2><p>{B}</p></section>", [A, "Discussion", B]),
        (f"<p>{A}</p><div class='alert alert-info'><p>{B}</p></div><section id='comments-on-method'><p>{B}</p></section><p>see <span class='comment'># code</span></p>", [A, B, B, "see # code"]),
        (f"<p>{A}</p><div id='related'>{LINKS}</div><div id='related-posts'>{LINKS}</div><div id='social'>{LINKS}</div><div class='search'>{LINKS}</div>", [A]),
        (f"<p>{A}</p><div id='comments-area'>no</div><div id='sidebar-2'>no</div><ul class='share-list'><li>no</li></ul><div role='search'>no</div>", [A]),
    ],
)
def test_names_of_parts(body, text):
    """An anchor to a part of the article doesn't drop it; parts made of links go."""
    assert Page(PAGE % f"<article>{body}</article>").text("body/article") == "\n".join(" ".join(t.split()) for t in text)


def test_deep_pages_take_memory_by_size():
    """200,000 open elements, and text at every depth."""
    for source, n in (("<div>" * 200_000 + "deep", 1), ("".join(f"<div class='c{'x' * (k % 50)}'>text {k} " for k in range(60_000)), 60_000), ("<div class='" + "y" * 100_000 + "'>" + "<div>t " * 5_000, 5_000)):
        tracemalloc.start()
        page = Page(source)
        votes, text = page.votes(), page.text(None)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 200e6 and len(page.blocks) == n and text and votes and max(map(len, votes)) <= MOST_PATH + 1
    linked = "<div>" * 30_000 + "".join(f"<p><a href=/{k}>link {k}</a></p>" for k in range(30_000))
    assert Page(linked).votes() == {}


def around(e):
    return [] if e is None else [*around(e.up), e]


def naive_votes(page):
    """Votes of a page, each block walking out through whole lists of the elements around it."""
    points = Counter()
    for text, place, _ in page.blocks:
        boxes = [e for e in around(place) if e.tag in CONTAINERS]
        for k, e in enumerate(reversed(boxes)):
            points[e.path] += int(-len(text) / 2**k) if place.linked else (len(text) + 25) >> k
    most = max(points.values(), default=0)
    return {p: v * 1000 // most for p, v in points.items() if v > 0} if most > 0 else {}


def naive_text(page, path):
    own = naive_votes(page)
    if not any(e.path == path and e.tag in CONTAINERS and not e.away for e in page.elements):
        path = min(own, key=lambda p: (-own[p], p)) if own else None
    if path is None:
        return "\n".join(b[0] for b in page.blocks)
    size = lambda e: [sum(x) for x in zip((0, 0), *[(len(t) - n, n) for t, place, n in page.blocks if e in around(place)], strict=True)]
    roots = set()
    for _, place, _ in page.blocks:
        whole = around(place)
        at = next((k for k, e in enumerate(whole) if e.path == path), None)
        if at is None:
            continue
        root = next((e for e in whole[: at + 1] if e.tag in ("article", "main")), None)
        if root is None:
            root = whole[at]
            for e in reversed(whole[:at]):
                if e.tag in ("body", "html"):
                    break
                (a, b), (c, d) = size(e), size(root)
                if e.tag in CONTAINERS and a - c > b - d:
                    root = e
        roots.add(root)
    out = []
    for text, place, n in page.blocks:
        whole = around(place)
        box = next((e for e in reversed(whole) if e.tag in CONTAINERS), None)
        above = box is None or any(box in around(r)[:-1] for r in roots)
        if roots & set(whole) or 2 * n < len(text) and above:
            out.append(text)
    return "\n".join(out) if roots else ""


def random_page(rng, host):
    out = ["<body>", ["", "<div class=a><div>", "<article><section class=b>", "<main>", "<div class=c>"][host % 5], "text " * 40]
    for _ in range(rng.randint(3, 40)):
        tag = rng.choice(["div", "div", "section", "article", "main", "p", "ul", "li", "span", "td", "h1", "nav"])
        out.append(rng.choice([f"<{tag}>", f"<{tag} class='{rng.choice('abc')}'>", f"<{tag} id=related>", f"</{tag}>", f"</{tag}>", "words " * rng.randint(1, 30), f"<a href=/>{'link ' * rng.randint(1, 9)}</a>"]))
    return "".join(out)


def test_against_a_naive_version(spark):
    """Votes of hosts, choice of paths and texts, for random pages."""
    rng = random.Random(8)
    rows = [(i, f"https://h{i % 7}.example.com/{i}", random_page(rng, i % 7)) for i in range(400)]
    votes = defaultdict(Counter)
    for _, url, source in rows:
        votes[url.split("/")[2]].update(naive_votes(Page(source)))
    best = {h: min(v, key=lambda p: (-v[p], p)) if v else None for h, v in votes.items()}
    assert len(set(best.values())) > 2
    found = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {i: naive_text(Page(source), best[url.split("/")[2]]) for i, url, source in rows}
    assert len(set(found.values())) > 200
