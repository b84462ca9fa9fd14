"""Main text of web pages by consensus host paths.

Every page scores its containers and casts votes for their generalised tag-class paths. Spark sums
the votes per host, and the path with most votes is the place of the article on that host. Pages
are then read again. The path is an anchor: the text is that of the whole article around it (see
Page.text). A page that lacks its host's path, or has a host of its own, falls back to its own best
container.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored

#: Winning paths are shipped to all workers up to so many hosts and bytes, and joined to the pages beyond.
BROADCAST_HOSTS, BROADCAST_BYTES = 100_000, 32 << 20
#: Characters of a path; a longer one begins with a hash of what is above.
MOST_PATH = 240
#: Hosts and paths whose votes a worker sums before it passes them on.
MOST_SUMS = 50_000

MARKUP = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*'|["'])*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noframes")}
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption option".split())
CONTAINERS = frozenset("article body center div main section td".split())
#: Elements that hold no article text.
AWAY = frozenset("head nav header footer aside form script style noscript template iframe object svg canvas button select textarea dialog menu audio video map math".split())
AWAY_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner banners sponsor sponsored promo promotion promoted sidebar sidebars aside menu menus nav navbar navigation navigational breadcrumb breadcrumbs"
    " footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notices alert notification disclaimer comment comments commentlist disqus reply replies respond discussion share sharing social related"
    " recommended widget widgets popup modal overlay newsletter subscribe subscription signup login search contentinfo complementary skip pagination pager".split()
)
#: Such a name beside one of AWAY_NAMES in one class speaks of the article itself.
OWN_NAMES = frozenset("article entry post story content body main text".split())
#: Elements that such names are read of; headings, paragraphs and phrases have them as anchors.
NAMED = frozenset("div section ul ol dl li table tbody tr td th center details fieldset".split())
#: Names that articles have too, in any attribute or as ids: links decide (see Page).
DOUBTFUL = frozenset("discussion alert notice notices notification disclaimer search social reply replies respond".split())
DOUBTFUL_IDS = DOUBTFUL | frozenset("related recommended share sharing login signup skip cookie cookies menu menus foot ads ad promotion sponsor sponsored consent overlay complementary".split())
#: Words that say where an element stands or what it looks like, not what it holds.
LAYOUT = frozenset("left right top bottom inner outer main primary secondary area bar box block list wrap wrapper container content section column col row holder panel form".split())
#: What an opening tag closes, and where the search for it ends.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
P_ENDS = frozenset("article section div body td th li blockquote main table button".split())


class _Element:
    """`no` counts opening tags, so an element's comes after those of all elements around it; `over`
    is the nearest container around it."""

    __slots__ = ("away", "doubtful", "linked", "no", "over", "path", "tag", "up")

    def __init__(self, tag: str, path: str, away: bool, linked: bool, no: int, up: _Element | None, doubtful: bool = False):
        self.tag, self.path, self.away, self.linked, self.no, self.up, self.doubtful = tag, path, away, linked, no, up, doubtful
        self.over = None if up is None else up.box

    @property
    def box(self) -> _Element | None:
        """The nearest container, itself included."""
        return self if self.tag in CONTAINERS else self.over


def _joined(path: str, name: str) -> str:
    """The path of a child. Where it would get long, a hash stands for the part above, so that no
    page's paths take more room than its tags."""
    if len(name) > MOST_PATH // 2:
        name = f"#{hashlib.blake2b(name.encode(), digest_size=12).hexdigest()}"
    if len(path) + len(name) > MOST_PATH:
        path = f"#{hashlib.blake2b(path.encode(), digest_size=12).hexdigest()}"
    return f"{path}/{name}" if path else name


def _words(name: str) -> set[str]:
    return {p.lower() for p in re.split(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])", name) if p}


def _names(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """The generalised name of an element, whether it holds no article text, and whether that is
    open. A class counts by any word in it. An id, which may be an anchor to a part of the article,
    counts as a whole: beside words of AWAY_NAMES it has words of LAYOUT and numbers only."""
    away, doubtful = tag in AWAY, False
    if not attributes or attributes.isspace():
        return tag, away, doubtful
    classes: list[str] = []
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            away = True
        elif name == "class":
            classes = [re.sub(r"\d+", "#", c.lower()) for c in value.split()]
        if name in ("class", "id", "role") and tag in NAMED:
            for one in value.split():
                parts = _words(one)
                hits = parts & AWAY_NAMES
                if not hits or parts & OWN_NAMES and not parts & {"comment", "comments", "ad", "ads", "sidebar", "nav", "menu", "footer"}:
                    continue
                if name == "role":
                    away = True
                elif name == "class":
                    away, doubtful = away or bool(hits - DOUBTFUL), True
                else:
                    whole = all(p in AWAY_NAMES or p in LAYOUT or p.isdigit() for p in parts)
                    away, doubtful = away or whole and bool(hits - DOUBTFUL_IDS), True
    return (tag + "".join(f".{c}" for c in sorted(set(classes))), away, doubtful)


class Page:
    """One pass over a page: elements with their generalised paths, and blocks of text, each with
    the element it stands in (None outside all) and the number of its characters in links. Text
    inside elements that hold no article text is left out at once; of elements whose name leaves it
    open, when the page is read and at least half of their text is in links. An element knows the
    one around it only, so memory grows with the page, not with its depth."""

    def __init__(self, source: str):
        self.elements: list[_Element] = []
        self.blocks: list[tuple[str, _Element | None, int]] = []
        self.stack: list[_Element] = []
        self.open: Counter = Counter()
        self.pieces: list[str] = []
        self.place: _Element | None = None
        self.linked = 0
        at, n = 0, len(source)
        while at < n:
            m = MARKUP.search(source, at)
            if m is None:
                self._text(source[at:])
                break
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._close(tag)
                continue
            self._open(tag, m[3])
            if tag in RAW and not m[3].rstrip().endswith("/"):
                end = RAW[tag].search(source, at)
                at = end.start() if end else n
        self._flush()
        if any(e.doubtful for e in self.elements):
            self._judge()

    def _sums(self) -> tuple[list[int], list[int]]:
        """Characters of plain and of linked text inside each element."""
        plain, linked = [0] * len(self.elements), [0] * len(self.elements)
        for text, e, in_links in self.blocks:
            if e is not None:
                plain[e.no] += len(text) - in_links
                linked[e.no] += in_links
        for e in reversed(self.elements):
            if e.up is not None:
                plain[e.up.no] += plain[e.no]
                linked[e.up.no] += linked[e.no]
        return plain, linked

    def _inside(self, chosen: set[_Element]) -> list[bool]:
        """Of each element, whether it or one around it is chosen."""
        out = [False] * len(self.elements)
        for e in self.elements:
            out[e.no] = e in chosen or e.up is not None and out[e.up.no]
        return out

    def _judge(self) -> None:
        plain, linked = self._sums()
        gone = set()
        for e in self.elements:
            if e.doubtful:
                e.away = e.away or plain[e.no] + linked[e.no] > 0 and plain[e.no] <= linked[e.no]
                if e.away:
                    gone.add(e)
        inside = self._inside(gone)
        self.blocks = [b for b in self.blocks if b[1] is None or not inside[b[1].no]]

    def _text(self, text: str) -> None:
        top = self.stack[-1] if self.stack else None
        if top is not None and top.away:
            return
        if not self.pieces:
            self.place = top
        self.pieces.append(html.unescape(text) if "&" in text else text)
        if top is not None and top.linked:
            self.linked += len(" ".join(self.pieces[-1].split()))

    def _flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.blocks.append((text, self.place, min(self.linked, len(text))))
            self.pieces, self.linked = [], 0

    def _pop_to(self, k: int) -> None:
        if any(e.tag in BLOCKS for e in self.stack[k:]):
            self._flush()
        for e in self.stack[k:]:
            self.open[e.tag] -= 1
        del self.stack[k:]

    def _open(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self._flush()
            if self.open["p"]:
                for k in range(len(self.stack) - 1, -1, -1):
                    if self.stack[k].tag == "p":
                        self._pop_to(k)
                        break
                    if self.stack[k].tag in P_ENDS:
                        break
        if tag in CLOSES:
            ends, until = CLOSES[tag]
            if any(self.open[t] for t in ends):
                for k in range(len(self.stack) - 1, -1, -1):
                    if self.stack[k].tag in ends:
                        self._pop_to(k)
                        if tag != "tr":
                            break
                    elif self.stack[k].tag in until:
                        break
        if tag in ("br", "td", "th"):
            self._text(" ")
        if tag in VOID:
            return
        name, away, doubtful = _names(tag, attributes)
        up = self.stack[-1] if self.stack else None
        path = _joined("", name) if up is None or up.path in ("", "html") or tag == "body" else _joined(up.path, name) if tag in BLOCKS or tag in CONTAINERS else up.path
        element = _Element(tag, path, away or up is not None and up.away, tag == "a" or up is not None and up.linked, len(self.elements), up, doubtful)
        self.stack.append(element)
        self.elements.append(element)
        self.open[tag] += 1

    def _close(self, tag: str) -> None:
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag == tag:
                if tag in BLOCKS:
                    self._flush()
                self._pop_to(k)
                return
            if tag not in BLOCKS and self.stack[k].tag in BLOCKS and tag not in AWAY:
                return

    def votes(self) -> dict[str, int]:
        """Points by container path: a block's length counts for the nearest container, half for
        the next one out and a quarter beyond it; text in links counts against."""
        points: Counter = Counter()
        for text, place, _ in self.blocks:
            worth = -len(text) if place is not None and place.linked else len(text) + 25
            box = place.box if place is not None else None
            while box is not None and worth:
                points[box.path] += worth
                worth = worth // 2 if worth > 0 else -(-worth // 2)
                box = box.over
        most = max(points.values(), default=0)
        return {p: 1000 * v // most for p, v in points.items() if v > 0} if most > 0 else {}

    def text(self, path: str | None) -> str:
        """The blocks of the article around elements of this path, joined by \n. Such an element is
        widened to its outermost article or main; where it has none, to the parent again and again,
        short of body, while what the parent adds is more plain text than links. Plain blocks that
        stand directly in a container further out, such as a title above the article, are its own."""
        if path is None or not any(e.path == path and e.tag in CONTAINERS and not e.away for e in self.elements):
            own = self.votes()
            path = min(own, key=lambda p: (-own[p], p)) if own else None
        if path is None:
            return "\n".join([t for t, _, _ in self.blocks])
        plain, linked = self._sums()
        whole: list[_Element | None] = []  # of each element, its outermost article or main
        anchored: list[bool] = []  # whether it or one around it has the path
        roots: set[_Element] = set()
        outer: set[_Element] = set()
        for e in self.elements:
            above = whole[e.up.no] if e.up is not None else None
            whole.append(above or (e if e.tag in ("article", "main") else None))
            around = e.up is not None and anchored[e.up.no]
            anchored.append(around or e.path == path)
            if around or e.path != path or not plain[e.no] + linked[e.no]:
                continue
            root = whole[e.no] or self._widened(e, plain, linked)
            roots.add(root)
            up = root.up
            while up is not None and up not in outer:
                outer.add(up)
                up = up.up
        if not roots:
            return ""
        inside = self._inside(roots)

        def belongs(place: _Element | None, plain: bool) -> bool:
            box = place.box if place is not None else None
            return place is not None and inside[place.no] or plain and (box is None or box in outer)

        return "\n".join([t for t, place, in_links in self.blocks if belongs(place, 2 * in_links < len(t))])

    @staticmethod
    def _widened(root: _Element, plain: list[int], linked: list[int]) -> _Element:
        up = root.up
        while up is not None and up.tag not in ("body", "html"):
            if up.tag in CONTAINERS and plain[up.no] - plain[root.no] > linked[up.no] - linked[root.no]:
                root = up
            up = up.up
        return root


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path with most votes; of equal ones the least."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([h for h, _ in sums], pa.string()), pa.array([p for _, p in sums], pa.string()), pa.array(list(sums.values()), pa.int64())], names=["host", "path", "votes"])

        for batch in batches:
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                for path, n in Page(source or "").votes().items():
                    sums[host, path] += n
            if len(sums) > MOST_SUMS:
                yield out()
                sums.clear()
        yield out()

    votes = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string")).mapInArrow(run, "host string, path string, votes long")
    summed = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return summed.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("less"), "path")).alias("best")).select("host", "best.path")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (empty if none) and n_chars (its code points) of every row of pages
    (page_id, url, html). A null html is empty; pages without a host share one. Rows that repeat
    stay repeated, and vote once each."""
    spark = pages.sparkSession
    small_batches(spark)
    own = pages.select("page_id", "url", F.col("html").cast("string"), host_of(F.col("url")).alias("host"))
    paths = stored(host_paths(pages))
    n_hosts, n_bytes = paths.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path")), F.lit(0))).first()
    if n_hosts <= BROADCAST_HOSTS and n_bytes <= BROADCAST_BYTES:
        shipped = spark.sparkContext.broadcast({r["host"]: r["path"] for r in paths.collect()})
        joined = own.withColumn("path", F.lit(None).cast("string"))
    else:  # a host with very many pages is a skewed key, which adaptive execution splits
        shipped = None
        joined = own.join(paths, "host", "left").select("page_id", "url", "html", "host", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value if shipped is not None else {}
        for batch in batches:
            rows = zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), batch.column("html").to_pylist(), strict=True)
            text = [Page(source or "").text(path or known.get(host)) for host, path, source in rows]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    read = joined.select("page_id", "url", "html", "host", "path").mapInArrow(run, f"page_id {dict(own.dtypes)['page_id']}, url {dict(own.dtypes)['url']}, text string")
    return read.withColumn("n_chars", F.length("text").cast("long"))
