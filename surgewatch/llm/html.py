"""Main text of web pages: site template removal.

Each page is read once. Its element subtrees are hashed (tag, text, and the
subtrees inside), Spark counts for every host on how many of its distinct pages a subtree
stands, and subtrees that recur on at least ``share`` of the host's pages (and
``min_pages`` of them) are deleted as template: a block goes if it stands in such a
subtree, or if each of its text pieces stands in such an inline subtree. Elements whose name, role or
class says that they are no content (menus, page headers and footers, sidebars,
notices, adverts, forms, comments, scripts, styles) go too, on whichever host; their
subtrees are hashed and counted like all others (``removals`` tells the two rules apart).
A class or id counts by its whole names: outside an article a name such as ``cookie-banner``
of which every part says so, inside one only a single word for adverts, comments or links
to share or to other pages.

If a page has ``<article>`` or ``<main>`` elements with text, the text inside
them is its main text, else the body. A block is the text between two block
element borders: character references decoded, white space turned into one
space, trimmed; empty blocks go; blocks are joined by ``\\n`` in page order.

Defined cases: null or empty html gives an empty text; markup that is not
closed ends with the page; text outside any element counts as body; a null url
belongs to the host ``''``; repeated rows and other copies of a page's text on
its host count as one page and each get their text; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surgewatch.llm.exchange import arrow_schema, saved

#: Element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("nav footer aside form script style noscript template iframe svg canvas button select textarea title head dialog menu "
                    "object embed audio video map math noembed noframes fieldset option datalist".split())
MAIN = frozenset(["article", "main"])
WHOLE = MAIN | {"html", "body"}
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
#: Words in a class or id that mark an element as no content.
MARKS = frozenset("ad ads advert adverts advertisement advertising adsense alert banner breadcrumb breadcrumbs comment comments consent cookie "
                  "cookies dialog disqus footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices overlay "
                  "pager pagination popup promo promotion recommendations recommended related replies respond search share sharing sidebar "
                  "signup social sponsor sponsored subscribe subscription toolbar widget widgets".split())
#: An open element (left) that a start tag (right) closes.
P_ENDERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                     "header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "optgroup": {"option", "optgroup"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
          "tfoot": {"tr", "td", "th", "thead", "tbody"}, "body": {"head"}}
SCOPES = frozenset("table td th ul ol dl select article main section div nav aside footer header form blockquote body html".split())

#: Words that stand beside such a mark in one name, and the marks that count inside an article.
PLACES = frozenset("site page main top bottom left right box bar block container wrapper section area list item global primary secondary inner outer".split())
INNER_MARKS = frozenset("ad ads advert adverts advertisement adsense comment comments disqus replies newsletter subscribe signup share sharing social "
                        "sponsor sponsored promo promotion related recommended recommendations sidebar breadcrumb breadcrumbs pager pagination nav navbar "
                        "navigation menu".split())

# an attribute value is quoted only straight after its "="; a quote that is never closed is a character like any other
ATTRIBUTES = r"((?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+|=)*+)"
TOKEN = re.compile(rf"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*+){ATTRIBUTES}>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
WORD = re.compile(r"[a-z0-9]+")
PARSED = ("page_id bigint, url string, host string, blocks array<struct<text:string,at:int,pieces:array<struct<at:int,sign:bigint>>>>, "
          "keys array<bigint>, parents array<int>, ruled array<int>")
RESULT = "page_id bigint, url string, text string, n_chars bigint"


class _Element:
    __slots__ = ("content", "dropped", "key", "main", "name", "no", "parent")

    def __init__(self, name: str, dropped: bool, main: bool, parent: "_Element | None"):
        self.name, self.dropped, self.main, self.parent = name, dropped, main, parent
        self.content: list[str] = []
        self.key: int | None = None
        self.no: int | None = None

    def block(self) -> "_Element":
        """The nearest element around a text piece that is no inline element."""
        el = self
        while el.name in INLINE:
            el = el.parent
        return el


class Page:
    """Blocks of a page, and the subtrees around them: each subtree's hash (none for whole articles) and the one it stands in."""

    def __init__(self):
        self.blocks: list[tuple[str, int, list[tuple[int, int | None]]]] = []
        self.elements: list[_Element] = []
        self.ruled: list[int] = []

    def number(self, el: _Element) -> int:
        """An element's place; what is around it has a smaller one."""
        new = []
        while el is not None and el.no is None:
            new.append(el)
            el = el.parent
        for e in reversed(new):
            e.no = len(self.elements)
            self.elements.append(e)
        return new[0].no if new else el.no

    def keys(self) -> list[int | None]:
        return [None if e.name in WHOLE or e.parent is None else e.key for e in self.elements]

    def parents(self) -> list[int]:
        return [-1 if e.parent is None else e.parent.no for e in self.elements]


def removed(keys: list[int | None], parents: list[int], subtrees: set[int]) -> list[bool]:
    """Which elements are template or stand in one."""
    out: list[bool] = []
    for key, parent in zip(keys, parents, strict=True):
        out.append(parent >= 0 and out[parent] or key in subtrees)
    return out


def kept_texts(page: dict, subtrees: set[int]) -> list[str]:
    """Texts of the blocks that are no template; an inline subtree that recurs takes its block along only if nothing else stands in it."""
    if not subtrees:
        return [b["text"] for b in page["blocks"]]
    gone = removed(page["keys"], page["parents"], subtrees)
    return [b["text"] for b in page["blocks"] if not gone[b["at"]] and not all(gone[p["at"]] or p["sign"] in subtrees for p in b["pieces"])]


def _key(content: str) -> int:
    key = xxhash.xxh64_intdigest(content.encode("utf-8", "replace"))
    return key - (1 << 64) if key >= 1 << 63 else key


#: Classes of articles that are no main text.
ARTICLES_APART = frozenset("comment comments ad advert related sidebar".split())


def _marked(name: str) -> bool:
    """Whether every part of a class name says that the element is no content, or where it stands."""
    parts = WORD.findall(name)
    return not MARKS.isdisjoint(parts) and all(p in MARKS or p in PLACES or p == "header" for p in parts) or parts == ["header"]


def _unwanted(name: str, attributes: str, inside_main: bool) -> bool:
    if name in DROPPED or name == "header" and not inside_main:
        return True
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key = m[1].lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "role" and value.strip() in ROLES:
            return True
        if key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key in ("class", "id") and name not in ("html", "body", "main"):
            names = value.split()
            if name == "article":
                if not ARTICLES_APART.isdisjoint(names):
                    return True
            elif inside_main:
                if not INNER_MARKS.isdisjoint(names):
                    return True
            elif any(_marked(n) for n in names):
                return True
    return False


def parse(source: str) -> Page:
    """Blocks of the main text with the subtrees that they, and each of their text pieces, stand in."""
    page = Page()
    root = _Element("", False, False, None)
    stack = [root]
    places: list[tuple[_Element, int | None]] = []
    blocks: list[tuple[str, list[tuple[_Element, int | None]]]] = []
    pieces: list[str] = []
    ruled: dict[_Element, None] = {}

    def flush() -> None:
        nonlocal pieces, places
        if pieces:
            text = " ".join(references.unescape("".join(pieces)).split())
            if text:
                blocks.append((text, places or [(stack[-1], None)]))
            pieces, places = [], []

    def end() -> None:
        el = stack.pop()
        el.key = _key("\x1f".join(el.content))
        stack[-1].content.append(f"<{el.name} {el.key}>")

    def text(raw: str) -> None:
        el = stack[-1]
        if not raw.isspace():
            el.content.append(raw)
            if el.dropped:
                ruled[el.block()] = None
                return
            plain = references.unescape(raw).strip() if "&" in raw else raw.strip()
            # signs between links are subtrees of their own: they have no element that could recur
            sign = None if not plain or any(map(str.isalnum, plain)) else _key("#" + plain)
            if plain and (not places or places[-1] != (el, sign)):
                places.append((el, sign))
        if not el.dropped:
            pieces.append(raw)

    at, size = 0, len(source)
    while at < size:
        m = TOKEN.search(source, at)
        if m is None:
            text(source[at:])
            break
        if m.start() > at:
            text(source[at:m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:-3] if m[0].endswith("]]>") else m[0][9:])
            continue
        if name not in INLINE:
            flush()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    while len(stack) > k:
                        end()
                    break
                if name in INLINE and stack[k].name not in INLINE:
                    break
            continue
        closed = CLOSES.get(name, ())
        if closed or name in P_ENDERS:
            for k in range(len(stack) - 1, 0, -1):
                open_name = stack[k].name
                if open_name in closed or open_name == "p" and name in P_ENDERS:
                    while len(stack) > k:
                        end()
                    if not closed or open_name == "p":
                        break
                elif open_name in SCOPES:
                    break
        if name in VOID or m[3].endswith("/") and name not in INLINE and name in DROPPED:
            if name == "br":
                text(" ")
            continue
        parent = stack[-1]
        dropped = parent.dropped or _unwanted(name, m[3], parent.main)
        stack.append(_Element(name, dropped, parent.main or name in MAIN, parent))
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
            if close is None:
                break
            at = close.end()
            end()
    flush()
    while len(stack) > 1:
        end()
    inside = [b for b in blocks if b[1][0][0].main]
    for t, at in inside or blocks:
        page.blocks.append((t, page.number(at[0][0].block()), list(dict.fromkeys((page.number(el), sign) for el, sign in at))))
    page.ruled = [page.number(el) for el in ruled]
    return page


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    schema = arrow_schema(PARSED)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(h or "") for h in batch["html"].to_pylist()]
            blocks = [[{"text": t, "at": at, "pieces": [{"at": a, "sign": s} for a, s in pieces]} for t, at, pieces in p.blocks] for p in found]
            columns = [blocks, [p.keys() for p in found], [p.parents() for p in found], [p.ruled for p in found]]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], batch["host"],
                                              *[pa.array(c, schema.field(3 + i).type) for i, c in enumerate(columns)]], schema=schema)

    return rows.mapInArrow(read, PARSED)


def _subtrees() -> Column:
    signs = F.flatten(F.transform("blocks", lambda b: F.transform(b["pieces"], lambda p: p["sign"])))
    return F.array_distinct(F.array_compact(F.concat("keys", signs)))


def templates(pages: DataFrame, share: float, min_pages: int) -> DataFrame:
    """``host, subtrees``: hashes of the subtrees that recur on the host. Bounded by what one page holds, divided by ``share``.

    Pages of one host with the same text are copies of one page and count once.
    """
    copies = pages.select("host", F.xxhash64(F.col("blocks")["text"]).alias("content"), F.array_sort(_subtrees()).alias("subtrees"))
    distinct = saved(copies.groupBy("host", "content").agg(F.min("subtrees").alias("subtrees")), "contents")
    hosts = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    seen = distinct.select("host", F.explode("subtrees").alias("subtree"))
    counts = seen.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    often = counts.join(hosts, "host").filter(F.col("n") >= share * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("subtree").alias("subtrees"))


def _with_templates(read: DataFrame, share: float, min_pages: int, max_broadcast_hosts: int) -> DataFrame:
    known = saved(templates(read, share, min_pages), "templates")
    few = known.count() <= max_broadcast_hosts   # else a shuffled join; AQE splits the pages of a hot host
    return read.join(F.broadcast(known) if few else known, "host", "left")


def main_text(pages: DataFrame, share: float = 0.75, min_pages: int = 10, max_broadcast_hosts: int = 20_000,
              id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    read = saved(parsed(pages, id_col, url_col, html_col), "pages")
    rows = _with_templates(read, share, min_pages, max_broadcast_hosts)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts: dict[str, set[int]] = {}
            texts = []
            for page, host, subtrees in zip(batch.select(["blocks", "keys", "parents"]).to_pylist(), batch["host"].to_pylist(), batch["subtrees"], strict=True):
                if host not in hosts:
                    hosts[host] = set(subtrees.as_py() or ())
                texts.append("\n".join(kept_texts(page, hosts[host])))
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "host", "blocks", "keys", "parents", "subtrees").mapInArrow(join, RESULT)


def removals(pages: DataFrame, share: float = 0.75, min_pages: int = 10) -> DataFrame:
    """One row: pages, blocks left by the element rules, blocks of those that are template, blocks ruled out, and how many of these are template too."""
    rows = _with_templates(saved(parsed(pages), "pages"), share, min_pages, 20_000)
    names = ["pages", "blocks", "template_blocks", "ruled_blocks", "ruled_and_template"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [batch.num_rows, 0, 0, 0, 0]
            for page in batch.to_pylist():
                subtrees = set(page["subtrees"] or ())
                gone = removed(page["keys"], page["parents"], subtrees)
                n[1] += len(page["blocks"])
                n[2] += len(page["blocks"]) - len(kept_texts(page, subtrees))
                n[3] += len(page["ruled"])
                n[4] += sum(gone[i] for i in page["ruled"])
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in n], names)

    counted = rows.select("blocks", "keys", "parents", "ruled", "subtrees").mapInArrow(count, ", ".join(f"{n} bigint" for n in names))
    return counted.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
