"""Main-text extraction with site template removal.

1. Element subtrees of every page are hashed; Spark counts, per host, the distinct articles with which each subtree
   occurs, and subtrees that recur with ``MIN_PAGES`` or more of them are template: they are deleted first.
   Pages with one and the same article count once, so that a copied article's own parts are no template.
   Inside an article only boxes (not paragraphs, lists, tables and headings) count, since the texts of different articles
   of a host may share passages.
2. Counts cannot see furniture that differs from page to page (reader comments, adverts, forms), nor any on hosts with
   few pages.  It goes by its tag, or by a word of its class, id or role, but not around the only articles.
3. The text is that of the articles, where a page has some.

``extract_text`` reports how many characters each of the first two steps deletes.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import cut, prepare, small
from .urls import host_of

#: A subtree is template if it occurs on so many pages of its host, however many pages the host has.
MIN_PAGES = 3
#: Template marks of so many distinct pages may be broadcast, if few bytes too; beyond it pages and marks are shuffled.
BROADCAST_PAGES = 200_000

# HTML element names by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - {"br", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
SAME_CLOSES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
CONTAINERS = set("nav header footer aside form div section menu dialog".split())
FURNITURE = set(
    "script style noscript template head title nav footer aside form button select textarea iframe svg canvas object embed audio video dialog menu "
    "fieldset datalist".split()
)
#: Furniture that is dropped even around an article.
NEVER_MAIN = FURNITURE - set("nav header footer aside form dialog menu fieldset".split())
#: Words of class, id and role attributes that name page furniture.
WORDS = set(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices newsletter "
    "subscribe subscription signup popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar complementary footer contentinfo masthead "
    "comment comments commentlist replies reply respond disqus discussion share sharing social related recommended widget pagination pager toolbar login search skip alert "
    "dialog hidden banner".split()
)
OUTSIDE_WORDS = WORDS | {"header", "topbar", "bottom", "top"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z", re.S
)
MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
MAIN_ROLE = re.compile(r"""\brole\s*=\s*["']?main\b""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


class Element:
    __slots__ = ("tag", "attrs", "parent", "start", "end", "first", "last", "inside", "holds_main")

    def __init__(self, tag: str, attrs: str, parent: int, start: int, first: int, inside: bool):
        self.tag, self.attrs, self.parent, self.start, self.first, self.inside = tag, attrs, parent, start, first, inside
        self.end = self.last = -1
        self.holds_main = False


def parse(source: str) -> tuple[list[Element], list[str]]:
    """Elements in page order, and text pieces; an element owns pieces ``first..last-1``.

    Closing tags that may be left out are implied; a tag cut off at the end of the page is dropped.
    A piece is raw text, or a blank where a block begins or ends.
    """
    elements: list[Element] = []
    pieces: list[str] = []
    stack: list[int] = []
    articles = 0
    at, n = 0, len(source)

    def close(depth: int, end: int) -> None:
        nonlocal articles
        while len(stack) > depth:
            e = elements[stack.pop()]
            if e.tag in BLOCK:
                pieces.append(" ")
            e.end, e.last = end, len(pieces)
            articles -= e.tag == "article"

    while at < n:
        m = TOKEN.search(source, at)
        if m is None:
            pieces.append(source[at:])
            break
        if m.start() > at:
            pieces.append(source[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag = name.lower()
        if m[1] or m[4]:
            for depth in range(len(stack) - 1, -1, -1):
                open_tag = elements[stack[depth]].tag
                if open_tag == tag:
                    close(depth, at)
                    break
                if open_tag in ("article", "main") and tag in ("p", "div", "li", "ul", "section"):
                    break  # a stray closing tag doesn't end the article around it
            continue
        if tag in CLOSES_P:
            for depth in range(len(stack) - 1, -1, -1):
                open_tag = elements[stack[depth]].tag
                if open_tag == "p":
                    close(depth, m.start())
                    break
                if open_tag in BLOCK:
                    break
        if tag in SAME_CLOSES:
            for depth in range(len(stack) - 1, -1, -1):
                open_tag = elements[stack[depth]].tag
                if open_tag == tag or {open_tag, tag} == {"dt", "dd"} or {open_tag, tag} == {"td", "th"}:
                    close(depth, m.start())
                    break
                if open_tag in SAME_CLOSES[tag]:
                    break
        if tag in BLOCK:
            pieces.append(" ")
        if tag in VOID:
            continue
        attrs = m[3] if m[2] else m[6]
        elements.append(Element(tag, attrs or "", stack[-1] if stack else -1, m.start(), len(pieces), articles > 0))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else n
            elements[-1].end, elements[-1].last = at, len(pieces)
            continue
        stack.append(len(elements) - 1)
        articles += tag == "article"
        if tag in ("article", "main", "h1"):
            for k in stack[:-1]:
                elements[k].holds_main = True
    close(0, n)
    return elements, pieces


def is_furniture(e: Element) -> bool:
    """By tag, or by a word of class, id or role."""
    if e.tag in FURNITURE or (e.tag == "header" and not e.inside):
        return True
    if e.tag in ("html", "body", "main", "article") and not e.inside or not e.attrs:
        return False
    if HIDDEN.search(e.attrs):
        return True
    words = OUTSIDE_WORDS if not e.inside else WORDS
    for m in MARKS.finditer(e.attrs):
        if any(w.lower() in words for w in SPLIT.split(m[1] or m[2] or m[3] or "")):
            return True
    return False


def subtree_hashes(source: str, elements: list[Element], has_article: bool) -> list[tuple[int, int]]:
    """(element, hash of its source) of each element that may be template."""
    out = []
    for k, e in enumerate(elements):
        if e.holds_main or e.tag not in BLOCK or e.tag in ("html", "body", "head", "title", "article", "main", "br") or e.last <= e.first:
            continue
        if has_article and e.inside and e.tag not in CONTAINERS:
            continue
        h = xxhash.xxh64_intdigest(source[e.start : e.end].encode("utf-8", "surrogatepass"))
        out.append((k, h - (1 << 64) if h >= 1 << 63 else h))
    return out


def page_hashes(source: str | None) -> tuple[str, list[int]]:
    """Digest of the article (else of the whole page), and the hashes of the subtrees that may be template."""
    if not source:
        return "", []
    elements, _ = parse(source)
    articles = [e for e in elements if e.tag == "article" and not e.inside]
    main = "".join(source[e.start : e.end] for e in articles) or source
    return xxhash.xxh128_hexdigest(main.encode("utf-8", "surrogatepass")), sorted({h for _, h in subtree_hashes(source, elements, bool(articles))})


def main_text(source: str | None, templates: set[int]) -> str:
    """The text of the article (else of main, else of the body) without templates and furniture."""
    return extract(source, templates)[0]


def extract(source: str | None, templates: set[int]) -> tuple[str, int, int]:
    """:func:`main_text`, and the characters of text (blanks around pieces aside) in template subtrees and in other furniture."""
    if not source:
        return "", 0, 0
    elements, pieces = parse(source)
    has_article = any(e.tag == "article" for e in elements)
    template = {k for k, h in subtree_hashes(source, elements, has_article) if h in templates} if templates else set()
    furniture = {k for k, e in enumerate(elements) if is_furniture(e)}
    articles = [k for k, e in enumerate(elements) if e.tag == "article" and not e.inside]
    mains = [k for k, e in enumerate(elements) if e.tag == "main" or MAIN_ROLE.search(e.attrs)]

    def without(opened: set[int]) -> set[int]:
        """What goes, with all it holds; elements in ``opened`` are no furniture."""
        out: set[int] = set()
        for k, e in enumerate(elements):
            if e.parent in out or k in template or (k in furniture and k not in opened):
                out.add(k)
        return out

    def text_without(dropped: set[int]) -> str:
        gone = bytearray(len(pieces) + 1)
        for k in dropped:
            e = elements[k]
            if e.last > e.first and e.parent not in dropped:
                gone[e.first : e.last] = b"\1" * (e.last - e.first)
        roots = [k for k in articles if k not in dropped] or [k for k in mains if k not in dropped][:1]
        ranges = [(elements[k].first, elements[k].last) for k in roots] or [(0, len(pieces))]
        text = "".join((html.unescape(p) if "&" in p else p) for a, b in ranges for p in [*(pieces[i] for i in range(a, b) if not gone[i]), " "])
        return " ".join(text.split())

    def characters(which: set[int]) -> int:
        """Characters in the pieces of the elements and all they hold."""
        return sum(len(pieces[i].strip()) for i in {i for k in which if elements[k].parent not in which for i in range(elements[k].first, elements[k].last)})

    dropped = without(set())
    text = text_without(dropped)
    in_templates = characters(template)
    in_furniture = characters(template | furniture) - in_templates
    # Furniture around every article (else main) is opened from outside in, the fullest first, until one is left.
    opened: set[int] = set()
    while (wanted := articles or mains) and all(k in dropped for k in wanted):
        around = set()
        for k in wanted:
            while elements[k].parent in dropped:
                k = elements[k].parent
            if k in furniture and k not in template and elements[k].tag not in NEVER_MAIN and not HIDDEN.search(elements[k].attrs):
                around.add(k)
        if not around:
            return text, in_templates, in_furniture
        opened.add(max(around, key=lambda k: sum(len(pieces[i].strip()) for i in range(elements[k].first, elements[k].last))))
        dropped = without(opened)
    return max(text, text_without(dropped), key=len) if opened else text, in_templates, in_furniture


def count_templates(pages: DataFrame, min_pages: int = MIN_PAGES) -> tuple[DataFrame, DataFrame]:
    """``(host, hash)`` of template subtrees, and the table ``key, host, main, hashes`` of distinct pages.

    A subtree's pages are counted by distinct articles; null html has no subtrees.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [page_hashes(x.as_py()) for x in batch.column(2)]
            mains, hashes = pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), mains, hashes], names=["key", "host", "main", "hashes"])

    keyed = pages.select(F.xxhash64("url", "html").alias("key"), host_of(F.col("url")).alias("host"), "html")
    table = cut(keyed.mapInArrow(run, "key long, host string, main string, hashes array<long>").dropDuplicates(["key"]))
    seen = table.select("host", "main", F.explode("hashes").alias("hash")).distinct().groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    return seen.where(F.col("n") >= min_pages).select("host", "hash"), table


def extract_text(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """``page_id, url, text, template_chars, furniture_chars`` per row of pages (columns page_id, url, html).

    The last two are the characters of text inside template subtrees, and inside other furniture.

    Null or empty html gives an empty text; repeated rows give repeated results; an empty
    table gives an empty result; other columns are ignored.
    """
    prepare(pages.sparkSession)
    templates, table = count_templates(pages, min_pages)
    # A menu is on every page of its host: the templates are broadcast, or else the pages' side of the key is split as skewed.
    hashes = table.select("key", "host", F.explode("hashes").alias("hash"))
    marks = cut(hashes.join(small(cut(templates)), ["host", "hash"]).groupBy("key").agg(F.collect_list("hash").alias("templates")))
    marks = small(marks, BROADCAST_PAGES)
    rows = pages.select("page_id", "url", "html", F.xxhash64("url", "html").alias("key")).join(marks, "key", "left").select("page_id", "url", "html", "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [extract(s.as_py(), set(t.as_py() or ())) for s, t in zip(batch.column(2), batch.column(3))]
            texts, in_templates, in_furniture = (pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts, in_templates, in_furniture], names=["page_id", "url", "text", "template_chars", "furniture_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, template_chars long, furniture_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "template_chars", "furniture_chars")
