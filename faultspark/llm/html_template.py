"""Main text of web pages, with site templates removed.

Pages are parsed to elements and text segments. The subtree of every element
that may be a template is hashed; Spark counts, for each host, on how many
different pages a subtree occurs, and subtrees that recur on many pages of
their host are deleted. Elements that say what they are by tag, role, class or
id (menus, headers, footers, sidebars, notices, adverts, forms, comments,
scripts) go too. A class says so if it is made of such words and of words for
place and shape only (main-nav, left-sidebar; but not has-sidebar, entry-header,
notice-board). Where every article stands in an element so named, that
element stays. What is left of the article, or of the body if a page marks none,
is the text. Parsing takes a time in proportion to the page, however broken.

An article, what holds it, and its paragraphs, headings and lists are never
taken for a template, nor are copies of a whole page: they count once. On a page
without an article paragraphs, headings, lists and tables may be templates, but
not the inline elements in them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultspark.llm import arrow, work

MIN_PAGES = 5
SHARE = 0.3
MANY = 20
BROADCAST_ROWS = 500_000
BATCH_BYTES = 1 << 22

# Names of the HTML standard, and words that mark page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var td th wbr img".split())
GONE = frozenset("nav footer aside script style noscript template iframe object button select textarea svg canvas dialog menu head title audio video map input option fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs topbar masthead header footer "
    "share sharing social related recommended login search toolbar pagination pager skip".split()
)
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
SHAPES = frozenset(
    "site main page global top bottom left right upper lower box block slot unit area container wrapper wrap inner outer bar list links link buttons button "
    "section panel row col column item items icons icon posts articles stories primary secondary mobile desktop sticky fixed text message".split()
)
KEPT = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote table tbody thead tr td th figure figcaption".split()) | INLINE
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDS = frozenset("ul ol dl table article main section div body td th blockquote".split())

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)
    |<(?P<raw>script|style|textarea|title|xmp|noembed|noframes)\b(?:[^<>"']|"[^"]*"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)
    |<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>"']{0,63})(?P<attrs>(?:[^<>"']|"[^"]*"|'[^']*')*+)>""",
    re.S | re.I | re.X,
)
ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
NUMBER = re.compile(r"&#(?:([xX])0*([0-9a-fA-F]+)|0*([0-9]+))")
DEPTH = 512


def unescape(raw: str) -> str:
    """``raw`` with its character references decoded, numbers of any length included."""
    if "&#" in raw:
        raw = NUMBER.sub(lambda m: f"&#{m[1] or ''}{m[2] or m[3]}" if len(m[2] or m[3]) <= 8 else "&#xFFFD", raw)
    return html.unescape(raw)


def furniture(name: str, words: frozenset[str]) -> bool:
    """Whether a class is one of the words, beside words for place and shape."""
    found = {w.lower() for w in PARTS.findall(name)}
    return not words.isdisjoint(found) and found <= words | WORDS | SHAPES


class Page:
    """Elements and text segments of one page.

    Element k has tag[k], parent[k], gone[k] (by what it says of itself),
    soft[k] (by its class, or as a form or header), article[k] (the article or
    main that it is or is in, or -1), digest[k]. A segment is (element, block,
    text). Elements nested deeper than ``DEPTH`` are read as their parent's."""

    def __init__(self, source: str):
        self.tag, self.parent, self.gone, self.soft, self.article, self.digest = ["#"], [-1], [False], [False], [-1], [b""]
        self.segments: list[tuple[int, int, str]] = []
        parts: list[list[bytes]] = [[]]
        stack, block, at = [0], 0, 0
        opened: dict[str, int] = {}
        deeper: dict[str, int] = {}

        def close() -> None:
            k = stack.pop()
            opened[self.tag[k]] -= 1
            self.digest[k] = xxhash.xxh64_digest(b"\0".join(parts[k]))
            parts[stack[-1]].append(self.digest[k])
            parts[k] = []

        def text(raw: str) -> None:
            if raw and not raw.isspace():
                self.segments.append((stack[-1], block, unescape(raw)))
                parts[stack[-1]].append(" ".join(raw.split()).encode("utf-8", "replace"))
            elif raw:
                self.segments.append((stack[-1], block, " "))

        for m in TOKEN.finditer(source):
            text(source[at : m.start()])
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if tag == "br":
                self.segments.append((stack[-1], block, " "))
                continue
            if tag in ("td", "th"):
                self.segments.append((stack[-1], block, " "))
            elif tag not in INLINE:
                block += 1
            if m["end"]:
                if deeper.get(tag):
                    deeper[tag] -= 1
                elif opened.get(tag):
                    while self.tag[stack[-1]] != tag:
                        close()
                    close()
                continue
            if tag not in INLINE and tag not in VOID and any(opened.get(t) for t in ("p", *CLOSES.get(tag, ()))):
                self._imply(stack, tag, close)
            if tag in VOID:
                continue
            k, up = len(self.tag), stack[-1]
            if len(stack) > DEPTH:
                deeper[tag] = deeper.get(tag, 0) + 1
                continue
            gone, soft, article, name = self._look(tag, m["attrs"], up)
            self.tag.append(tag)
            self.parent.append(up)
            self.gone.append(gone)
            self.soft.append(soft)
            self.article.append(k if article and self.article[up] < 0 else self.article[up])
            self.digest.append(b"")
            parts.append([name.encode("utf-8", "replace")])
            stack.append(k)
            opened[tag] = opened.get(tag, 0) + 1
        text(source[at:])
        while len(stack) > 1:
            close()
        within = [False] * len(self.tag)
        for k in range(1, len(self.tag)):
            up = self.parent[k]
            self.gone[k] = self.gone[k] or self.gone[up]
            within[k] = within[up] or self.soft[up]
        articles = {a for a in self.article if a >= 0 and not self.gone[a]}
        real = {self.article[k] for k, tag in enumerate(self.tag) if tag == "article" and not self.gone[k]} & articles
        articles = real or articles
        self.roots = {a for a in articles if not (within[a] or self.soft[a])} or articles
        self.holds: set[int] = set()
        for a in self.roots:
            while a >= 0 and a not in self.holds:
                self.holds.add(a)
                a = self.parent[a]
        for k in range(1, len(self.tag)):
            self.gone[k] = self.gone[k] or self.gone[self.parent[k]] or self.soft[k] and k not in self.holds

    def _imply(self, stack: list[int], tag: str, close) -> None:
        """End what a start tag ends: an open p, or the like of it in its list or table."""
        for depth in range(len(stack) - 1, 0, -1):
            open_tag = self.tag[stack[depth]]
            if open_tag == "p" or open_tag in CLOSES.get(tag, ()):
                while len(stack) > depth:
                    close()
                return
            if open_tag in HOLDS:
                return

    def _look(self, tag: str, attrs: str, up: int) -> tuple[bool, bool, bool, str]:
        name, named, article = tag, [], tag in ("article", "main")
        gone, soft = tag in GONE, tag == "form" or tag == "header" and self.article[up] < 0
        for m in ATTR.finditer(attrs) if attrs else ():
            key, value = m[1].lower(), (m[2] or "").strip("\"'")
            if key in ("class", "id"):
                name += f" {key}={value}"
                named += value.split()
            elif key == "role":
                gone, article = gone or value.lower() in ROLES, article or value.lower() in ("main", "article")
            elif key == "itemprop":
                article = article or value.lower() == "articlebody"
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                gone = True
        if tag not in ("html", "body", "main"):
            gone = gone or any(furniture(n, COMMENTS) for n in named)
            soft = soft or tag not in ("article", "header") and any(furniture(n, WORDS) for n in named)
        return gone, soft, article and not gone, name

    def candidates(self) -> list[tuple[int, bytes]]:
        """Elements that may be a template, with their digests."""
        return [(k, self.digest[k]) for k in range(1, len(self.tag)) if k not in self.holds and self.tag[k] not in ("html", "body", "head") and not (self.tag[k] in KEPT and (self.article[k] >= 0 or not self.roots and self.tag[k] in INLINE))]

    def text(self, templates) -> str:
        """Blocks of the main text; templates tells of a digest whether it is one."""
        out = list(self.gone)
        for k, digest in self.candidates():
            if templates(digest):
                out[k] = True
        for k in range(1, len(out)):
            out[k] = out[k] or out[self.parent[k]]
        blocks: dict[int, list[str]] = {}
        for k, block, text in self.segments:
            if not out[k] and (not self.roots or self.article[k] in self.roots):
                blocks.setdefault(block, []).append(text)
        lines = (" ".join("".join(b).split()) for b in blocks.values())
        return "\n".join(x for x in lines if x)


def host(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _key(site: str, digest: bytes) -> int:
    return xxhash.xxh64_intdigest(site.encode("utf-8", "replace") + b"\0" + digest) - (1 << 63)


def subtrees(pages: DataFrame) -> DataFrame:
    """(site, body, key): a page's host, its hash, and each subtree's hash with the host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sites, bodies, keys = [], [], []
            for url, source in zip(batch.column(0), arrow.text_bytes(batch.column(1))):
                site, page = host(url.as_py()), Page(source.decode("utf-8", "replace"))
                found = {_key(site, d) for _, d in page.candidates()}
                keys.extend(found)
                sites.extend([site] * len(found))
                bodies.extend([xxhash.xxh64_intdigest(source) - (1 << 63)] * len(found))
            yield pa.RecordBatch.from_arrays([pa.array(sites, pa.string()), pa.array(bodies, pa.int64()), pa.array(keys, pa.int64())], ["site", "body", "key"])

    return pages.select(F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "site string, body bigint, key bigint")


def _keyed(pages: DataFrame) -> DataFrame:
    """Pages with the columns site and body of ``subtrees``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sites = [host(u) for u in batch.column(1).to_pylist()]
            bodies = [xxhash.xxh64_intdigest(t) - (1 << 63) for t in arrow.text_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sites, pa.string()), pa.array(bodies, pa.int64())], [*batch.schema.names, "site", "body"])

    return pages.mapInArrow(run, "page_id bigint, url string, html string, site string, body bigint")


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """Keys of subtrees on at least ``min_pages`` different pages of their host and
    at least a ``share`` of them, or on ``MANY`` whatever the host's size."""
    found = work.cut(subtrees(pages).distinct(), "subtrees")
    sites = found.select("site", "body").distinct().groupBy(F.col("site").alias("of")).agg(F.count("*").alias("pages"))
    often = found.groupBy("site", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    return often.join(sites, F.col("site") == F.col("of")).where(F.col("n") >= F.least(share * F.col("pages"), F.lit(MANY))).select("key")


def _render(rows: DataFrame, known: set[int] | None) -> DataFrame:
    """Texts of (page_id, url, html, keys); keys are looked up in ``known`` if that is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, texts, held = [], [], [], 0
            for i, url, source, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), arrow.text_bytes(batch.column(2)), batch.column(3).to_pylist()):
                site, marks = host(url), known if known is not None else frozenset(keys or ())
                ids.append(i)
                urls.append(url)
                texts.append(Page(source.decode("utf-8", "replace")).text(lambda d, site=site, marks=marks: _key(site, d) in marks))
                held += len(source)
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string())], ["page_id", "url", "text"])
                    ids, urls, texts, held = [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return rows.mapInArrow(run, "page_id bigint, url string, text string")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Null and empty html give an empty text; a null url is a host of its own;
    null ids and repeated rows give a row each. Broken markup is read as far as
    it goes. Only the three named columns are read. Templates are sent to all
    tasks if they are few, else joined to their pages."""
    narrow = work.bound_batches(pages).select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    found = work.cut(templates(narrow, min_pages, share), "templates")
    none = F.lit(None).cast("array<bigint>")
    if found.count() <= broadcast_rows:
        texts = _render(narrow.select("*", none.alias("keys")), {r[0] for r in found.collect()})
    else:
        marked = subtrees(narrow).distinct().join(found.withColumnRenamed("key", "template"), F.col("key") == F.col("template"))
        keyed = work.cut(marked.groupBy(F.col("site").alias("of"), F.col("body").alias("hash")).agg(F.collect_set("key").alias("keys")), "keyed")
        # The key of a page: its url and a hash of its html, as subtrees() has them.
        own = _keyed(narrow)
        texts = _render(own.join(keyed, F.col("site").eqNullSafe(F.col("of")) & (F.col("body") == F.col("hash")), "left").select("page_id", "url", "html", "keys"), None)
    return texts.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op5_html_template(spark, sf_dir: str) -> DataFrame:
    return extract(work.read(spark, sf_dir, "pages"))
