"""Page facts from raw HTML, as one Arrow-batched Spark job.

``extract_pages(crawl)`` is the only per-row Python step of an audit. It runs
as ``mapInPandas`` (no shuffle, one pass, batches of rows), takes the crawl
rows with their HTML, and returns them with the extracted columns and without
the HTML. Everything downstream is native Spark expressions.

Parsing uses the standard-library tokenizer with a tree builder that repairs
tag soup: a start tag ends the open elements that can't hold it (``ENDS``: an
unclosed link, heading, cell, row, term, option, paragraph), an end tag ends
what is open inside its element but doesn't reach out of a table cell, row or
block (``END_RANK``). Strings are gathered in one pass; an element's text is a
slice of them.
"""

from __future__ import annotations

import json
import re
import sys
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteaudit.session import bounded_batches

# Ship this module's code with the task (pickled by value): executors then need
# only the standard library and pandas, not an installed copy of the package.
try:
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle without the API
    pass

VOID = frozenset("area base br col embed frame hr img input isindex link meta param source track wbr keygen".split())
#: Start tags that end an open <p>, also through inline elements inside it, but not out of one of ``P_SCOPE``.
CLOSES_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li".split())
P_SCOPE = frozenset("button table td th html body article div section nav header footer aside main".split())
#: Elements whose strings are no text of the elements around them.
MUTE = frozenset("script style template rt rp".split())
SKIP_HREF_PREFIXES = ("#", "mailto:", "tel:", "javascript:")


def _implied_ends() -> dict[str, frozenset[str]]:
    """For a start tag: the elements that it ends while one of them is the innermost open element.

    Fixed values of the tag-soup rules that lenient HTML parsers share.
    """
    headings = "h1 h2 h3 h4 h5 h6".split()
    styles = "tt i b u s strike big small".split()
    old_blocks = "menu dir address pre listing xmp".split()
    cell_text = "p span font a b i u".split()
    columns = "caption col colgroup p".split()
    ends: dict[str, set[str]] = {}

    def rule(tags: str | list[str], *closed: str | list[str]) -> None:
        for tag in tags.split() if isinstance(tags, str) else tags:
            for group in closed:
                ends.setdefault(tag, set()).update(group.split() if isinstance(group, str) else group)

    rule("address blockquote center dir div dl dt dd hr listing menu ol pre ul xmp title body frameset head", "p")
    rule(headings, "p", headings)
    for tag in headings:
        ends[tag].discard(tag)
    rule("p", "p", headings, styles)
    rule("li", "p li dl", headings, "address pre listing xmp")
    rule("form", "form p hr dl ul ol", headings, old_blocks)
    rule("dl", "p dt", old_blocks)
    rule("dt", "p dt dd", old_blocks)
    rule("dd", "p dt dd", old_blocks)
    rule("ul", "p ol", old_blocks)
    rule("ol", "p ul")
    rule("menu", "p ul")
    rule("pre address", "p ul")
    rule("center", "font b i p")
    rule("a", "a")
    rule("fieldset", "legend p a pre listing xmp", headings)
    rule("table", "p a pre listing xmp", headings)
    rule("caption", "p")
    rule("colgroup col", columns)
    rule("td th", "td th", cell_text)
    rule("tr", "td th tr", columns)
    rule("thead", columns)
    rule("tbody tfoot", "td th tr thead tbody tfoot", columns)
    rule("option optgroup", "option")
    rule("body frameset", "head style link title")
    rule("noscript", "script")
    return {tag: frozenset(closed) for tag, closed in ends.items()}


ENDS = _implied_ends()
#: An end tag passes over open elements of its own rank or below; one of a higher rank makes it void.
END_RANK = {"div": 1, "td": 2, "th": 2, "tr": 3, "thead": 4, "tbody": 4, "tfoot": 4, "table": 5, "head": 6, "body": 6, "html": 7}


class _Node:
    """An element. ``first`` and ``last`` bound its strings among those of the document."""

    __slots__ = ("tag", "attrs", "children", "first", "last")

    def __init__(self, tag, attrs, first):
        self.tag = tag
        self.attrs = attrs
        self.children = []
        self.first = first
        self.last = None

    def get(self, key, default=None):
        return self.attrs.get(key, default)

    def string(self):
        """The single string below a chain of single children, else None."""
        node = self
        while isinstance(node, _Node):
            if len(node.children) != 1:
                return None
            node = node.children[0]
        return node


class _TreeBuilder(HTMLParser):
    """Elements in document order, and the visible strings once, which elements point into.

    An element's text is a slice of ``strings``, so that a document is read once however deep its elements nest.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements: list[_Node] = []
        self.strings: list[str] = []
        self.stack = [_Node("#document", {}, 0)]
        self.open: Counter[str] = Counter()     # open elements by tag
        self.mute = 0
        self.data: list[str] = []

    def updatepos(self, i, j):
        """Line numbers, which the tokenizer would count at every token, aren't asked for."""
        return j

    def handle_starttag(self, tag, attrs):
        self._end_string()
        if self.open["p"] and tag in CLOSES_P:
            self._close_p()
        ended = ENDS.get(tag)
        while ended and self.stack[-1].tag in ended:
            self._pop()
        node = _Node(tag, {k: (v if v is not None else "") for k, v in reversed(attrs)}, len(self.strings))
        self.stack[-1].children.append(node)
        self.elements.append(node)
        if tag in VOID:
            node.last = node.first
        else:
            self.stack.append(node)
            self.open[tag] += 1
            self.mute += tag in MUTE

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.stack[-1].tag == tag and tag not in VOID:
            self._pop()

    def handle_endtag(self, tag):
        self._end_string()
        if not self.open[tag]:
            return
        rank = END_RANK.get(tag, 0)
        for node in reversed(self.stack):
            if node.tag == tag:
                break
            if END_RANK.get(node.tag, 0) > rank:
                return
        while self._pop() != tag:
            pass

    def handle_data(self, data):
        self.data.append(data)

    def handle_comment(self, data):
        self._end_string()
        self.stack[-1].children.append(None)

    def close(self):
        super().close()
        self._end_string()
        while len(self.stack) > 1:
            self._pop()

    def _close_p(self):
        for node in reversed(self.stack):
            if node.tag == "p":
                while self._pop() != "p":
                    pass
                return
            if node.tag in P_SCOPE:
                return

    def _pop(self) -> str:
        node = self.stack.pop()
        node.last = len(self.strings)
        self.open[node.tag] -= 1
        self.mute -= node.tag in MUTE
        return node.tag

    def _end_string(self):
        if not self.data:
            return
        text = "".join(self.data)
        self.data.clear()
        if text:
            self.stack[-1].children.append(text)
            shown = text.strip()
            if shown and not self.mute:
                self.strings.append(shown)

    def text(self, node: _Node, sep: str, chars: int | None = None) -> str:
        """The strings inside ``node``; with ``chars``, no further than that many characters."""
        if chars is None:
            return sep.join(self.strings[node.first:node.last])
        parts, length = [], 0
        for i in range(node.first, node.last):
            parts.append(self.strings[i])
            length += len(parts[-1]) + len(sep)
            if length >= chars + len(sep):
                break
        return sep.join(parts)[:chars]


# Character references are decoded only when complete (`&name;`, `&#n;`), as the
# libxml2 HTML parser does; a bare `&amp` stays literal text. Script and style
# bodies are raw text and left untouched.
_BARE_AMP = re.compile(r"(<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>)|&(?!#?[A-Za-z0-9]+;)",
                       re.S | re.I)


def _escape_bare_amp(html: str) -> str:
    if "&" not in html:
        return html
    return _BARE_AMP.sub(lambda m: m.group(1) or "&amp;", html)


def parse_html(html: str) -> _TreeBuilder:
    html = _escape_bare_amp(html)
    b = _TreeBuilder()
    try:
        b.feed(html)
        b.close()
    except Exception:  # tokenizer errors keep what was built so far
        while len(b.stack) > 1:
            b._pop()
    return b


def _rel_has(node: _Node, token: str) -> bool:
    return token in node.get("rel", "").split()


def _host_key(netloc: str) -> str:
    h = netloc.lower()
    return h[4:] if h.startswith("www.") else h


def extract_fields(html: str | None, page_url: str) -> dict:
    """All page facts of one HTML document."""
    out = {
        "title": "", "meta_description": "", "html_lang": "", "h1_texts": [], "h2_texts": [],
        "canonical": "", "og": {}, "hreflang": [], "schema_blocks": [], "schema_types": [], "schema_raw_count": 0,
        "image_alt_total": 0, "image_alt_missing": 0, "first_paragraph": "",
        "raw_links": [], "internal_links": [],
    }
    if html is None:
        return out
    doc = parse_html(html)
    first = {}
    h1s, h2s, og, hreflang, blocks, links, raw = [], [], {}, [], [], [], []
    img_total = img_missing = 0
    after_h1 = False
    page_url = page_url if isinstance(page_url, str) else ""
    page_host = _host_of(page_url)
    for el in doc.elements:
        tag = el.tag
        if tag == "p" and after_h1 and "p" not in first:
            first["p"] = el
        if tag == "title":
            first.setdefault("title", el)
        elif tag == "html":
            first.setdefault("html", el)
        elif tag == "meta":
            if "name" in el.attrs and el.attrs["name"] == "description":
                first.setdefault("desc", el)
            if "property" in el.attrs:
                prop = el.attrs["property"]
                if prop.startswith("og:") and el.get("content"):
                    og[prop] = el.attrs["content"].strip()
        elif tag == "h1":
            h1s.append(doc.text(el, ""))
            if not after_h1:
                after_h1 = True
        elif tag == "h2":
            h2s.append(doc.text(el, ""))
        elif tag == "link":
            if _rel_has(el, "canonical"):
                first.setdefault("canonical", el)
            if _rel_has(el, "alternate"):
                hl, href = el.get("hreflang"), el.get("href")
                if hl and href:
                    hreflang.append({"lang": hl.strip(), "href": href.strip()})
        elif tag == "script":
            if el.attrs.get("type") == "application/ld+json":
                s = el.string()
                if s:
                    blocks.extend(_jsonld_blocks(s))
        elif tag == "img":
            if el.get("role") != "presentation" and el.get("aria-hidden", "").lower() != "true":
                img_total += 1
                if not (el.get("alt") or "").strip():
                    img_missing += 1
        elif tag == "a" and "href" in el.attrs:
            href = el.attrs["href"].strip()
            if not href or href.startswith(SKIP_HREF_PREFIXES):
                continue
            anchor = doc.text(el, " ", ANCHOR_CHARS)
            raw.append({"pos": len(raw), "href": href, "anchor": anchor})
            try:
                absolute = urljoin(page_url, href)
            except ValueError:          # no URL: the link goes, the page stays
                continue
            if not absolute.startswith(("http://", "https://")):
                continue
            host = _host_of(absolute)
            if host is None or host != page_host:
                continue
            links.append({"pos": len(links), "target": absolute.split("#", 1)[0],
                          "anchor": anchor})
    t = first.get("title")
    if t is not None:
        s = t.string()
        if s:
            out["title"] = s.strip()
    d = first.get("desc")
    if d is not None and d.get("content"):
        out["meta_description"] = d.attrs["content"].strip()
    h = first.get("html")
    if h is not None and h.get("lang"):
        out["html_lang"] = h.attrs["lang"].strip()
    c = first.get("canonical")
    if c is not None and c.get("href"):
        out["canonical"] = c.attrs["href"].strip()
    p = first.get("p")
    if p is not None:
        out["first_paragraph"] = doc.text(p, " ")
    out.update(h1_texts=h1s, h2_texts=h2s, og=og, hreflang=hreflang, schema_blocks=[text for text, _ in blocks],
               schema_types=sorted({t for _, types in blocks for t in types}),
               schema_raw_count=len(blocks), image_alt_total=img_total,
               image_alt_missing=img_missing, raw_links=raw, internal_links=links)
    return out


def _host_of(url: str) -> str | None:
    """Host key of a URL; None where it can't be parsed."""
    try:
        return _host_key(urlparse(url).netloc)
    except ValueError:
        return None


#: Characters of a link's text that are kept.
ANCHOR_CHARS = 200
#: Characters of an unreadable JSON-LD script that are shown.
SNIPPET_CHARS = 120


def _whole(text: str) -> str:
    """``text`` with halves of surrogate pairs replaced, so that it can be encoded."""
    return text.encode("utf-8", "replace").decode("utf-8")


def _types_of(tree) -> set[str]:
    """The @type strings of a JSON-LD tree: of its node, and of those in lists of @graph, to any depth."""
    found, todo = set(), [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, list):
            todo.extend(node)
        elif isinstance(node, dict):
            kinds = node.get("@type")
            found.update(_whole(t) for t in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(t, str))
            if isinstance(node.get("@graph"), list):
                todo.extend(node["@graph"])
    return found


def _jsonld_blocks(text: str) -> list[tuple[str, set[str]]]:
    """JSON-LD script body to strict JSON strings (NaN and Infinity as null) with their types; a top-level list is flattened."""
    try:
        data = json.loads(text.strip(), parse_constant=lambda _: None)
        items = data if isinstance(data, list) else [data]
        return [(_whole(json.dumps(x, ensure_ascii=False)), _types_of(x)) for x in items]
    except (ValueError, RecursionError):
        return [(_whole(json.dumps({"__parse_error": True, "_raw_snippet": text[:SNIPPET_CHARS]}, ensure_ascii=False)), set())]


EXTRACTED_FIELDS = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("meta_description", T.StringType()),
    T.StructField("html_lang", T.StringType()),
    T.StructField("h1_texts", T.ArrayType(T.StringType())),
    T.StructField("h2_texts", T.ArrayType(T.StringType())),
    T.StructField("canonical", T.StringType()),
    T.StructField("og", T.MapType(T.StringType(), T.StringType())),
    T.StructField("hreflang", T.ArrayType(T.StructType([
        T.StructField("lang", T.StringType()), T.StructField("href", T.StringType())]))),
    T.StructField("schema_blocks", T.ArrayType(T.StringType())),
    T.StructField("schema_types", T.ArrayType(T.StringType())),
    T.StructField("schema_raw_count", T.IntegerType()),
    T.StructField("image_alt_total", T.IntegerType()),
    T.StructField("image_alt_missing", T.IntegerType()),
    T.StructField("first_paragraph", T.StringType()),
    T.StructField("raw_links", T.ArrayType(T.StructType([
        T.StructField("pos", T.IntegerType()), T.StructField("href", T.StringType()),
        T.StructField("anchor", T.StringType())]))),
    T.StructField("internal_links", T.ArrayType(T.StructType([
        T.StructField("pos", T.IntegerType()), T.StructField("target", T.StringType()),
        T.StructField("anchor", T.StringType())]))),
])


def _parseable(status: Column) -> Column:
    # Error bodies (>= 400) and failed fetches (0) are not parsed.
    return (status > 0) & (status < 400)


def batch_fields(htmls: pd.Series, bases: pd.Series) -> list[dict]:
    return [extract_fields(h if isinstance(h, str) else None, b) for h, b in zip(htmls, bases)]


def extract_pages(crawl: DataFrame, html_col: str = "html") -> DataFrame:
    """crawl rows (with ``html``) -> page rows with X1-X13 columns, without HTML.

    ``final_url`` (or ``url``) is the base of link resolution. The HTML of
    rows that are not parsed is dropped before the Python boundary, so only
    parseable bodies cross to the workers, in batches of bounded bytes: a worker
    holds the facts of one batch, however many pages its task has.
    """
    bounded_batches(crawl.sparkSession)
    keys = [c for c in crawl.columns if c != html_col]
    src = crawl.select(*keys, F.when(_parseable(F.col("status_code")), F.col(html_col)).alias("__html"),
                       F.coalesce(F.nullif(F.col("final_url"), F.lit("")), F.col("url")).alias("__base"))
    in_fields = {f.name: f for f in src.schema.fields}
    out_schema = T.StructType([in_fields[k] for k in keys] + list(EXTRACTED_FIELDS.fields))
    names = [f.name for f in EXTRACTED_FIELDS.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = batch_fields(pdf["__html"], pdf["__base"])
            res = pdf[keys].copy()
            for n in names:
                res[n] = [r[n] for r in rows]
            yield res

    return src.mapInPandas(run, out_schema)


def with_empty_facts(pages: DataFrame) -> DataFrame:
    """Rows without extracted facts get those of a page that wasn't parsed."""
    empty = {"string": F.lit(""), "int": F.lit(0)}
    return pages.withColumns({f.name: F.coalesce(F.col(f.name), empty[f.dataType.simpleString()]) if f.dataType.simpleString() in empty
                              else F.coalesce(F.col(f.name), F.from_json(F.lit("{}" if isinstance(f.dataType, T.MapType) else "[]"), f.dataType))
                              for f in EXTRACTED_FIELDS.fields})
