"""Records of HTML pages: one vectorised pass, then DataFrame work on its rows.

``page_parts`` gives, for every page, its parts in document order: titles,
headings, paragraphs, lists, list items, anchors and metadata. ``parent_pos`` is
null for parts of the page itself and the list's pos for list items and for
lists directly inside a list.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import clean_text
from weftline.functions.urls import parse_link, resolve_asset, resolve_href
from weftline.schemas import PARTS
from weftline.shared import arrow_batches, python_rows

# Fixed values of the HTML standard: elements without content, and start tags that end an open paragraph.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements that keep an inner end tag or list item from reaching further out.
BOUNDS = {"p": {"table", "td", "th", "button", "caption", "html", "template"}, "li": {"ul", "ol", "menu", "table", "html"}}
CELLS = {"td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}


class _Element:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            at = stack.pop()
            if isinstance(at, str):
                out.append(at)
            else:
                stack.extend(reversed(at.children))
        return "".join(out)


class _Tree(HTMLParser):
    """A tree with implied ends of paragraphs, list items and cells, and stray ``</p>`` as an empty paragraph."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = _Element("#root", {})
        self.open = [self.root]
        self.feed(html)
        self.close()

    def _end(self, tags: set[str], bounds: set[str]) -> bool:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                del self.open[k:]
                return True
            if self.open[k].tag in bounds:
                return False
        return False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_P:
            self._end({"p"}, BOUNDS["p"])
        if tag == "li":
            self._end({"li"}, BOUNDS["li"])
        elif tag in CELLS:
            self._end(CELLS[tag], {"table", "dl", "select"})
        element = _Element(tag, dict(reversed(attrs)))  # the first of repeated attributes counts
        self.open[-1].children.append(element)
        if tag not in VOID:
            self.open.append(element)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        if not self._end({tag}, BOUNDS.get(tag, {"table"} if tag != "table" else set())) and tag == "p":
            self.open[-1].children.append(_Element("p", {}))

    def handle_data(self, data: str) -> None:
        last = self.open[-1].children
        if last and isinstance(last[-1], str):
            last[-1] += data
        else:
            last.append(data)


def _item_text(item: _Element) -> str:
    """A list item's own text: pieces trimmed and joined, nested lists and tables left out."""
    pieces = [c.strip() if isinstance(c, str) else _item_text(c) if c.tag == "li" else c.text() for c in item.children if isinstance(c, str) or c.tag not in ("ul", "ol", "table")]
    return "".join(pieces)


HEADINGS = {f"h{k}": "Heading" for k in range(1, 7)}
TEXT_KINDS = {"title": "Title", "p": "Paragraph", **HEADINGS}
LISTS = {"ul": "UnorderedPoints", "ol": "OrderedPoints"}


def parts(html: str) -> list[tuple[int | None, str, str | None, str | None, str | None]]:
    """(parent_pos, kind, text, name, value) of a page's parts in document order."""
    out: list[tuple[int | None, str, str | None, str | None, str | None]] = []
    tree = _Tree(html)
    stack: list[tuple[_Element, int | None]] = [(c, None) for c in reversed(tree.root.children) if not isinstance(c, str)]
    while stack:
        at, outer = stack.pop()
        get, inner = at.attrs.get, None
        if at.tag in TEXT_KINDS:
            text = " ".join(at.text().split())
            out.append((None, TEXT_KINDS[at.tag], text, None, None))
            if at.tag == "title":
                out.append((None, "Meta", None, "title", text))
        elif at.tag in LISTS:
            if not at.children:
                continue
            inner = len(out)
            out.append((outer, LISTS[at.tag], None, None, None))
        elif at.tag == "li" and outer is not None:
            out.append((outer, "ListItem", " ".join(_item_text(at).split()), None, None))
        elif at.tag == "a":
            href, text = get("href"), at.text()
            if "href" not in at.attrs or (href or "").startswith("#") or not text:
                continue
            out.append((None, "Anchor", text, None, href or ""))
        elif at.tag == "meta" and get("content") is not None:
            out += [(None, "Meta", None, get(a), get("content")) for a in ("property", "name") if get(a) is not None]
        elif at.tag == "link" and get("href") is not None and "icon" in (get("rel") or ""):
            out.append((None, "Meta", None, "favicon", get("href")))
        stack += [(c, inner) for c in reversed(at.children) if not isinstance(c, str)]
    return out


def html_gate(pages: DataFrame) -> DataFrame:
    """Pages that look like HTML."""
    return pages.where(F.lower("html").contains("<html"))


def part_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of batches of (page_id, html); of a batch only a few pages and some parts are Python objects at once."""
    text = pa.string()
    schema = pa.schema({"page_id": pa.int64(), "pos": pa.int32(), "parent_pos": pa.int32(), "kind": text, "text": text, "name": text, "value": text})
    for batch in batches:
        yield from arrow_batches(((page, pos, *part) for page, html in python_rows(batch) for pos, part in enumerate(parts(html))), schema)


def page_parts(pages: DataFrame) -> DataFrame:
    """All parts of ``pages(page_id, html)``; pages that are not HTML have none. The one place where pages are parsed."""
    return html_gate(pages).select(F.col("page_id").cast("long"), "html").mapInArrow(part_batches, PARTS)


def _kind(found: DataFrame, *kinds: str) -> DataFrame:
    return found.where(F.col("kind").isin(*kinds))


def extract_titles(found: DataFrame) -> DataFrame:
    return _kind(found, "Title").select("page_id", "pos", "text")


def extract_headings(found: DataFrame) -> DataFrame:
    return _kind(found, "Heading").select("page_id", "pos", "text")


def extract_paragraphs(found: DataFrame) -> DataFrame:
    return _kind(found, "Paragraph").select("page_id", "pos", "text")


def extract_lists(found: DataFrame) -> DataFrame:
    return _kind(found, "UnorderedPoints", "OrderedPoints").select("page_id", "pos", "kind", "parent_pos")


def extract_list_items(found: DataFrame) -> DataFrame:
    return _kind(found, "ListItem").select("page_id", "pos", F.col("parent_pos").alias("list_pos"), "text")


def extract_anchors(found: DataFrame) -> DataFrame:
    return _kind(found, "Anchor").select("page_id", "pos", F.col("value").alias("href"), F.col("text").alias("anchor_text"))


def extract_links(pages: DataFrame, anchors: DataFrame, known_domains: DataFrame | None = None) -> DataFrame:
    """Distinct (page_id, domain, path, query) that anchors lead to.

    An ``https://`` href may name a new domain; any other must hit a known one:
    those of the pages, of all ``https://`` anchors, and of ``known_domains(domain)``.
    Links are made distinct first, with a flag for ``https://`` hrefs; that
    shuffle is what Spark reuses, so pages are parsed once.
    """
    on = anchors.join(pages.select("page_id", F.col("url").alias("base")), "page_id")
    links = on.select("page_id", F.col("href").startswith("https://").alias("absolute"), resolve_href(F.col("base"), F.col("href")).alias("l")).select("page_id", "absolute", "l.*").where("domain is not null")
    links = links.groupBy("page_id", "domain", "path", "query").agg(F.bool_or("absolute").alias("absolute"))
    known = links.where("absolute").select("domain").union(pages.select(parse_link(F.col("url"))["domain"].alias("domain")))
    if known_domains is not None:
        known = known.union(known_domains.select("domain"))
    known = known.distinct().select("domain", F.lit(True).alias("known"))
    return links.join(known, "domain", "left").where("absolute or known").select("page_id", "domain", "path", "query")


#: Metadata fields by what an attribute's name contains (the first that matches), and which value counts.
METADATA = (
    ("url", "url", "first"), ("site_name", "site_name", "last"), ("favicon", "favicon", "first"), ("image", "image", "first"), ("thumbnail", "image", "first"), ("title", "title", "first"),
    ("description", "description", "last"), ("tags", "tags", "all"), ("keywords", "tags", "all"), ("published_time", "published_time", "last"), ("modified_time", "modified_time", "last"),
    ("updated_time", "modified_time", "last"), ("author", "author", "last"), ("creator", "creator", "last"), ("lang", "language", "last"), ("locale", "locale", "last"),
)

#: What the address of an icon holds.
ICON = r"fav|apple-touch|\.ico"


def web_metadata(pages: DataFrame, found: DataFrame, mode: str = "default") -> DataFrame:
    """One row of metadata for each page of ``pages(page_id, url, html)`` that is HTML.

    ``url`` is the page's own. Image names with ``width`` or ``height`` are
    skipped; ``mode="reference"`` takes those and no others, as image sources.
    An image whose address looks like an icon's (``ICON``) counts as the favicon.
    """
    low = F.lower("name")
    field = F.coalesce(*(F.when(low.contains(part), F.lit(name)) for part, name, _ in METADATA))
    icon = F.col("value").rlike(ICON)
    sized = low.contains("width") | low.contains("height")
    base = html_gate(pages).select("page_id", "url")
    rows = _kind(found, "Meta").where("value is not null and value != ''").select("page_id", "pos", field.alias("field"), "name", "value", sized.alias("sized"))
    rows = rows.where((F.col("field") != "image") | (F.col("sized") if mode == "reference" else ~F.col("sized")))
    asset = F.col("field").isin("image", "favicon")
    rows = rows.withColumn("field", F.when((F.col("field") == "image") & icon, "favicon").otherwise(F.col("field"))).join(base, "page_id")
    value = F.when(asset, resolve_asset(F.when(asset, F.col("url")), F.when(asset, F.col("value")))).otherwise(F.col("value"))
    rows = rows.select("page_id", "pos", "field", value.alias("value"))
    pick = {"first": F.min_by, "last": F.max_by}
    rules = {name: rule for _, name, rule in METADATA if name not in ("url", "tags")}
    own = [pick[rule](F.when(F.col("field") == name, F.col("value")), F.when(F.col("field") == name, F.col("pos"))).alias(name) for name, rule in sorted(rules.items())]
    tags = F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == "tags", F.struct("pos", "value")))), lambda t: t["value"]).alias("tags")
    per_page = rows.groupBy("page_id").agg(*own, tags)
    return base.join(per_page, "page_id", "left").select("page_id", *sorted(rules), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "url")


def page_content(found: DataFrame) -> DataFrame:
    """(page_id, content): texts of the page's own parts in order, a blank line between them; list items are not among them."""
    own = _kind(found, "Title", "Heading", "Paragraph")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda p: p["text"]), "\n\n")
    return own.groupBy("page_id").agg(joined.alias("content"))
