"""From fetched pages to nodes and edges of the graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.urls import full_url
from weftline.operators import html
from weftline.schemas import INVERSE, LINK, WEB_METADATA
from weftline.shared import Steps

#: Parts of a page that become nodes.
PART_KINDS = ("Title", "Heading", "Paragraph", "UnorderedPoints", "OrderedPoints", "ListItem")
#: Labels of a page's nodes beside the parts' own.
PAGE_LABELS = {"page": ("Content", "WebPage"), "metadata": ("Content", "WebMetadata")}


def node_id(kind: str, *key: str) -> Column:
    """A node's id from the columns of its natural key, so that a page that comes again gives the same nodes; a missing query differs from all others."""
    return F.xxhash64(F.lit(kind), "project_id", *(F.coalesce(k, F.lit("\0")) if k == "query" else F.col(k) for k in key))


def page_graph(pages: DataFrame, steps: Steps | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of ``pages(project_id, domain, path, query, html, fetched_at)``, one row for each of a link's contents.

    Each page gives its domain, its link, the page itself, its metadata and its
    parts, and the links and domains that it leads to. Edges come with their
    inverse; a page's edges are in the order of its parts. A query that is
    empty is none. Pages that are no HTML give domain, link and page alone.
    """
    steps = steps or Steps(pages.sparkSession, "ingest")
    own = pages.withColumns({"query": F.nullif("query", F.lit("")), "_sha": F.sha2("html", 256)})
    own = own.select("project_id", "domain", "path", "query", "html", F.col("fetched_at").alias("written_at"), node_id("WebPage", "domain", "path", "query", "_sha").alias("page_id"), full_url(F.col("domain"), F.col("path"), F.col("query")).alias("url"))
    own = steps.write(own, "pages")
    parts = steps.write(html.page_parts(own), "parts")  # the one time that pages are parsed
    of = own.select("page_id", "project_id", "written_at")
    kept = parts.where(F.col("kind").isin(*PART_KINDS)).join(of, "page_id")
    found = html.extract_links(own, html.extract_anchors(parts)).join(of, "page_id")
    meta = html.web_metadata(own, parts)
    names = WEB_METADATA.names
    meta = meta.select("page_id", F.struct(*(F.col(c) if c in meta.columns else F.lit(None).cast("string").alias(c) for c in names)).alias("web_metadata")).join(of, "page_id")
    links = own.select("project_id", "domain", "path", "query", "written_at").unionByName(found.select("project_id", "domain", "path", "query", "written_at"))

    def nodes(df: DataFrame, key: Column, labels: Column, text: str | None = None, link: bool = False, metadata: bool = False) -> DataFrame:
        return df.select(
            "project_id", key.alias("node_id"), labels.alias("labels"), (F.col(text) if text else F.lit(None).cast("string")).alias("text"), (F.struct("path", "query") if link else F.lit(None)).cast(LINK).alias("link"),
            (F.col("web_metadata") if metadata else F.lit(None)).cast(WEB_METADATA).alias("web_metadata"), F.lit(0).alias("flags"), "written_at",
        )

    named = lambda *labels: F.array(*map(F.lit, labels))
    domain, link = node_id("DomainName", "domain"), node_id("Link", "domain", "path", "query")
    part, metadata = node_id("Part", "page_id", "pos"), node_id("WebMetadata", "page_id")
    all_nodes = reduce(DataFrame.unionByName, [
        nodes(links, domain, named("DomainName"), "domain"), nodes(links, link, named("Link"), link=True), nodes(own, F.col("page_id"), named(*PAGE_LABELS["page"]), "html"),
        nodes(meta, metadata, named(*PAGE_LABELS["metadata"]), metadata=True), nodes(kept, part, F.array(F.col("kind"), F.lit("Partial")), "text"),
    ])

    def pairs(df: DataFrame, src: Column, dst: Column, label: str, pos: Column) -> DataFrame:
        ends = F.array(F.struct(src.alias("src"), dst.alias("dst"), F.lit(label).alias("label"), pos.cast("int").alias("pos")), F.struct(dst.alias("src"), src.alias("dst"), F.lit(INVERSE[label]).alias("label"), F.lit(0).alias("pos")))
        return df.select("project_id", "written_at", F.explode(ends).alias("e")).select("project_id", "e.src", "e.pos", "e.dst", "e.label", "written_at")

    page, zero = F.col("page_id"), F.lit(0)
    all_edges = reduce(DataFrame.unionByName, [
        pairs(links, domain, link, "OwnerOf", zero), pairs(own, link, page, "PathOf", zero), pairs(meta, page, metadata, "ParentOf", zero),
        pairs(kept, page, part, "ParentOf", F.col("pos") + 1), pairs(found, page, link, "ParentOf", F.lit(2**31 - 1)),
    ])
    return all_nodes, all_edges
