"""Graph queries over nodes(project_id, node_id, labels, text, …) and edges(project_id, src, pos, dst, label, written_at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.urls import full_url
from weftline.schemas import EXPLORED_LABELS, NODE_LABELS, WORKFLOW_LABELS
from weftline.shared import Steps


def _any_label(labels: tuple[str, ...]) -> Column:
    return F.arrays_overlap("labels", F.array(*map(F.lit, labels)))


def nodes_with_label(nodes: DataFrame, label: str) -> DataFrame:
    """Nodes that have the label, in id order; a label that no node can have is an error."""
    if label not in NODE_LABELS:
        raise ValueError(f"unknown label: {label}")
    return nodes.where(F.array_contains("labels", label)).orderBy("node_id")


def nodes_with_ids(nodes: DataFrame, ids: str) -> DataFrame:
    """Nodes of a comma-separated list of ids, in id order; unknown ids are ignored, repeated ones repeat."""
    wanted = nodes.sparkSession.createDataFrame([(int(k),) for k in ids.split(",") if k.strip()], "node_id long")
    return nodes.join(F.broadcast(wanted), "node_id").select(*nodes.columns).orderBy("node_id")


def nodes_since(nodes: DataFrame, ms: int = 0) -> DataFrame:
    return nodes.where(F.unix_millis("written_at") > ms).orderBy("node_id")


def edges_since(edges: DataFrame, ms: int = 0) -> DataFrame:
    """(src, pos, dst, label, written_at): all edges of every source that changed after ms, with the source's last change in milliseconds.

    A row an edge, so a hub's edges are never in one row. A stored graph answers
    the same from its change log, without a shuffle (``tables.edges_changed_since``).
    """
    last = edges.groupBy("src").agg(F.max(F.unix_millis("written_at")).alias("changed")).where(F.col("changed") > ms)
    return edges.join(last, "src").select("src", "pos", "dst", "label", F.col("changed").alias("written_at"))


def distinct_labels(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode("labels").alias("label")).distinct()


def neighbors(edges: DataFrame, ids: DataFrame, label: str) -> DataFrame:
    """(src, dst, pos) of the distinct neighbours of ``ids(src)`` over one label, pos by first mention."""
    return edges.where(F.col("label") == label).join(ids.select("src").distinct(), "src", "left_semi").groupBy("src", "dst").agg(F.min("pos").alias("pos"))


def first_neighbor(edges: DataFrame, label: str) -> DataFrame:
    """(src, dst): each source's first neighbour over a label, by an aggregate instead of a window."""
    return edges.where(F.col("label") == label).groupBy("src").agg(F.min(F.struct("pos", "dst")).alias("m")).select("src", F.col("m.dst").alias("dst"))


def page_urls(nodes: DataFrame, edges: DataFrame, url_rule: str = "own") -> DataFrame:
    """(page_id, url): page → its link → the link's domain.

    ``url_rule="first_outgoing"`` takes the first link that the page itself
    leads to, whatever the edge, as the classification report does. Pages meet
    their edges by node, and so do links: with bucketed tables
    (``sources.bucketed``) neither moves. What then moves is a pair of ids a page.
    """
    pages = nodes.where(F.array_contains("labels", "WebPage")).select(F.col("node_id").alias("page_id"))
    links = nodes.where(F.array_contains("labels", "Link")).select(F.col("node_id").alias("link_id"), "link.path", "link.query")
    if url_rule == "own":
        first = first_neighbor(edges, "ContentOf")
    else:
        outgoing = edges.where("label = 'ParentOf'").join(links.select(F.col("link_id").alias("dst")), "dst", "left_semi")
        first = outgoing.groupBy("src").agg(F.min(F.struct("pos", "dst")).alias("m")).select("src", F.col("m.dst").alias("dst"))
    own = pages.join(first.select(F.col("src").alias("page_id"), F.col("dst").alias("link_id")), "page_id")
    of = first_neighbor(edges, "BelongsTo").select(F.col("src").alias("link_id"), F.col("dst").alias("domain_id"))
    domains = nodes.where(F.array_contains("labels", "DomainName")).select(F.col("node_id").alias("domain_id"), F.col("text").alias("domain"))
    named = links.join(of, "link_id").join(domains, "domain_id").select("link_id", full_url(F.col("domain"), F.col("path"), F.col("query")).alias("url"))
    return own.join(named, "link_id").select("page_id", "url")


def link_titles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(link_id, title): title of a link's first page, else the link's full URL."""
    links = nodes.where(F.array_contains("labels", "Link")).select(F.col("node_id").alias("link_id"), "link.path", "link.query")
    page = first_neighbor(edges, "PathOf").select(F.col("src").alias("link_id"), F.col("dst").alias("page_id"))
    titles = nodes.where(F.array_contains("labels", "Title")).select(F.col("node_id").alias("dst"), "text")
    first = edges.where("label = 'ParentOf'").join(titles, "dst").groupBy(F.col("src").alias("page_id")).agg(F.min(F.struct("pos", "text")).alias("m")).select("page_id", F.col("m.text").alias("title"))
    domains = nodes.where(F.array_contains("labels", "DomainName")).select(F.col("node_id").alias("domain_id"), F.col("text").alias("domain"))
    of = first_neighbor(edges, "BelongsTo").select(F.col("src").alias("link_id"), F.col("dst").alias("domain_id"))
    out = links.join(page, "link_id", "left").join(first, "page_id", "left").join(of, "link_id", "left").join(domains, "domain_id", "left")
    return out.select("link_id", F.coalesce("title", full_url(F.col("domain"), F.col("path"), F.col("query"))).alias("title"))


def robots_status(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(domain_id, status) by each domain's first robots file: requesting, found or blank (also without one)."""
    domains = nodes.where(F.array_contains("labels", "DomainName")).select(F.col("node_id").alias("src"))
    robots = nodes.where(F.array_contains("labels", "RobotsTxt")).select(F.col("node_id").alias("dst"), "text", "flags")
    first = edges.where("label = 'OwnerOf'").join(robots, "dst").groupBy("src").agg(F.min(F.struct("pos", "text", "flags")).alias("m"))
    status = F.when(F.col("m.flags").bitwiseAND(2) != 0, "requesting").when(F.length("m.text") > 0, "found").otherwise("blank")
    return domains.join(first, "src", "left").select(F.col("src").alias("domain_id"), status.alias("status"))


def explore(nodes: DataFrame, edges: DataFrame, start: int | None = None, max_depth: int = 6, bottom_up: float = 0.5) -> DataFrame:
    """(node_id, depth, parent, rank): breadth-first search from a node (by default the objective with the least id).

    Edges are followed in order, each node is reached once, by the first
    parent in rank that leads to it, and only nodes with labels of interest are
    entered. A rank is the list of places along the way, so ranks of a level
    sort like the search meets them and no level is ever numbered in one task.
    Each round joins the frontier with the edges and takes off what is visited;
    rounds are written out, so plans stay short.

    Once the frontier has more nodes than ``bottom_up`` of those not yet visited,
    the round goes the other way: visited ends are taken off the edges first,
    for good, and the frontier is looked up among what is left.
    """
    spark = nodes.sparkSession
    if start is None:
        start = nodes.where(F.array_contains("labels", "Objective")).agg(F.min("node_id")).first()[0]
    wanted = nodes.where(_any_label(EXPLORED_LABELS)).select(F.col("node_id").alias("dst"))
    tables = Steps(spark, "explore")
    steps = tables.write(edges.select("src", "pos", "dst").join(wanted, "dst", "left_semi"), "steps")  # each round joins them
    visited = frontier = spark.createDataFrame([(start, 0, None, [])], "node_id long, depth int, parent long, rank array<int>")
    left, name = wanted.count(), "steps"
    for depth in range(1, max_depth + 1):
        ahead = frontier.select(F.col("node_id").alias("src"), "rank")
        seen = visited.select(F.col("node_id").alias("dst"))
        if depth > 1 and size > bottom_up * left:
            steps = tables.write(steps.join(seen, "dst", "left_anti"), f"left{depth}")
            tables.drop(name)
            name = f"left{depth}"
            fresh = steps.join(ahead, "src").groupBy("dst").agg(F.min(F.struct("rank", "pos", "src")).alias("m"))
        else:
            fresh = ahead.join(steps, "src").groupBy("dst").agg(F.min(F.struct("rank", "pos", "src")).alias("m")).join(seen, "dst", "left_anti")
        level = fresh.select(F.col("dst").alias("node_id"), F.lit(depth).alias("depth"), F.col("m.src").alias("parent"), F.concat("m.rank", F.array("m.pos")).alias("rank"))
        frontier = tables.write(level, str(depth))
        visited, size = visited.unionByName(frontier), frontier.count()
        left -= size
    tables.drop(name)
    return visited


def explored_edges(explored: DataFrame, edges: DataFrame, max_depth: int = 6) -> DataFrame:
    """All edges of explored nodes above the last level."""
    return edges.join(explored.where(F.col("depth") < max_depth).select(F.col("node_id").alias("src")), "src", "left_semi")


def sibling_groups(explored: DataFrame, nodes: DataFrame) -> DataFrame:
    """(parent, labels, element, members, node_id): children found under one parent with equal label sets, two or more; a row a child.

    A group is named by its least child, ``element``. Groups are counted with
    partial results and joined back, so no group is ever one row.
    """
    named = explored.where("parent is not null").join(nodes.select("node_id", F.array_join(F.array_sort("labels"), ",").alias("labels")), "node_id")
    groups = named.groupBy("parent", "labels").agg(F.min("node_id").alias("element"), F.count("*").alias("members")).where("members > 1")
    return named.join(groups, ["parent", "labels"]).select("parent", "labels", "element", "members", "node_id")


def undirected_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b) with a < b: each connected pair of domains and links (but root links) once."""
    shown = nodes.where(F.array_contains("labels", "DomainName") | (F.array_contains("labels", "Link") & (F.col("link.path") != "/"))).select("node_id")
    kept = edges.join(shown.withColumnRenamed("node_id", "src"), "src", "left_semi").join(shown.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return kept.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def suggestion_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of the workflow's labels that no ``Suggests`` edge leads to."""
    wanted = nodes.where(_any_label(WORKFLOW_LABELS)).select("node_id")
    return wanted.join(edges.where("label = 'Suggests'").select(F.col("dst").alias("node_id")), "node_id", "left_anti")


def collapse_siblings(nodes: DataFrame, edges: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(elements, links): each sibling group becomes one element, named by its smallest member, all other workflow nodes their own.

    Elements carry the union of their labels; ``Suggests`` edges run between elements, once each.
    """
    wanted = nodes.where(_any_label(WORKFLOW_LABELS)).select("node_id", "labels")
    members = groups.groupBy("node_id").agg(F.min("element").alias("element"))
    placed = wanted.join(members, "node_id", "left").withColumn("element", F.coalesce("element", "node_id"))
    labels = placed.select("element", F.explode("labels").alias("label")).groupBy("element").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    sizes = placed.groupBy("element").agg(F.count("*").alias("nodes"))
    at = placed.select("node_id", "element")
    links = edges.where("label = 'Suggests'").join(at.withColumnsRenamed({"node_id": "src", "element": "from_element"}), "src").join(at.withColumnsRenamed({"node_id": "dst", "element": "to_element"}), "dst")
    return labels.join(sizes, "element"), links.select("from_element", "to_element").distinct()


def label_counts(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("nodes"))


def result_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("project_id").agg(F.count_if(F.array_contains("labels", "Link")).alias("links"), F.count_if(F.array_contains("labels", "DomainName")).alias("domains"))


def child_counts(edges: DataFrame) -> DataFrame:
    """(src, label, children): distinct ends of each source's edges by label."""
    return edges.select("src", "label", "dst").distinct().groupBy("src", "label").agg(F.count("*").alias("children"))


def map_nodes(nodes: DataFrame, fn, schema: str) -> DataFrame:
    """A user's batch function (iterator of pandas frames to the same) over all nodes; rows it leaves out are dropped."""
    return nodes.mapInPandas(fn, schema)


def top_results(df: DataFrame, n: int = 100, key: str = "node_id") -> DataFrame:
    return df.orderBy(key).limit(n)
