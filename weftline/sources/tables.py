"""Sources and sinks: pages, search results, and the graph's node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.schemas import FLAG_NAMES, INVERSE, SEARCH_RESPONSE


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, html): a Parquet table of pages, or a folder of HTML files, with the file's place as url."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path).select("page_id", "url", "html")
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))
    return files.select(F.xxhash64("url").alias("page_id"), "url", "html")


def read_search_results(answers: DataFrame) -> DataFrame:
    """A row for each result in ``answers(search_id, body)`` of a search service, with its place; bodies that are no JSON have none."""
    results = answers.select("search_id", F.from_json("body", SEARCH_RESPONSE)["web"]["results"].alias("r"))
    return results.select("search_id", F.posexplode("r").alias("pos", "r")).select("search_id", "pos", "r.title", "r.url", "r.description", "r.age", "r.language")


def upsert_nodes(target: DataFrame, updates: DataFrame) -> DataFrame:
    """New nodes are added; known ones get the payload and time of their latest update and keep labels and flags.

    A row for each (project_id, node_id). Of updates with the same time the last
    by text counts. An aggregate with partial results replaces a window, so a
    node with very many updates does not gather them in a task.
    """
    key = ["project_id", "node_id"]
    payload = [c for c in target.columns if c not in (*key, "labels", "flags")]
    rows = target.withColumn("_new", F.lit(0)).unionByName(updates.select(*target.columns).withColumn("_new", F.lit(1)))
    latest = F.max(F.struct("written_at", "_new", *(c for c in payload if c != "written_at"))).alias("_p")
    first = F.min(F.struct("_new", "written_at", "labels", "flags")).alias("_f")
    out = rows.groupBy(*key).agg(latest, first)
    return out.select(*(F.col(c) if c in key else F.col(f"_f.{c}") if c in ("labels", "flags") else F.col(f"_p.{c}") for c in target.columns))


def add_connections(pairs: DataFrame) -> DataFrame:
    """Two directed edges, with the label and its inverse, for each row of ``pairs(project_id, a, b, label, written_at)``; repeats are kept."""
    inverse = F.create_map(*(F.lit(x) for kv in INVERSE.items() for x in kv))
    both = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("label").alias("label")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), inverse[F.col("label")].alias("label")))
    return pairs.select("project_id", "written_at", F.explode(both).alias("e")).select("project_id", "e.src", "e.dst", "e.label", "written_at")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Both tables as Parquet, a folder a project; projects that are not written stay as they are."""
    for df, name in ((nodes, "nodes"), (edges, "edges")):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


#: Days that a folder of a change log covers.
LOG_DAYS = 30


def _folder(ms: Column | int) -> Column | int:
    """The number of a time's folder since 1970, UTC."""
    span = LOG_DAYS * 86_400_000
    return ms // span if isinstance(ms, int) else F.floor(ms / span).cast("int")


def _write_log(rows: DataFrame, folder: str, time: str, path: str) -> None:
    """Files of one folder and near times each, of a size that Spark balances."""
    rows.hint("rebalance", folder).sortWithinPartitions(folder, time).write.mode("overwrite").partitionBy(folder).parquet(path)


def write_edge_changes(edges: DataFrame, path: str) -> None:
    """A log of changes: each source's edges in the folder of its last change, so that readers of later changes skip whole folders."""
    last = edges.groupBy("src").agg(F.max(F.unix_millis("written_at")).alias("changed"))
    _write_log(edges.join(last, "src").withColumn("changed_in", _folder(F.col("changed"))), "changed_in", "changed", path)


def edges_changed_since(spark: SparkSession, path: str, ms: int) -> DataFrame:
    """(src, pos, dst, label, written_at): all edges of the sources that changed after ms, as edges_since gives them, by filters of the log's folders and rows alone."""
    log = spark.read.parquet(path).where((F.col("changed_in") >= _folder(ms)) & (F.col("changed") > ms))
    return log.select("src", "pos", "dst", "label", F.col("changed").alias("written_at"))


def write_node_changes(nodes: DataFrame, path: str) -> None:
    _write_log(nodes.withColumn("written_in", _folder(F.unix_millis("written_at"))), "written_in", "written_at", path)


def nodes_changed_since(spark: SparkSession, path: str, ms: int) -> DataFrame:
    log = spark.read.parquet(path)
    return log.where((F.col("written_in") >= _folder(ms)) & (F.unix_millis("written_at") > ms)).drop("written_in")


def api_nodes(nodes: DataFrame) -> DataFrame:
    """Output form: texts of pages and robots files blanked, flags by name, time in epoch milliseconds."""
    hidden = F.arrays_overlap("labels", F.array(F.lit("WebPage"), F.lit("RobotsTxt")))
    names = F.array_compact(F.array(*(F.when(F.col("flags").bitwiseAND(bit) != 0, F.lit(name)) for bit, name in FLAG_NAMES.items())))
    return nodes.select("node_id", "labels", F.when(hidden & F.col("text").isNotNull(), "").otherwise(F.col("text")).alias("text"), names.alias("flags"), F.unix_millis("written_at").alias("written_at"))
