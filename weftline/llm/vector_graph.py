"""Near-duplicate vectors by a robust-pruned flat graph."""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.components import connected_components
from weftline.llm.storage import Scratch, tasks

LOG = logging.getLogger(__name__)
#: Rows that the cluster centres are fitted on, at most: those with the least hash of their id.
SAMPLE = 8192
#: Rows a shard aims at, and rows above which it is cut into blocks that are searched pair by pair.
SHARD, BLOCK = 2000, 4000
CENTRES = 1024
#: Candidates, degree and slack of robust pruning; width of the search's beam.
CANDIDATES, DEGREE, SLACK, BEAM = 48, 16, 1.2, 16
#: Vectors of the recall audit besides the ids divisible by 50: those with the least hash of their id.
AUDIT = 256
#: Vectors of the audit that are compared with all rows at once.
AUDIT_BLOCK = 1024


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, unit): unit is null for vectors that are null, zero or hold null or non-finite components."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    sound = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select("vec_id", F.when(sound & (norm > 0), F.transform(x, lambda v: v / F.when(norm > 0, norm))).alias("unit"))


def _centres(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spaced rows of the (hash-ordered) sample."""
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([(points[a : a + 2048] @ centres.T).argmax(axis=1) for a in range(0, len(points), 2048)])
        for c in range(k):
            if len(rows := points[own == c]):
                centres[c] = rows.sum(axis=0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def build_graph(points: np.ndarray) -> np.ndarray:
    """Neighbours (row, DEGREE; -1: none) by robust pruning of each point's nearest candidates.

    The nearest candidate is kept and those that lie SLACK times nearer to it
    than to the point are dropped, until the degree is reached. Links back are added where
    the other end has room.
    """
    n = len(points)
    c = min(CANDIDATES, n - 1)
    out = np.full((n, 2 * DEGREE), -1)
    if c < 1:
        return out
    for a in range(0, n, 512):
        rows = np.arange(a, min(a + 512, n))
        sims = points[rows] @ points.T
        sims[np.arange(len(rows)), rows] = -np.inf
        near = np.argpartition(-sims, c - 1, axis=1)[:, :c]
        dist = 2 - 2 * np.take_along_axis(sims, near, axis=1)
        order = dist.argsort(axis=1)
        near, dist = np.take_along_axis(near, order, axis=1), np.take_along_axis(dist, order, axis=1)
        vectors = points[near]
        for k in range(DEGREE):
            pick = dist.argmin(axis=1)
            live = np.isfinite(dist[np.arange(len(rows)), pick])
            if not live.any():
                break
            out[rows[live], k] = near[live, pick[live]]
            to_pick = 2 - 2 * np.einsum("ncd,nd->nc", vectors, vectors[np.arange(len(rows)), pick])
            dist[SLACK * SLACK * to_pick <= dist] = np.inf
            dist[np.arange(len(rows)), pick] = np.inf
    room = DEGREE
    src, k = np.nonzero(out[:, :DEGREE] >= 0)
    dst = out[src, k]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    place = np.arange(len(dst)) - np.searchsorted(dst, dst)
    fits = place < room
    out[dst[fits], DEGREE + place[fits]] = src[fits]
    return out


def range_search(points: np.ndarray, graph: list[np.ndarray], start: int, query: int, least: float) -> np.ndarray:
    """Rows with cosine ``least`` or more to row ``query``, by greedy search from ``start``.

    A beam walks towards the query; while it is full of rows in range it is
    doubled, and every row in range is expanded.
    """
    q, beam = points[query], BEAM
    seen = np.zeros(len(points), bool)
    rows, sims, done = np.array([start]), np.array([points[start] @ q]), np.zeros(1, bool)
    seen[start] = True
    while True:
        order = np.argsort(-sims, kind="stable")
        rows, sims, done = rows[order], sims[order], done[order]
        while beam < len(rows) and sims[beam - 1] >= least:
            beam *= 2
        open_ = np.flatnonzero(~done[:beam])
        if not len(open_):
            return rows[(sims >= least) & (rows != query)]
        inside = open_[sims[open_] >= least]
        step = inside if len(inside) else open_[:2]
        done[step] = True
        new = np.unique(np.concatenate([graph[r] for r in rows[step]]))
        new = new[~seen[new]]
        seen[new] = True
        rows, sims, done = np.concatenate((rows, new)), np.concatenate((sims, points[new] @ q)), np.concatenate((done, np.zeros(len(new), bool)))


GROUP = "shard int, left int, right int"


def _build(frame: pd.DataFrame) -> pd.DataFrame:
    """Edges (vec_id, to) of one shard's graph."""
    ids, graph = frame["vec_id"].to_numpy(), build_graph(np.array(frame["unit"].tolist()))
    src, k = np.nonzero(graph >= 0)
    return pd.DataFrame({"vec_id": ids[src], "to": ids[graph[src, k]]}).drop_duplicates()


def _search(least: float):
    """Per vector of a shard: linked vectors that no other task counts, and links that span its components."""

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.reset_index(drop=True)
        ids, points = frame["vec_id"].to_numpy(), np.array(frame["unit"].tolist())
        weight, block = frame["copies"].to_numpy(), frame["block"].to_numpy()
        shard, left, right = (int(frame[c].iloc[0]) for c in ("shard", "left", "right"))
        shards = np.sort(np.array(frame["shards"].tolist()), axis=1)
        place = pd.Series(np.arange(len(ids)), index=ids)
        graph = [place.reindex(to).dropna().to_numpy(int) for to in frame["to"]]
        start = int((points @ points.mean(axis=0)).argmax())  # the medoid
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        # A bit a pair, both ways round: a pair counts for both ends, whichever of them found it.
        pairs = np.zeros((len(ids), (len(ids) + 7) // 8), np.uint8)
        for q in range(len(ids)):
            found = range_search(points, graph, start, q, least)
            # Rows that graph search cannot reach from the medoid: also from the row itself.
            found = np.union1d(found, range_search(points, graph, q, q, least))
            row = np.zeros(len(ids), bool)
            row[found] = True
            pairs[q] |= np.packbits(row, bitorder="little")
            pairs[found, q >> 3] |= np.uint8(1 << (q & 7))
        for q in range(len(ids)):
            found = np.flatnonzero(np.unpackbits(pairs[q], count=len(ids), bitorder="little"))
            if not len(found):
                continue
            pair = (block[found] != block[q]) if left != right else np.ones(len(found), bool)
            common = np.where((shards[found][:, :, None] == shards[q][None, None, :]).any(axis=2), shards[found], 1 << 30).min(axis=1)
            links[q] = weight[found[pair & (common == shard)]].sum()
            r = np.unique(root[np.append(found, q)])
            if len(r) > 1:
                root[np.isin(root, r[1:])] = r[0]
        return pd.DataFrame({"vec_id": ids, "links": links, "linked_to": ids[root]})

    return search


def _linked(points: DataFrame, least: float, overlap: int, job: str) -> DataFrame:
    """(vec_id, links, linked_to) by task, for distinct points(vec_id, copies, unit)."""
    spark = points.sparkSession
    scratch = Scratch(spark, job)
    total = points.count()
    sample = points.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("unit").toPandas()["unit"]
    k = max(1, min(CENTRES, math.ceil(total / SHARD), len(sample)))
    centres = _centres(np.array(sample.tolist()), k)
    near = min(overlap, k)

    def shards(units: pd.Series) -> pd.Series:
        sims = np.array(units.tolist()) @ centres.T
        return pd.Series(list(np.argpartition(-sims, near - 1, axis=1)[:, :near].astype(np.int32)))

    placed = scratch.write(points.withColumn("shards", F.pandas_udf(shards, "array<int>")("unit")), "placed")
    members = placed.withColumn("shard", F.explode("shards"))
    sizes = members.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))  # a row for each of at most CENTRES shards
    members = members.join(F.broadcast(sizes), "shard").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    # A block meets every other block of its shard, and itself where it is the only one or its own pair.
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least("block", other).alias("left"), F.greatest("block", other).alias("right")))
    tasks_of = members.withColumn("_pair", F.explode(pairs)).select("vec_id", "copies", "unit", "shards", "shard", "block", "_pair.left", "_pair.right")
    group = ["shard", "left", "right"]
    edges = tasks_of.select("vec_id", "unit", *group).repartition(tasks(spark), *group).groupBy(*group).applyInPandas(_build, T.StructType([points.schema["vec_id"], T.StructField("to", points.schema["vec_id"].dataType)]))
    graph = scratch.write(edges.groupBy("vec_id").agg(F.collect_set("to").alias("to")), "graph")  # some DEGREE neighbours a shard
    with_graph = tasks_of.join(graph, "vec_id", "left").withColumn("to", F.coalesce("to", F.array().cast(graph.schema["to"].dataType)))
    schema = T.StructType([points.schema["vec_id"], T.StructField("links", T.LongType()), T.StructField("linked_to", points.schema["vec_id"].dataType)])
    return scratch.write(with_graph.groupBy(*group).applyInPandas(_search(least), schema), "links")


def _exact(points: DataFrame, least: float, job: str) -> DataFrame:
    """What ``_linked`` returns, by comparing every pair of blocks of at most some BLOCK rows."""

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        ids, rows, weight, block = frame["vec_id"].to_numpy(), np.array(frame["unit"].tolist()), frame["copies"].to_numpy(), frame["block"].to_numpy()
        within = frame["left"].iloc[0] == frame["right"].iloc[0]
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for at in range(0, len(ids), 512):
            hits = rows[at : at + 512] @ rows.T >= least
            hits &= (np.arange(at, at + len(hits))[:, None] != np.arange(len(ids))) if within else (block[at : at + 512, None] != block)
            links[at : at + 512] = hits.astype(np.int64) @ weight
            for q in np.flatnonzero(hits.any(axis=1)):
                r = np.unique(root[np.append(np.flatnonzero(hits[q]), at + q)])
                if len(r) > 1:
                    root[np.isin(root, r[1:])] = r[0]
        return pd.DataFrame({"vec_id": ids, "links": links, "linked_to": ids[root]})

    spark = points.sparkSession
    blocks = max(1, math.ceil(points.count() / BLOCK))
    cut = points.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    pairs = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("vec_id", "copies", "unit", "block", F.least("block", "_other").alias("left"), F.greatest("block", "_other").alias("right"))
    schema = T.StructType([points.schema["vec_id"], T.StructField("links", T.LongType()), T.StructField("linked_to", points.schema["vec_id"].dataType)])
    return Scratch(spark, job).write(pairs.repartition(tasks(spark), "left", "right").groupBy("left", "right").applyInPandas(compare, schema), "links")


class Audit(NamedTuple):
    """How many of the true links of sampled vectors were found."""

    #: Mean share a vector, share of all links together, and share of vectors of which a tenth or more is missing.
    mean: float
    pooled: float
    poor: float

    def passes(self, recall: float) -> bool:
        return min(self.mean, self.pooled) >= recall and self.poor <= 1 - recall


def audit_recall(points: DataFrame, found: DataFrame, least: float, queries: int = AUDIT) -> Audit:
    """Shares of sampled vectors' true links that were found, by comparing them with all rows.

    The sample is all ids divisible by 50 and, as a table may have none of
    those, ``queries`` others; it is compared in blocks. A mean over vectors
    would hide a dense group that loses half of its links, so links are also
    pooled, and vectors that miss a tenth are counted. Vectors without true links do not count.
    """
    others = points.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(queries)
    sample = Scratch(points.sparkSession, "audit").write(points.where("vec_id % 50 = 0").unionByName(others.where("vec_id % 50 != 0")), "sample")
    blocks = math.ceil(sample.count() / AUDIT_BLOCK)
    totals = np.zeros(5)
    for k in range(blocks):
        block = sample.where(F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)) == k).select("vec_id", "unit").toPandas()
        if not len(block):
            continue
        ids, q = block["vec_id"].to_numpy(), np.array(block["unit"].tolist())

        def count(frames: Iterator[pd.DataFrame], ids: np.ndarray = ids, q: np.ndarray = q) -> Iterator[pd.DataFrame]:
            n = np.zeros(len(ids), np.int64)
            for frame in (f for f in frames if len(f)):
                n += (np.array(frame["unit"].tolist()) @ q.T >= least).T.astype(np.int64) @ frame["copies"].to_numpy()
            yield pd.DataFrame({"vec_id": ids, "n": n})

        schema = T.StructType([points.schema["vec_id"], T.StructField("n", T.LongType())])
        true = points.mapInPandas(count, schema).groupBy("vec_id").agg(F.sum("n").alias("n"))
        both = true.join(points.select("vec_id", "copies"), "vec_id").select("vec_id", (F.col("n") - F.col("copies")).alias("n")).where("n > 0").join(found, "vec_id", "left")
        got = F.least(F.coalesce("links", F.lit(0)), F.col("n"))
        totals += [x or 0 for x in both.agg(F.sum(got / F.col("n")), F.count("*"), F.sum(got), F.sum("n"), F.count_if(got < 0.9 * F.col("n"))).first()]
    share, vectors, got, true, poor = totals
    return Audit(share / vectors, got / true, poor / vectors) if vectors else Audit(1.0, 1.0, 0.0)


def vector_groups(vectors: DataFrame, least: float = 0.9, recall: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors(vec_id, embedding)``.

    Rows are linked at cosine ``least`` or more in double precision. Equal
    embeddings are one class, represented by its smallest vec_id; each class
    goes to the shards of its ``overlap`` nearest centres. Every shard builds
    its robust-pruned graph, the adjacency lists of a vector are united over
    its shards, and each shard searches every member from its medoid over the
    united lists. Cosines are exact, so no reported link is below ``least``; a
    pair is counted in the smallest shard that both are in. A sample is
    compared with all rows, and while too many of its links are missing (``Audit``;
    the figures are logged) the overlap is widened (2, 3, 5, 8 shards). If that does
    not help, as in dense groups near each other, all pairs are compared in blocks.

    Shards above BLOCK rows are cut into blocks, and each pair of blocks is a
    task, so no task holds more than two blocks. Tasks report counts and
    spanning links, never all pairs. Vectors that are null, zero or not finite
    link with nothing. Rows with one vec_id are copies of it if their vectors
    are equal, else undefined in which of them is meant. All vectors have one
    length.
    """
    scratch = Scratch(vectors.sparkSession, "vectors")
    units = scratch.write(unit_vectors(vectors.select("vec_id", "embedding")), "units")
    points = scratch.write(units.where("unit is not null and vec_id is not null").groupBy("unit").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")), "points")
    if not points.limit(1).count():
        return units.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    for overlap in (2, 3, 5, 8):
        links = _linked(points, least, overlap, f"graph{overlap}")
        counts = links.groupBy("vec_id").agg(F.sum("links").alias("links"))
        audit = audit_recall(points, counts, least)
        LOG.info("overlap %d: mean recall %.4f, pooled %.4f, %.4f of the vectors miss a tenth", overlap, *audit)
        if audit.passes(recall):
            break
    else:
        LOG.info("all pairs are compared in blocks")
        links = _exact(points, least, "exact")
        counts = links.groupBy("vec_id").agg(F.sum("links").alias("links"))
    group = connected_components(links.select(F.col("vec_id").alias("a"), F.col("linked_to").alias("b")))
    classes = points.join(counts, "vec_id", "left").join(group.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    classes = classes.select("unit", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    out = units.join(classes, "unit", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: The same rows in DuckDB, by comparing all pairs.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS MATERIALIZED (SELECT vec_id, CASE WHEN len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0 THEN e END AS e FROM v),
l AS (SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.vec_id <> q.vec_id AND list_cosine_similarity(p.e, q.e) >= 0.9),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(m.b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m.b, vec_id)) AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id
"""
