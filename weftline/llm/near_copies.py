"""Groups of near copies: SimHash and MinHash candidates, verified by the exact Jaccard similarity of word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.components import connected_components
from weftline.llm.simhash import SEED, fingerprint_links, fingerprint_of, shingle_hashes
from weftline.llm.storage import Scratch, broadcast_up_to, by_shuffle, tasks

#: A pair of similarity J shares a band with probability 1 - (1 - J ** ROWS) ** BANDS: 0.9995 at 0.8.
BANDS, ROWS = 25, 6
_rng = np.random.default_rng(SEED)
FACTORS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
#: Documents and bytes of shingle hashes of one block of candidates; a task holds two blocks.
BLOCK, BLOCK_BYTES = 2048, 8 << 20
#: Rows of one number each up to which a table is broadcast, after a count.
SMALL = 200_000
#: Keys that the classes of one group are dealt over.
SALTS = 16


def bands(hashes: np.ndarray) -> list[int]:
    """A key for each band of the MinHash signature of distinct shingle hashes (none: no keys)."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(least, (hashes[at : at + 512, None] * FACTORS + OFFSETS).min(axis=0), out=least)
    raw = least.tobytes()
    return [xxhash.xxh64_intdigest(raw[8 * ROWS * k : 8 * ROWS * (k + 1)], k) - (1 << 63) for k in range(BANDS)]


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text_hash, digest, size, fingerprint, bands) for each row of docs: digest names the set of shingle hashes, size is their number."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("text_hash", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("size", T.LongType()), T.StructField("fingerprint", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["text"]:
                every = shingle_hashes(text, shingle)
                hashes = np.unique(every)
                bits = int.from_bytes(fingerprint_of(every).to_bytes(8, "little"), "little", signed=True)
                rows.append((xxhash.xxh128_hexdigest(hashes.tobytes()), len(hashes), bits, bands(hashes)))
            yield pd.concat([frame[["doc_id", "text_hash"]].reset_index(drop=True), pd.DataFrame(rows, columns=["digest", "size", "fingerprint", "bands"])], axis=1)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInPandas(batches, schema)


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(digest, shingles) for each row of ``texts(text)``: the sorted set of shingle hashes and its name."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            raw = [np.unique(shingle_hashes(t, shingle)).tobytes() for t in frame["text"]]
            yield pd.DataFrame({"digest": [xxhash.xxh128_hexdigest(r) for r in raw], "shingles": raw})

    return texts.mapInPandas(batches, "digest string, shingles binary")


def linked(nodes: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star for every component of the sets with a Jaccard similarity of ``percent`` / 100 or more."""
    sizes = np.array([len(s) for s in sets])
    values = np.unique(np.concatenate(sets))
    codes = [np.searchsorted(values, s).astype(np.int32) for s in sets]
    mark = np.zeros(len(values), bool)
    left, links = np.arange(len(sets)), ([], [])
    while len(left):
        group, todo, left = [left[0]], [left[0]], left[1:]
        while todo and len(left):
            one = todo.pop()
            maybe = np.flatnonzero(100 * np.minimum(sizes[left], sizes[one]) >= percent * np.maximum(sizes[left], sizes[one]))
            if not len(maybe):
                continue
            mark[codes[one]] = True
            rows = left[maybe]
            both = np.add.reduceat(mark[np.concatenate([codes[r] for r in rows])], np.cumsum(sizes[rows]) - sizes[rows], dtype=np.int64)
            mark[codes[one]] = False
            hit = 100 * both >= percent * (sizes[rows] + sizes[one] - both)
            group += (found := rows[hit].tolist())
            todo += found
            left = np.delete(left, maybe[hit])
        members = nodes[group]
        links[0].append(members[members != members.min()])
        links[1].append(np.full(len(links[0][-1]), members.min()))
    return np.concatenate(links[0]), np.concatenate(links[1])


def _block_links(percent: int):
    """For rows (key, left, right, node, shingles) sorted by the first three: spanning links of each key's rows."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, nodes, sets, out = None, [], [], ([], [])

        def flush() -> None:
            if len(nodes) > 1:
                for to, found in zip(out, linked(np.array(nodes), sets, percent), strict=True):
                    to.append(found)

        for frame in frames:
            for *key, node, raw in frame[["key", "left", "right", "node", "shingles"]].itertuples(index=False, name=None):
                if key != now:
                    flush()
                    now, nodes, sets = key, [], []
                nodes.append(node)
                sets.append(np.frombuffer(raw, np.uint64))
            if out[0]:
                yield pd.DataFrame({"a": np.concatenate(out[0]), "b": np.concatenate(out[1])})
                out = ([], [])
        flush()
        if out[0]:
            yield pd.DataFrame({"a": np.concatenate(out[0]), "b": np.concatenate(out[1])})

    return batches


def _links_within(members: DataFrame, percent: int) -> DataFrame:
    """Spanning links (a, b) of the sets of each key of ``members(key, node, size, shingles)``.

    A key with more than a block of sets is cut into blocks, and each pair of blocks is a task of its own.
    """
    sizes = members.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(8 * F.col("size")) / BLOCK_BYTES)).cast("int").alias("blocks")).where("blocks > 1")
    cut = members.join(sizes, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A block meets every other block of its key, and itself where it is the only one.
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: (other != F.col("block")) | (F.col("blocks") == 1))
    pairs = cut.withColumn("_other", F.explode(others)).select("key", F.least("block", "_other").alias("left"), F.greatest("block", "_other").alias("right"), "node", "shingles")
    key = ["key", "left", "right"]
    return pairs.repartition(tasks(members.sparkSession), *key).sortWithinPartitions(*key).mapInPandas(_block_links(percent), "a long, b long").distinct()


def _star_links(stars: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Those of the candidate pairs ``stars(a, b)`` that are similar enough; b is a hub, and a large star is dealt over parts that each have the hub's set."""
    parts = stars.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    sets = members.select("node", "shingles")
    points = by_shuffle(stars).join(parts, "b").select("b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.col("a").alias("node")).withColumn("hub", F.lit(False))
    centres = parts.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("b").alias("node")).withColumn("hub", F.lit(True))
    rows = by_shuffle(points.unionByName(centres)).join(sets, "node")

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hub, values = None, np.empty(0, np.uint64)
        for frame in frames:
            found = []
            for b, node, is_hub, raw in frame[["b", "node", "hub", "shingles"]].itertuples(index=False, name=None):
                one = np.frombuffer(raw, np.uint64)
                if is_hub:
                    hub, values = b, one
                elif b == hub:
                    both = len(np.intersect1d(one, values, assume_unique=True))
                    if 100 * both >= percent * (len(one) + len(values) - both):
                        found.append((node, b))
            yield pd.DataFrame(found, columns=["a", "b"])

    key = ["b", "part"]
    return rows.repartition(tasks(members.sparkSession), *key).sortWithinPartitions(*key, F.desc("hub")).mapInPandas(batches, "a long, b long")


def _links_by_band(members: DataFrame, stars: DataFrame, keys: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Links of sets in large components of candidates, whose sets go to the bands they share and not to their component.

    First each set meets the hubs of its bands. Bands whose sets are in one
    component by then are done; in the others all sets meet. So a set is sent
    once for a hub or band of its own, however large the component that weak
    candidates chain together.
    """
    first = scratch.write(_star_links(stars, members, percent), "stars")
    group = connected_components(first)
    placed = scratch.write(by_shuffle(keys).join(group, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")), "placed")
    open_ = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("key")
    left = by_shuffle(placed).join(open_, "key").select("key", "node")
    return first.unionByName(_links_within(by_shuffle(left).join(members.select("node", "size", "shingles"), "node"), percent))


def _simhash_links(own: DataFrame, classes: DataFrame, scratch: Scratch, distance: int) -> DataFrame:
    """Links (a, b) between the classes' nodes over fingerprints within the distance; nodes of one fingerprint hang on its smallest."""
    points = by_shuffle(own.select("node", "fingerprint")).join(classes.select("node"), "node", "left_semi")
    points = scratch.write(points, "points")
    least = points.groupBy("fingerprint").agg(F.min("node").alias("b"))
    equal = by_shuffle(points).join(least, "fingerprint").where("node != b").select(F.col("node").alias("a"), "b")
    return equal.unionByName(fingerprint_links(least.withColumnRenamed("b", "node"), distance))


def copy_groups(docs: DataFrame, shingle: int = 5, percent: int = 80, distance: int = 4) -> DataFrame:
    """(doc_id, component_id) for every row of docs: component_id is the smallest doc_id
    reachable over pairs of texts whose sets of ``shingle``-word shingles have a Jaccard
    similarity of ``percent`` / 100 or more.

    Equal sets are one class. Classes whose SimHash fingerprints differ in at most
    ``distance`` bits are candidates, and so are those that share a MinHash band: at a
    similarity of 0.8 two fingerprints differ in about ten bits, so SimHash alone
    would miss most pairs there, and many more bits make its grids too fine.
    Candidates are compared exactly: where a component of candidates fits a
    block, its sets are sent to it; the sets of larger ones meet the hubs of
    their bands, then those of the bands that are not settled by that. Tasks return
    spanning links. Null and wordless texts have the empty set. component_id is
    null where nobody in the group has an id.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "copies")
    own = scratch.write(signatures(docs, shingle).withColumn("node", F.monotonically_increasing_id()), "own")
    classes = scratch.write(own.groupBy("digest").agg(F.min(F.struct("node", "text_hash", "size")).alias("c"), F.min("doc_id").alias("least")).select("digest", "c.*", "least"), "classes")
    keys = by_shuffle(own.select("node", "bands")).join(classes.select("node"), "node", "left_semi").select("node", F.explode("bands").alias("key"))
    keys = scratch.write(keys, "keys")
    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    banded = by_shuffle(keys).join(hubs, "key").where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    near = scratch.write(banded.unionByName(_simhash_links(own, classes, scratch, distance)).distinct(), "near")
    candidates = scratch.write(by_shuffle(connected_components(near)).join(classes, "node"), "candidates")
    large = candidates.groupBy("component").agg(F.count("*").alias("n"), F.sum(8 * F.col("size")).alias("bytes")).where((F.col("n") > BLOCK) | (F.col("bytes") > BLOCK_BYTES)).select("component")
    large = scratch.write(candidates.join(large, "component", "left_semi").select("node"), "large")
    by_band, nodes = not large.isEmpty(), broadcast_up_to(large, SMALL)
    if by_band:
        stars = scratch.write(near.join(nodes.withColumnRenamed("node", "a"), "a", "left_semi"), "large_near")
        shared = scratch.write(by_shuffle(keys).join(hubs.select("key"), "key", "left_semi").join(nodes, "node", "left_semi"), "large_keys")
    for used in ("keys", "near", "points"):
        scratch.drop(used)
    # Sets are made anew for candidates alone: those of all documents would take more room than the texts.
    wanted = broadcast_up_to(candidates.select("text_hash").distinct(), SMALL)
    texts = docs.select("text", F.xxhash64("text").alias("text_hash")).join(wanted, "text_hash", "left_semi").select("text")
    members = scratch.write(by_shuffle(shingle_sets(texts, shingle).dropDuplicates(["digest"])).join(candidates, "digest").select("node", "component", "size", "shingles"), "members")
    links = _links_within((members.join(nodes, "node", "left_anti") if by_band else members).withColumnRenamed("component", "key"), percent)
    if by_band:
        links = links.unionByName(_links_by_band(members.join(nodes, "node", "left_semi"), stars, shared, scratch, percent))
    links = scratch.write(links, "links")
    group = connected_components(links)
    # A group's name is found over its classes and sent to them in salted copies, so that a large group is many keys.
    linked = by_shuffle(classes).join(group, "node").withColumn("_salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)))
    names = linked.groupBy("component").agg(F.min("least").alias("component_id")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    placed = by_shuffle(linked).join(names, ["component", "_salt"]).select("digest", "component_id")
    named = by_shuffle(classes.select("digest", "least")).join(placed, "digest", "left").select("digest", F.coalesce("component_id", "least").alias("component_id"))
    out = scratch.write(by_shuffle(own.select("doc_id", "digest")).join(named, "digest").select("doc_id", "component_id"), "groups")
    scratch.keep("groups")
    return out
