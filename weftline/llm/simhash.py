"""Near-duplicate groups by SimHash fingerprints, found on a grid of segment bit counts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.components import connected_components
from weftline.llm.storage import Scratch, by_shuffle, tasks

SEED = 42
EVEN = 0x5555555555555555
#: Rows of one bucket that a task compares directly; larger buckets are cut finer first.
BUCKET = 4096
#: Hashes whose bits are counted at once.
BLOCK = 1 << 16


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of a text's word shingles, repeats included; a text of fewer words is one shingle, one without words none."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    cuts = zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)
    return np.fromiter((digest(whole[a:b], SEED) for a, b in cuts), np.uint64, len(words) - n + 1)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash of a text's word shingles, repeats included (a null or wordless text: 0)."""
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprint_of(hashes: np.ndarray) -> int:
    """64-bit SimHash of shingle hashes: a bit is 1 if set in over half of them."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fingerprint): a row for each row of docs, the 64 bits as a long."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            bits = np.fromiter((fingerprint(t, shingle) for t in frame["text"]), np.uint64, len(frame))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "fingerprint": bits.view(np.int64)})

    schema = T.StructType([docs.schema["doc_id"], T.StructField("fingerprint", T.LongType())])
    return docs.select("doc_id", "text").mapInPandas(batches, schema)


def segment_counts(bits: Column) -> Column:
    """Bit counts of the 32 two-bit segments, each written in unary (0: 00, 1: 01, 2: 11).

    In this code the Manhattan distance of two count vectors is the number of
    differing bits, and it is never above the fingerprints' Hamming distance.
    """
    low, high = bits.bitwiseAND(EVEN), F.shiftrightunsigned(bits, 1).bitwiseAND(EVEN)
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _unary(bits: np.ndarray) -> np.ndarray:
    low, high = bits & np.uint64(EVEN), (bits >> np.uint64(1)) & np.uint64(EVEN)
    return low | high | ((low & high) << np.uint64(1))


def _masks(parts: int, exact: int) -> list[int]:
    """64-bit masks (signed) of every choice of ``exact`` out of ``parts`` equal parts."""
    width = 64 // parts
    part = [((1 << width) - 1) << (width * k) for k in range(parts)]
    return [int(np.uint64(sum(part[k] for k in chosen)).astype(np.int64)) for chosen in combinations(range(parts), exact)]


def _levels(distance: int) -> list[tuple[bool, list[int]]]:
    """Grid projections, coarse to fine: (on segment counts?, masks of the parts that must agree).

    Two fingerprints within the distance differ in at most ``distance`` parts,
    so they agree on all the others in at least one projection. On the last
    level only 4 bits a differing part are free, which bounds a bucket by
    16 ** distance fingerprints.
    """
    return [(True, _masks(8, 8 - distance)), (False, _masks(8, 8 - distance)), (False, _masks(16, 16 - distance))]


def _linked(nodes: np.ndarray, bits: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star for every component of one bucket: each member with its component's smallest node."""
    unary = _unary(bits)
    left, links = np.arange(len(bits)), ([], [])
    while len(left) > 1:
        group, frontier, left = [left[:1]], left[:1], left[1:]
        while len(frontier) and len(left):
            near = np.zeros(len(left), bool)
            for at in range(0, len(frontier), 64):
                f = frontier[at : at + 64, None]
                rest = np.flatnonzero(~near)
                sums = np.bitwise_count(unary[f] ^ unary[left[rest]]) <= distance  # the lower bound
                sums[sums] = np.bitwise_count(bits[f] ^ bits[left[rest]])[sums] <= distance
                near[rest[sums.any(axis=0)]] = True
            frontier, left = left[near], left[~near]
            group.append(frontier)
        members = nodes[np.concatenate(group)]
        links[0].append(members[members != members.min()])
        links[1].append(np.full(len(links[0][-1]), members.min()))
    return tuple(np.concatenate(x) if x else np.empty(0, nodes.dtype) for x in links)


def _bucket_links(distance: int):
    """For rows (key, node, fingerprint) sorted by key: spanning links of each key's rows."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def links(rows: pd.DataFrame) -> pd.DataFrame:
            key, node, bits = (rows[c].to_numpy() for c in ("key", "node", "fingerprint"))
            bits = bits.view(np.uint64)
            cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            sizes = np.diff(cuts)
            small = np.repeat(sizes <= 8, sizes)
            end = np.repeat(cuts[1:], sizes)
            a, b = [], []
            for step in range(1, 8):  # few rows: each with the next ones of its bucket
                i = np.flatnonzero(small & (np.arange(len(key)) + step < end))
                j = i + step
                i, j = (x[np.bitwise_count(_unary(bits[i]) ^ _unary(bits[j])) <= distance] for x in (i, j))
                hit = np.bitwise_count(bits[i] ^ bits[j]) <= distance
                a.append(node[i[hit]])
                b.append(node[j[hit]])
            for k in np.flatnonzero(sizes > 8):
                s = slice(cuts[k], cuts[k + 1])
                x, y = _linked(node[s], bits[s], distance)
                a.append(x)
                b.append(y)
            return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()

        held = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = held["key"].to_numpy() == held["key"].iloc[-1]
            if not last.all():  # the last key may go on in the next batch
                yield links(held[~last].reset_index(drop=True))
                held = held[last].reset_index(drop=True)
        if held is not None and len(held):
            yield links(held)

    return batches


def fingerprint_links(points: DataFrame, distance: int = 4, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``points(node, fingerprint)``
    within the Hamming distance. Fingerprints and nodes must each be distinct.

    The grid range-join: a point is put into a cell for every choice of exact
    coordinate groups of its segment counts (70 for distance 4), cells with one
    point are dropped by a count, and the points of a cell are compared, first
    by Manhattan distance, then exactly. A cell gives a spanning star a
    component, never all pairs. Points of cells above ``bucket`` rows go, once
    each, to the next finer projection; the last one bounds its cells.
    """
    spark = points.sparkSession
    scratch = Scratch(spark, "simhash")
    found, levels = [], _levels(distance)
    for k, (on_counts, masks) in enumerate(levels):
        code = segment_counts(F.col("fingerprint")) if on_counts else F.col("fingerprint")
        keys = points.withColumn("_code", code).select("node", "fingerprint", F.explode(F.array(*(F.xxhash64(F.col("_code").bitwiseAND(m), F.lit(i)) for i, m in enumerate(masks)))).alias("key"))
        full = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        cells = scratch.write(by_shuffle(keys).join(full, "key"), f"cells{k}")
        last = k == len(levels) - 1
        fit = cells if last else cells.where(F.col("n") <= bucket)
        sorted_cells = fit.select("key", "node", "fingerprint").repartition(tasks(spark), "key").sortWithinPartitions("key")
        found.append(scratch.write(sorted_cells.mapInPandas(_bucket_links(distance), "a long, b long").distinct(), f"links{k}"))
        if last or not (over := cells.where(F.col("n") > bucket)).limit(1).count():
            break
        points = scratch.write(over.select("node", "fingerprint").distinct(), f"over{k}")
        scratch.drop(f"cells{k}")
    scratch.drop(f"cells{k}")
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


def simhash_groups(docs: DataFrame, distance: int = 4, shingle: int = 4, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) for every row of docs.

    Documents with one fingerprint are a class with the smallest doc_id as its
    representative; only representatives are compared. component_id is the
    smallest doc_id reachable over links of at most ``distance`` bits. Null and
    wordless texts share fingerprint zero. A row without a doc_id gets the
    component of its class (null if nobody in the class has an id).
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    own = scratch.write(fingerprints(docs, shingle), "fingerprints")
    classes = own.groupBy("fingerprint").agg(F.min("doc_id").alias("node"))
    links = fingerprint_links(classes.where("node is not null"), distance, bucket)
    group = connected_components(links).withColumnsRenamed({"component": "component_id"})
    classes = by_shuffle(classes).join(group, "node", "left").select("fingerprint", F.coalesce("component_id", "node").alias("component_id"))
    return by_shuffle(own).join(classes, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
