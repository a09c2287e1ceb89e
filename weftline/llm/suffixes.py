"""Removal of long repeated byte strings by sorting sampled suffixes.

Every string of ``length`` bytes has one anchor in it: the place, among its
first ``span`` ones, whose 32-byte gram has the least hash. Equal strings have
their anchor at the same offset, so it is enough to sort the suffixes that begin
at anchors (about two in ``span`` bytes) and to compare, for each offset, the
bytes before and after them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.storage import Scratch, by_shuffle, tasks

GRAM = 32
#: Window starts handled at once in a long text.
SLICE = 1 << 21
PLACE = np.uint64((1 << 24) - 1)
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Suffixes with one lead that a task compares at once; leads with more are compared by counts across tasks.
GROUP = 1 << 16


def _span(length: int) -> int:
    if length < 2 * GRAM:
        raise ValueError(f"strings must have {2 * GRAM} bytes at least")
    return min(256, length - GRAM - length // 8)


def _periods(part: bytes, place: np.ndarray, grams: np.ndarray, length: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(needless, spans) of a piece of text: starts of strings that also begin a short period earlier, and all bytes of such runs.

    Where a text repeats itself at a short distance (as a run of one byte does),
    neighbouring anchors have equal grams, as many as the text has bytes at
    worst. Each string of the run begins at two places, so all of it is
    repeated, and the strings of its first period stand for the others.
    """
    data, needless, spans = np.frombuffer(part, np.uint8), np.zeros(len(place), bool), []
    where = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
    at = place[where]
    gap = np.where(grams[at[1:]] == grams[at[:-1]], np.diff(at), 0)
    for d in np.unique(gap[gap > 0]).tolist():
        own = np.flatnonzero(gap == d)
        low, high = max(int(at[own[0]]) - length, 0), min(int(at[own[-1] + 1]) + length + d, len(data))
        same = np.concatenate(([False], data[low : high - d] == data[low + d : high], [False]))
        edges = np.flatnonzero(same[1:] != same[:-1]) + low
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= length:  # strings from a to b - length begin again d later
                needless[a + d : b - length + d + 1] = True
                spans.append((a, b + d))
    return needless, spans


def anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(place, first, last, spans): anchors and the first and last string that each stands for, and spans that repeat at once (``_periods``)."""
    out: list[list[np.ndarray]] = [[], [], []]
    repeats: list[tuple[int, int]] = []
    span, starts = _span(length), len(data) - length + 1
    for at in range(0, max(starts, 0), SLICE):
        n = min(SLICE, starts - at)
        part = data[at : at + n + length - 1]
        words = np.ndarray((len(part) - 7,), "<u8", part, strides=(1,))
        m = n + span - 1
        h = words[:m] * MIX[0]
        for k in (8, 16, 24):
            h ^= h >> np.uint64(31)
            h += words[k : k + m]
            h *= MIX[k // 8 % 2]
        h ^= h >> np.uint64(33)
        h &= ~PLACE
        grams = h.copy()
        h |= np.arange(m, dtype=np.uint64)
        width = 1
        while width < span:  # the least value of each window, by doubling
            step = min(width, span - width)
            h = np.minimum(h[:-step], h[step:])
            width += step
        place = (h[:n] & PLACE).astype(np.int64)
        needless, spans = _periods(part, place, grams, length)
        repeats += [(a + at, b + at) for a, b in spans]
        starts_left = np.flatnonzero(~needless)
        place = place[starts_left]
        cuts = np.flatnonzero((np.diff(place) != 0) | (np.diff(starts_left) != 1)) + 1
        first = np.concatenate(([0], cuts))
        for x, y in zip(out, (place[first], starts_left[first], starts_left[np.concatenate((cuts, [len(place)])) - 1]), strict=True):
            x.append(y + at)
    return *(np.concatenate(x) if x else np.empty(0, np.int64) for x in out), repeats


def _leads(data: bytes, places: np.ndarray, size: int) -> np.ndarray:
    """A number for the first ``size`` bytes after each place: three leading bytes, then a hash, so that its order is by leading bytes."""
    digest = xxhash.xxh3_64_intdigest
    got = np.fromiter((int.from_bytes(data[p : p + 3]) << 40 | digest(data[p : p + size]) >> 24 for p in places.tolist()), np.uint64, len(places))
    return (got ^ np.uint64(1 << 63)).view(np.int64)


def _scan(length: int):
    """Per document: digest of the text, its size, its anchors and their leads."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["text"]:
                data = (text or "").encode("utf-8", "replace")
                place, first, last, repeats = anchors(data, length)
                rows.append((hashlib.sha256(data).digest(), len(data), place, first, last, _leads(data, place, length - _span(length) + 1), [a for a, _ in repeats], [b for _, b in repeats]))
            yield pd.concat([frame[["doc_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=["digest", "n_bytes", "place", "first", "last", "lead", "starts", "stops"])], axis=1)

    return batches


MARKS = ["bucket", "lead", "n", "place", "first", "last"]
SEGMENT = ["bucket", "lead", "n", "digest", "place", "first", "last", "segment"]


def _segments(length: int):
    """Cuts the bytes that each candidate anchor's strings lie in out of the texts, some thousand of them at once."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for frame in frames:
            for digest, text, *marks in zip(frame["digest"], frame["text"], *(frame[c] for c in MARKS), strict=True):
                data = (text or "").encode("utf-8", "replace")
                for at in range(0, len(marks[0]), 4096):  # a long text has many
                    some = pd.DataFrame({c: m[at : at + 4096] for c, m in zip(MARKS, marks, strict=True)}).assign(digest=digest)
                    some["segment"] = [data[a : b + length] for a, b in zip(some["first"].tolist(), some["last"].tolist(), strict=True)]
                    held.append(some)
                    rows += len(some)
                    if rows >= 4096:
                        yield pd.concat(held, ignore_index=True)[SEGMENT]
                        held, rows = [], 0
        if held:
            yield pd.concat(held, ignore_index=True)[SEGMENT]

    return batches


def multikey_order(group: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Order of rows by group, then by their words, as multikey quicksort does it: one word a round, and only rows still tied go on."""
    order = np.argsort(group, kind="stable")
    cls = group[order]
    bounds = np.flatnonzero(np.concatenate(([True], cls[1:] != cls[:-1])))
    rank = np.repeat(bounds, np.diff(np.append(bounds, len(order))))
    for k in range(words.shape[1]):
        sizes = np.bincount(rank, minlength=len(order))[rank]
        tied = np.flatnonzero(sizes > 1)
        if not len(tied):
            break
        word = words[order[tied], k]
        sub = np.lexsort((word, rank[tied]))
        order[tied] = order[tied][sub]
        word, base = word[sub], rank[tied]
        new = np.concatenate(([True], (word[1:] != word[:-1]) | (base[1:] != base[:-1])))
        rank[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
    return order


def _sorted_prefixes(group: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): rows of bytes in order, and each one's common prefix with the one before (-1 at a new group)."""
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order = multikey_order(group, words)
    diff = rows[order[1:]] != rows[order[:-1]]
    common = np.where(diff.any(axis=1), diff.argmax(axis=1), rows.shape[1])
    common[group[order[1:]] != group[order[:-1]]] = -1
    return order, np.concatenate(([-1], common))


def repeated(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """Spans (digest, start, stop) of all strings that occur at two places or more among whole groups of rows with one lead."""
    n, span = len(rows), _span(length)
    group = np.unique(rows["lead"].to_numpy(), return_inverse=True)[1]
    place, first, last = (rows[c].to_numpy() for c in ("place", "first", "last"))
    most, least = place - first, place - last  # offsets of the anchor in its strings
    data = np.frombuffer(b"".join(rows["segment"]) + bytes(length + span), np.uint8)
    sizes = np.fromiter(map(len, rows["segment"]), np.int64, n)
    at = np.cumsum(sizes) - sizes + most
    right, left = np.arange(-(-length // 8) * 8), np.arange(-(-span // 8) * 8)
    after, before = np.zeros((n, len(right)), np.uint8), np.zeros((n, len(left)), np.uint8)
    for k in range(0, n, 4096):  # the bytes after and before each anchor, zero beyond its strings
        s = slice(k, k + 4096)
        after[s] = np.where(right < (length - least)[s, None], data[np.minimum(at[s, None] + right, len(data) - 1)], 0)
        before[s] = np.where(left < most[s, None], data[np.maximum(at[s, None] - 1 - left, 0)], 0)
    (a_order, a_common), (b_order, b_common) = _sorted_prefixes(group, after), _sorted_prefixes(group, before)
    hit = np.zeros((n, span + 1), bool)
    a_class, b_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(int(least.min()), int(most.max()) + 1):
        own = np.flatnonzero((least <= o) & (o <= most))
        if len(own) < 2:
            continue
        a_class[a_order] = np.cumsum(a_common < length - o)
        b_class[b_order] = np.cumsum(b_common < o)
        both = a_class[own] * (n + 1) + b_class[own]
        order = np.argsort(both)
        same = both[order][1:] == both[order][:-1]
        hit[own[order[1:][same]], o] = True
        hit[own[order[:-1][same]], o] = True
    # Runs of offsets become spans: a larger offset is an earlier string.
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, low = np.nonzero(edge == 1)
    high = np.nonzero(edge == -1)[1] - 1
    return pd.DataFrame({"digest": rows["digest"].to_numpy()[row], "start": place[row] - high, "stop": place[row] - low + length})


def _sort_buckets(length: int, chunk: int = 4096):
    """Runs ``repeated`` over rows sorted by lead, some thousand rows at once, never cutting a lead."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) < chunk:
                continue
            rows = pd.concat(held, ignore_index=True)
            leads = rows["lead"].to_numpy()
            cuts = np.flatnonzero(leads[1:] != leads[:-1]) + 1
            while len(cuts):  # pieces of whole leads
                end = cuts[min(np.searchsorted(cuts, chunk), len(cuts) - 1)]
                yield repeated(rows.iloc[:end], length)
                rows, cuts = rows.iloc[end:], cuts[cuts > end] - end
            held = [rows.reset_index(drop=True)]
        if held and sum(map(len, held)):
            yield repeated(pd.concat(held, ignore_index=True), length)

    return batches


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _pairs(marks) -> list[tuple[int, int]]:
    """(start, stop) of an array of structs as a Python worker gets it."""
    return [tuple(m.values()) if isinstance(m, dict) else tuple(m) for m in marks]


def _cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in spans)]
    return b"".join(data[a:b] for a, b in zip(ends, [*(a for a, _ in spans), len(data)], strict=True))


def _whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans drawn in to whole UTF-8 characters."""
    out = []
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def repeated_spans(docs: DataFrame, length: int = 400, group: int = GROUP) -> DataFrame:
    """(digest, copies, spans): the repeated spans of each distinct text of docs that has any; a table, all others are dropped.

    Equal texts (by SHA-256) are one class: a text with a copy is repeated as a
    whole, and one of its copies (with the smallest doc_id) stands for it, so
    groups of copies never meet in a task. A suffix whose lead (its first
    ``length - span + 1`` bytes) occurs at one place only is dropped by a count.
    The others are range-partitioned by lead between splitters taken from their
    quantiles; equal leads share a bucket, so no comparison crosses a border of
    buckets. Each bucket is sorted by multikey quicksort in both directions, and
    for each offset the classes of equal left and right parts are intersected.
    Leads with more than ``group`` suffixes are compared across tasks instead:
    their strings are counted by lead, offset and MD5.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([docs.schema["doc_id"], T.StructField("digest", T.BinaryType()), T.StructField("n_bytes", T.LongType()), *(T.StructField(c, longs) for c in ("place", "first", "last", "lead", "starts", "stops"))])
    scan = scratch.write(docs.select("doc_id", "text").mapInPandas(_scan(length), schema), "anchors")
    texts = scan.select("doc_id", "digest", "n_bytes")
    classes = texts.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    one_of = by_shuffle(scan.where(F.size("place") > 0)).join(classes, "digest").where(F.col("doc_id").eqNullSafe(F.col("rep"))).dropDuplicates(["digest"])
    marks = one_of.select("digest", "doc_id", F.explode(F.arrays_zip("place", "first", "last", "lead")).alias("m")).select("digest", "doc_id", "m.*")
    counts = scratch.write(marks.groupBy("lead").agg(F.count("*").alias("n")).where("n > 1"), "counts")  # read again, the join deals both sides itself and can split a hot lead
    found = scratch.write(by_shuffle(marks).join(counts, "lead"), "candidates")
    scratch.drop("counts")
    buckets = 4 * tasks(spark)
    splitters = np.array(found.agg(F.percentile_approx("lead", [k / buckets for k in range(1, buckets)], 10_000)).first()[0] or [], np.int64)

    def bucket(lead: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splitters, lead.to_numpy(), side="right").astype(np.int32))

    bucket = F.pandas_udf(bucket, "int")
    per_text = found.withColumn("bucket", bucket("lead")).groupBy("digest", "doc_id").agg(F.collect_list(F.struct(*MARKS)).alias("marks"))
    bodies = docs.select("doc_id", "text").withColumn("digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    with_text = by_shuffle(bodies.withColumnRenamed("doc_id", "_id")).join(per_text, "digest").where(F.col("_id").eqNullSafe(F.col("doc_id"))).select("digest", "text", *(F.col(f"marks.{c}") for c in MARKS)).dropDuplicates(["digest"])
    segments = scratch.write(with_text.mapInPandas(_segments(length), "bucket int, lead long, n long, digest binary, place long, first long, last long, segment binary"), "segments")
    columns = ["lead", "digest", "place", "first", "last", "segment"]
    near = segments.where(F.col("n") <= group).repartition(tasks(spark), "bucket").sortWithinPartitions("lead").select(*columns)
    spans = scratch.write(near.mapInPandas(_sort_buckets(length), "digest binary, start long, stop long"), "spans")
    over = segments.where(F.col("n") > group)
    if over.limit(1).count():
        strings = over.select("digest", "lead", "place", F.explode(F.sequence("first", "last")).alias("start"), "first", "segment").select(
            "digest", "start", F.md5(F.concat(F.col("lead").cast("string").cast("binary"), (F.col("place") - F.col("start")).cast("string").cast("binary"), F.substring("segment", F.col("start").cast("int") - F.col("first").cast("int") + 1, F.lit(length)))).alias("string")
        )
        strings = scratch.write(strings, "strings")
        again = scratch.write(strings.groupBy("string").agg(F.count("*").alias("n")).where("n > 1"), "again")  # read again, so that a hot string is split
        more = by_shuffle(strings).join(again, "string").select("digest", "start", (F.col("start") + length).alias("stop"))
        spans = spans.unionByName(scratch.write(more, "more_spans"))
    scratch.drop("segments")
    at_once = one_of.where(F.size("starts") > 0).select("digest", F.explode(F.arrays_zip("starts", "stops")).alias("s")).select("digest", F.col("s.starts").alias("start"), F.col("s.stops").alias("stop"))
    spans = spans.unionByName(at_once)
    per_digest = spans.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    sizes = texts.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes"))
    # A text that has a copy is repeated from end to end, whatever else it shares.
    out = by_shuffle(sizes).join(per_digest, "digest", "left").withColumn("spans", F.when((F.col("copies") > 1) & (F.col("n_bytes") >= length), whole).otherwise(F.col("spans")))
    out = scratch.write(out.where(F.size("spans") > 0).select("digest", "copies", "spans"), "per_text")
    scratch.keep("per_text")
    return out


def removal_report(docs: DataFrame, length: int = 400, group: int = GROUP) -> DataFrame:
    """Per row of docs: bytes, removed bytes and runs, SHA-256 of what is left, and ``text``, what is left in whole characters.

    Removed is every byte of a ``length``-byte string that also starts anywhere
    else, in the same document or another one. Texts are their UTF-8 bytes,
    null is empty; texts below ``length`` bytes lose nothing. Rows with equal
    doc_ids are documents of their own.
    """
    spans = repeated_spans(docs, length, group).withColumnRenamed("digest", "_digest")
    schema = "n_removed long, n_spans long, kept_sha256 string, text string"

    def cut(text: pd.Series, marks: pd.Series) -> pd.DataFrame:
        rows = []
        for t, m in zip(text, marks, strict=True):
            if t is None or m is None:
                rows.append((None, None, None, None))
                continue
            data, merged = t.encode("utf-8", "replace"), _merge(_pairs(m))
            left = _cut(data, _whole_characters(data, merged)).decode("utf-8", "replace")
            rows.append((sum(b - a for a, b in merged), len(merged), hashlib.sha256(_cut(data, merged)).hexdigest(), left))
        return pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept_sha256", "text"])

    cut = F.pandas_udf(cut, schema)
    body = F.coalesce("text", F.lit(""))
    marked = by_shuffle(docs.select("doc_id", body.alias("text"), F.sha2(body, 256).alias("sha")).withColumn("_digest", F.unhex("sha"))).join(spans, "_digest", "left")
    partly, wholly = F.col("copies") == 1, F.col("copies") > 1  # only texts that are cut go to Python
    done = marked.withColumn("cut", cut(F.when(partly, F.col("text")), F.when(partly, F.col("spans"))))
    size = F.octet_length("text").cast("long")
    choose = lambda name, whole, none: F.when(partly, F.col(f"cut.{name}")).when(wholly, whole).otherwise(none).alias(name)
    zero = F.lit(0).cast("long")
    return done.select(
        "doc_id", size.alias("n_bytes"), choose("n_removed", size, zero), choose("n_spans", F.lit(1).cast("long"), zero),
        choose("kept_sha256", F.sha2(F.lit(""), 256), F.col("sha")), choose("text", F.lit(""), F.col("text")),
    )


def without_repeats(docs: DataFrame, length: int = 400, group: int = GROUP) -> DataFrame:
    """docs with repeated strings cut out of ``text``, in whole characters; all other columns as they are.

    Of equal texts each loses all of itself, as in the report; a null text stays null.
    """
    spans = repeated_spans(docs, length, group).select(F.col("digest").alias("_digest"), F.col("spans").alias("_spans"))

    def cut(text: pd.Series, marks: pd.Series) -> pd.Series:
        out = []
        for t, m in zip(text, marks, strict=True):
            if t is None or m is None:
                out.append(t)
            else:
                data = t.encode("utf-8", "replace")
                out.append(_cut(data, _whole_characters(data, _merge(_pairs(m)))).decode("utf-8", "replace"))
        return pd.Series(out, dtype=object)

    cut = F.pandas_udf(cut, "string")
    marked = by_shuffle(docs.withColumn("_digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))).join(spans, "_digest", "left")
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(cut("text", "_spans")).alias("text")
    return marked.select(*(text if c == "text" else c for c in docs.columns))
