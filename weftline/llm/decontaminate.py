"""Benchmark decontamination by winnowing, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.storage import Scratch, broadcast_up_to, by_shuffle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a text before or after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A fingerprint packs the upper half of its hash with the k-gram's place.
PLACE = 0x7FFFFFFF
#: Rows of a side up to which it is broadcast after a count (tens of bytes a row); beyond, joins shuffle.
SMALL = 200_000


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; pure ASCII texts take the quick way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _grams(w: str, n: int, tag: int = 0) -> Column:
    """Packed hashes of all n-word grams of the array column w (which has at least n words)."""
    return F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(F.lit(tag), *(F.get(w, i + k) for k in range(n))).bitwiseAND(~0xFFFFFFFF).bitwiseOR(i.cast("long")))


def fingerprints(df: DataFrame, window: int, k: int, lengths: list[int], own: bool = False) -> DataFrame:
    """df with ``v``, the array of fingerprints of its word array ``w``: the upper half a hash, the lower half a place.

    Of every ``window - k + 1`` neighbouring k-grams the one with the least hash
    is kept, so any span of ``window`` words leaves the same hash in every text
    that holds it. All grams of the given lengths, which are those of short
    items, follow (``own``: of a text's own length only); their hashes take the length in.
    """
    none, wide = F.array().cast("array<long>"), window - k + 1
    grams = df.withColumn("_g", F.when(F.size("w") >= window, _grams("w", k)).otherwise(none))
    least = F.transform(F.sequence(F.lit(0), F.size("_g") - wide), lambda i: F.least(*(F.get("_g", i + j) for j in range(wide))))
    kept = F.when(F.size("_g") > 0, F.array_distinct(least)).otherwise(none)
    short = [F.when((F.size("w") == n) if own else (F.size("w") >= n), _grams("w", n, n)).otherwise(none) for n in lengths]
    return grams.withColumn("v", F.concat(kept, *short)).drop("_g")


def _hash(v: str) -> Column:
    return F.shiftright(v, 32)


def document_key() -> Column:
    """Name of a row by its doc_id and text; only rows that share the doc_id rely on the text's hash."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.xxhash64("text").cast("string"))


def _windows(df: DataFrame, starts: Column, window: int) -> DataFrame:
    """df with (start, length) pairs in ``starts`` exploded to (…, start, length, window text)."""
    # Word by word: ``slice`` would read the whole array for each window.
    text = lambda s: F.concat_ws(" ", *(F.when(s["length"] > j, F.get("w", s["start"] + j)) for j in range(window)))
    rows = F.transform(starts, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"), text(s).alias("window")))
    # ``explode`` would first test, row by row, that the array is not empty, and compute it twice.
    return df.withColumn("_x", F.explode_outer(rows)).where("_x is not null").select("*", "_x.*").drop("_x", "w")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, k: int = 5, share: int = 20, scratch: Scratch | None = None) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: the words inside windows of ``benchmark(item_id, text)``.

    A window is ``window`` consecutive words of an item; an item of fewer words
    is one window. Winnowed fingerprints of documents are joined with those of
    the items; a hit is extended to every window around its k-gram, and these
    windows are joined on their whole text, so a reported hit is exact and
    every shared window is found. Items below ``window`` words have no winnowed
    fingerprint; their lengths (fewer than ``window``) are listed, and grams of
    these lengths are fingerprints too. Each document is cut into words once,
    and its word count and fingerprints are written; only texts with a hit are
    read again.

    A document is contaminated if it has hits and ``share * n_hit >= n_words``.
    Null and wordless texts have no words. Rows that share doc_id and text get
    equal results; rows that share only the doc_id are told apart. An item
    without an item_id marks words but is not listed.
    """
    scratch = scratch or Scratch(docs.sparkSession, "decontaminate")
    items = scratch.write(benchmark.select("item_id", words(F.col("text")).alias("w")), "items").where(F.size("w") > 0)
    spans = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0))), lambda i: F.struct(i.alias("start"), F.least(F.size("w"), F.lit(window)).alias("length")))
    item_windows = scratch.write(_windows(items, spans, window).select("item_id", "window", "length").distinct(), "item_windows")
    lengths = sorted(r["length"] for r in item_windows.where(F.col("length") < window).select("length").distinct().collect())  # fewer than window
    marks = scratch.write(fingerprints(items, window, k, lengths, own=True).select(F.least(F.size("w"), F.lit(window)).alias("length"), "v"), "item_grams")
    marks = scratch.write(marks.select("length", F.explode("v").alias("v")).select(_hash("v").alias("hash"), "length").distinct(), "item_fingerprints")

    texts = docs.select("doc_id", document_key().alias("key"), words(F.col("text")).alias("w"))
    texts = scratch.write(fingerprints(texts, window, k, lengths).select("doc_id", "key", F.size("w").cast("long").alias("n_words"), "v"), "texts")
    found = texts.select("key", F.explode("v").alias("v")).select("key", _hash("v").alias("hash"), F.col("v").bitwiseAND(PLACE).cast("int").alias("at"))
    first = F.when(F.col("length") == window, F.greatest(F.col("at") - (window - k), F.lit(0))).otherwise(F.col("at"))
    hits = scratch.write(found.join(broadcast_up_to(marks, SMALL), "hash").select("key", "length", first.alias("low"), F.col("at").alias("high")).distinct(), "hits")

    around = hits.groupBy("key").agg(F.collect_set(F.struct("length", "low", "high")).alias("hits"))  # at most a document's words
    around = F.broadcast(around) if hits.limit(SMALL + 1).count() <= SMALL else by_shuffle(around)
    near = docs.select(document_key().alias("key"), "text").join(around, "key").select("key", "hits", words(F.col("text")).alias("w")).dropDuplicates(["key"])
    # A start and a length in one number, which is told apart by hash.
    packed = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.transform(F.sequence(h["low"], F.greatest(h["low"], F.least(h["high"], F.size("w") - h["length"]))), lambda s: s.cast("long") * (window + 1) + h["length"]))))
    starts = F.transform("starts", lambda x: F.struct(F.floor(x / (window + 1)).cast("int").alias("start"), (x % (window + 1)).cast("int").alias("length")))
    windows = _windows(near.select("key", "w", packed.alias("starts")), starts, window).drop("starts")
    shared = windows.join(broadcast_up_to(item_windows.select("window", "item_id"), SMALL), "window")
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))
    per_doc = (
        shared.groupBy("key")
        .agg(F.collect_set(F.struct("start", "length")).alias("spans"), F.collect_set(F.col("item_id").cast("string")).alias("items"))
        .select("key", F.size(covered).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join(F.array_sort("items"), ",").alias("items"))
    )
    zero = F.lit(0).cast("long")
    out = texts.select("doc_id", "key", "n_words").join(per_doc, "key", "left").withColumns({"n_hit": F.coalesce("n_hit", zero), "n_items": F.coalesce("n_items", zero), "items": F.coalesce("items", F.lit(""))})
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "key")


def decontaminated(docs: DataFrame, benchmark: DataFrame, **how: int) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    bad = scratch.write(contamination(docs, benchmark, scratch=scratch, **how).where("contaminated").select("key").distinct(), "bad")
    scratch.keep("bad")
    return docs.withColumn("_key", document_key()).join(bad.withColumnRenamed("key", "_key"), "_key", "left_anti").select(*docs.columns)


#: The same rows in DuckDB: all windows of all documents.
ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s + 1:s + least(len(w), 13)], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 12, 1))) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, s, array_to_string(w[s + 1:s + n], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS s FROM d, lens)),
m AS (SELECT doc_id, n, s, item_id FROM dw JOIN bw USING (n, win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, n, s FROM m)) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM m WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
