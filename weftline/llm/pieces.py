"""SentencePiece encoding and decoding over a piece table.

``lattice`` and the folds are the relational form: bounded-length substrings of
distinct words are exploded and equi-joined to the piece table, the edges are
grouped by word, and a higher-order aggregate folds them into pieces.
``encode`` is the form for whole corpora: it needs no shuffle of word
occurrences and does the same lookups inside each task.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.storage import Scratch, small_batches

SPACE = "▁"
#: A unit is a run of spaces with the word after it: no piece goes from a word into the spaces behind it.
UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Units whose pieces a worker remembers.
REMEMBERED = 250_000


def piece_rows(model: str) -> list[tuple[int, str, float, int | None]]:
    """(id, piece, score, byte): the normal and byte pieces of a SentencePiece model file."""
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=model)
    skip = lambda k: m.is_control(k) or m.is_unknown(k) or m.is_unused(k)
    return [(k, m.id_to_piece(k), m.get_score(k), int(m.id_to_piece(k)[3:5], 16) if m.is_byte(k) else None) for k in range(m.get_piece_size()) if not skip(k)]


def piece_table(spark: SparkSession, model: str) -> DataFrame:
    return spark.createDataFrame(piece_rows(model), "id int, piece string, score double, byte int")


def units(text: str) -> list[str]:
    """A text's units, spaces written as U+2581, with the dummy space in front (an empty text: none)."""
    return UNIT.findall(SPACE + text.replace(" ", SPACE)) if text else []


def lattice(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """(word, n, edges) of ``words(word)``: edges (start, size, score, id) for every substring that is a piece."""
    normal = pieces.where("byte is null")
    longest = normal.agg(F.max(F.length("piece"))).first()[0]
    n = F.length("word")
    spans = words.distinct().where(n > 0).select("word", F.explode(F.sequence(F.lit(1), n)).alias("start"))
    spans = spans.select("word", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), n - F.col("start") + 1))).alias("size"))
    edges = spans.withColumn("piece", F.expr("substring(word, start, size)")).join(normal.select("piece", "score", "id"), "piece")
    grouped = edges.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("start", "size", "score", "id"))).alias("edges"))
    return words.distinct().where(n > 0).join(grouped, "word", "left").select("word", n.alias("n"), F.coalesce("edges", F.array().cast(grouped.schema["edges"].dataType)).alias("edges"))


def viterbi(edges: Column, n: Column, unknown: float = -1e6) -> Column:
    """Sizes of the best path's pieces, for tables with unigram scores: a fold over end positions.

    A character without a piece is an edge of score ``unknown``. Ties: the longest last piece.
    """
    state = "struct<score: double, sizes: array<int>>"
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("sizes")).cast(state))

    def step(acc: Column, at: Column) -> Column:
        ending = F.filter(edges, lambda e: e["start"] + e["size"] - 1 == at)
        own = F.array(F.struct(at.alias("start"), F.lit(1).alias("size"), F.lit(unknown).alias("score")))
        plain = F.transform(ending, lambda e: F.struct(e["start"].alias("start"), e["size"].alias("size"), e["score"].alias("score")))
        paths = F.transform(F.concat(plain, own), lambda e: F.struct((F.get(acc, e["start"] - 1)["score"] + e["score"]).alias("score"), e["size"].alias("last"), F.get(acc, e["start"] - 1)["sizes"].alias("before")))
        best = F.array_max(paths)
        return F.concat(acc, F.array(F.struct(best["score"].alias("score"), F.concat(best["before"], F.array(best["last"])).alias("sizes")).cast(state)))

    return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda acc: F.element_at(acc, -1)["sizes"])


def merges(edges: Column, n: Column) -> Column:
    """Starts of the pieces (and n + 1), for tables with merge ranks as scores (BPE): n - 1 rounds,
    each joining the neighbours whose whole has the best score, the leftmost of ties."""
    def step(cuts: Column, _: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(cuts) - 3, F.lit(0))), lambda j: F.struct(
            F.get(F.filter(edges, lambda e: (e["start"] == F.get(cuts, j)) & (e["size"] == F.get(cuts, j + 2) - F.get(cuts, j))), F.lit(0))["score"].alias("score"), (-j).alias("left")))
        best = F.array_max(F.filter(pairs, lambda p: p["score"].isNotNull()))
        return F.when(best.isNull(), cuts).otherwise(F.filter(cuts, lambda x: x != F.get(cuts, 1 - best["left"])))

    safe = lambda cuts, k: F.when(F.size(cuts) < 3, cuts).otherwise(step(cuts, k))
    return F.aggregate(F.sequence(F.lit(1), n), F.sequence(F.lit(1), n + 1), safe)


class Merger:
    """Piece ids of units by merge ranks, with bytes for characters that have no piece."""

    def __init__(self, rows: list[tuple[int, str, float, int | None]]):
        if max((k for k, *_ in rows), default=0) >= 1 << 16:
            raise ValueError("piece ids above 65535 do not fit in 16 bits")
        self.score = {p: s for _, p, s, b in rows if b is None}
        self.id = {p: np.uint16(k).tobytes() for k, p, _, b in rows if b is None}
        self.byte = {b: np.uint16(k).tobytes() for k, _, _, b in rows if b is not None}
        self.known: dict[str, bytes] = {}

    def _parts(self, unit: str) -> list[str]:
        get, parts = self.score.get, list(unit)
        if len(parts) > 64:
            return self._long(parts)
        scores = [get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for j, s in enumerate(scores):
                if s is not None and (best is None or s > best):
                    best, at = s, j
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at < len(scores):
                scores[at] = get(parts[at] + parts[at + 1])
            if at:
                scores[at - 1] = get(parts[at - 1] + parts[at])

    def _long(self, parts: list[str]) -> list[str]:
        """The same by a heap, for units of any length."""
        get, n = self.score.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-s, j, parts[j] + parts[j + 1]) for j in range(n - 1) if (s := get(parts[j] + parts[j + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, j, whole = heapq.heappop(heap)
            k = after[j] if parts[j] else n
            if k >= n or parts[j] + parts[k] != whole:
                continue
            parts[j], parts[k] = whole, ""
            after[j] = after[k]
            if after[k] < n:
                before[after[k]] = j
            for a, b in ((before[j], j), (j, after[j])):
                if a >= 0 and b < n and (s := get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (-s, a, parts[a] + parts[b]))
        return [p for p in parts if p]

    def unit(self, unit: str) -> bytes:
        out = self.known.get(unit)
        if out is None:
            ids, byte = self.id, self.byte
            out = b"".join([ids.get(p) or b"".join([byte[c] for c in p.encode("utf-8", "replace")]) for p in self._parts(unit)])
            self.known[unit] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 16-bit integers."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return b"".join(map(self.unit, units(text)))


class Joiner:
    """Texts from piece ids."""

    def __init__(self, rows: list[tuple[int, str, float, int | None]]):
        self.bytes = [b""] * (max(k for k, *_ in rows) + 1)
        for k, piece, _, byte in rows:
            self.bytes[k] = bytes([byte]) if byte is not None else piece.replace(SPACE, " ").encode()

    def decode(self, ids: np.ndarray) -> str:
        """The text, without the dummy space in front."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


_workers: dict[str, tuple[Merger, Joiner]] = {}


def _tools(model: str) -> tuple[Merger, Joiner]:
    if model not in _workers:
        rows = piece_rows(model)
        _workers[model] = Merger(rows), Joiner(rows)
    return _workers[model]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """docs without ``text``, with ``ids`` (little-endian unsigned 16-bit integers) and ``n_pieces``.

    The ids are those of the SentencePiece library for a BPE model with identity
    normalisation, dummy prefix and byte fallback. Nothing is shuffled; a null
    or empty text has no pieces.
    """
    return _map(docs, model, "text", [T.StructField("ids", T.BinaryType()), T.StructField("n_pieces", T.LongType())], lambda tools, t: (r := tools[0].encode(t or ""), len(r) // 2))


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """encoded with ``ids`` replaced by ``text``; a U+2581 of the original comes back as a space."""
    return _map(encoded, model, "ids", [T.StructField("text", T.StringType())], lambda tools, raw: (tools[1].decode(np.frombuffer(raw or b"", "<u2")),))


def _map(df: DataFrame, model: str, column: str, fields: list[T.StructField], work) -> DataFrame:
    small_batches(df.sparkSession)
    names = [f.name for f in fields]
    schema = T.StructType([*(f for f in df.schema if f.name != column and f.name not in names), *fields])

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tools = _tools(model)
        for frame in frames:
            made = pd.DataFrame([work(tools, x) for x in frame[column]], columns=names, index=frame.index)
            yield pd.concat([frame.drop(columns=[column, *(n for n in names if n in frame)]), made], axis=1)[schema.names]

    return df.mapInPandas(batches, schema)


def encode_relational(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) by the relational lattice, with the merge fold: every word occurrence is joined to the folded words.

    It gives the ids of ``encode``; its shuffles carry all word occurrences twice
    (see the README for figures), so it is for small inputs and for checking.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pieces")
    pieces = piece_table(spark, model)
    spaced = F.concat(F.lit(SPACE), F.replace("text", F.lit(" "), F.lit(SPACE)))
    found = F.regexp_extract_all(spaced, F.lit(f"{SPACE}*[^{SPACE}]+|{SPACE}+"), F.lit(0))
    places = docs.where(F.length("text") > 0).select("doc_id", F.posexplode(found).alias("at", "word"))
    edges = lattice(places.select("word"), pieces)
    cuts = scratch.write(edges.select("word", merges(F.col("edges"), F.col("n")).alias("cuts")), "cuts")
    parts = cuts.select("word", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), lambda k: F.expr("word").substr(F.element_at("cuts", k), F.element_at("cuts", k + 1) - F.element_at("cuts", k)))).alias("k", "piece"))
    by_byte = pieces.where("byte is not null").agg(F.map_from_entries(F.collect_list(F.struct("byte", "id"))).alias("m")).first()["m"]
    table = F.create_map(*(F.lit(x) for kv in sorted(by_byte.items()) for x in kv))
    raw = F.transform(F.sequence(F.lit(0), F.octet_length("piece") - 1), lambda j: F.element_at(table, F.conv(F.substr(F.hex(F.encode("piece", "utf-8")), 2 * j + 1, F.lit(2)), 16, 10).cast("int")))
    named = parts.join(pieces.where("byte is null").select("piece", "id"), "piece", "left").select("word", "k", F.when(F.col("id").isNull(), raw).otherwise(F.array("id")).alias("ids"))
    words = named.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("p")).select("word", F.flatten("p.ids").alias("ids"))
    out = places.join(words, "word").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("p"))
    return out.select("doc_id", F.flatten("p.ids").alias("ids"))


def piece_report(docs: DataFrame, model: str) -> DataFrame:
    """Encodes every document, decodes the ids and reports both."""
    encoded = encode(docs.select("doc_id", F.sha2(F.coalesce(F.replace("text", F.lit(SPACE), F.lit(" ")), F.lit("")), 256).alias("sha"), "text"), model)
    back = decode(encoded.select("doc_id", "n_pieces", F.crc32("ids").alias("ids_crc32"), "sha", "ids"), model)
    return back.select("doc_id", "n_pieces", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"), (F.sha2("text", 256) == F.col("sha")).alias("round_trip"))
