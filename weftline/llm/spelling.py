"""Spelling variants: words one edit apart, found with a bit-sliced position index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.crc import CRC_TABLE, crc32_sql
from weftline.llm.storage import Scratch, broadcast_up_to

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of one index block, about; a larger group of words with equal halves is compared tile by tile.
BLOCK = 2048
#: Words that query a block at once.
QUERIES = 256
#: Rows of a block share these; a group has one tile at most in a block, so no pair is met twice.
RUN = ["side", "longer", "tile"]
GROUP = [*RUN, "half"]
FOUND = "word string, n_near long, near_n long, near string"


def counted_words(docs: DataFrame, letters: int = 6, least: int = 5, damage: int = 199) -> DataFrame:
    """(word, n): words of ``docs(doc_id, text)`` with at least so many letters and occurrences.

    A run of letters (A to Z, and U+00C0 to U+00FF) is lower-cased in A to Z
    only. Where ``damage`` divides the CRC-32 of ``<doc_id>:<run>``, the run's
    letter at that number modulo its length is left out. A null text has no
    words, a null doc_id counts as the empty text. Runs that are too short
    cannot become words, so they are never cut out.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{letters},}}"), F.lit(0))).alias("run"))
    plain = F.octet_length("run") == F.length("run")
    low = runs.select("doc_id", F.when(plain, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = low.select(F.when(h % damage == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where((F.length("word") >= letters) & (F.col("n") >= least))


def _halves(words: DataFrame) -> DataFrame:
    """(side, longer, half, word, n): each word under the halves that a word one edit away can share.

    Of two such words let the longer have ``longer`` letters, and let the edit
    be as far right in it as can be. From the middle on, the first
    ``longer // 2`` letters are equal (side 0); before it, all the others are (side 1).
    """
    m = F.length("word")
    longer = words.select("word", "n", F.explode(F.array(m, m + 1)).alias("longer"))
    first = F.floor(F.col("longer") / 2).cast("int")
    rest = F.col("longer") - first
    sides = F.array(F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), first).alias("half")), F.struct(F.lit(1).alias("side"), F.substring("word", F.length("word") - rest + 1, rest).alias("half")))
    return longer.select("word", "n", "longer", F.explode(sides).alias("s")).select("s.side", "longer", "s.half", "word", "n")


def _tiled(halves: DataFrame, block: int) -> DataFrame:
    """Adds ``tile``, ``asks`` and ``stored``: a group of more than ``block`` words is dealt over parts by a hash, and each pair of parts is a tile.

    A word asks in the tiles of its part's row, and is stored in those of its column.
    """
    big = halves.groupBy("side", "longer", "half").agg(F.count("*").alias("size")).where(F.col("size") > block)
    big = big.select("side", "longer", "half", F.ceil(F.col("size") / block).cast("int").alias("parts"))
    rows = halves.join(broadcast_up_to(big, 100_000), ["side", "longer", "half"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    tile = lambda r, c: r * F.col("parts") + c
    asks = F.transform(others, lambda c: F.struct(tile(F.col("part"), c).alias("tile"), F.lit(True).alias("asks"), (c == F.col("part")).alias("stored")))
    stored = F.transform(F.filter(others, lambda r: r != F.col("part")), lambda r: F.struct(tile(r, F.col("part")).alias("tile"), F.lit(False).alias("asks"), F.lit(True).alias("stored")))
    return rows.select("side", "longer", "half", "word", "n", F.explode(F.concat(asks, stored)).alias("t")).select("side", "longer", "half", "word", "n", "t.*")


def _slices(letters: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each position a table from letters to rows, and the rows: bitsets over the words with the letter there. Row 0 is the empty set."""
    words = 64 * ((len(letters) + 63) // 64)
    tables, rows = np.zeros((letters.shape[1], 256), dtype=np.int64), []
    for p in range(letters.shape[1]):
        codes = np.unique(letters[:, p])
        codes = codes[codes > 0]
        tables[p, codes] = np.arange(1, len(codes) + 1)
        bits = np.zeros((len(codes) + 1, words), dtype=bool)
        bits[1:, : len(letters)] = letters[:, p] == codes[:, None]
        rows.append(np.packbits(bits, axis=1, bitorder="little").view(np.uint64))
    return tables, rows


def _bits(mask: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * ((len(mask) + 63) // 64), dtype=bool)
    bits[: len(mask)] = mask
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _pairs(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little"))


def _matrix(words: list[str], longer: int) -> np.ndarray:
    out = np.zeros((len(words), longer), dtype=np.uint8)
    for k, w in enumerate(words):
        out[k, : len(w)] = np.frombuffer(w.encode("latin-1"), dtype=np.uint8)
    return out


def near_pairs(asking: list[str], stored: list[str], longer: int, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in asking, in stored) of pairs one edit apart that share the half of that side.

    Asking words have ``longer`` letters, stored ones that many or one fewer.
    All stored words are compared at once: a bit a word says whether the word
    agrees so far without an error (``none``), with one letter replaced, or, one
    place behind, with one letter of the asking word left out. Each step takes
    the bitset of the words with the asked letter at the position. On side 1
    words are read from the end, and pairs that share the first half are left to side 0.
    """
    first = longer // 2
    turn = (lambda ws: [w[::-1] for w in ws]) if side else list
    ask, have = _matrix(turn(asking), longer), _matrix(turn(stored), longer)
    tables, rows = _slices(have)
    length = np.array([len(w) for w in stored])
    full, shorter = _bits(length == longer), _bits(length == longer - 1)
    head = _slices(_matrix([w[:first] for w in stored], first)) if side else None
    heads = _matrix([w[:first] for w in asking], first) if side else None
    fixed = longer - first if side else first
    found = []
    for at in range(0, len(asking), QUERIES):
        q = ask[at : at + QUERIES]
        here = lambda i, p, q=q: rows[p][tables[p, q[:, i]]]
        none = here(0, 0).copy()
        for i in range(1, fixed):
            none &= here(i, i)
        replaced, dropped = np.zeros_like(none), np.zeros_like(none)
        for i in range(fixed, longer):
            same = here(i, i)
            dropped = (dropped & here(i, i - 1)) | none
            replaced = (replaced & same) | (none & ~same)
            none &= same
        hits = (replaced & full) | (dropped & shorter)
        if side:
            shared = np.full_like(none, np.iinfo(np.uint64).max)
            for i in range(first):
                shared &= head[1][i][head[0][i, heads[at : at + QUERIES, i]]]
            hits &= ~shared
        a, b = _pairs(hits)
        found.append((a + at, b))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _summary(block: pd.DataFrame) -> pd.DataFrame:
    """Of a block of groups of one side and length: for each word with near words their number, and the one of largest count, least in order."""
    words, counts = block["word"].to_numpy(), block["n"].to_numpy()
    longer, side = int(block["longer"].iloc[0]), int(block["side"].iloc[0])
    length = block["word"].str.len().to_numpy()
    asks, stored = np.nonzero(block["asks"].to_numpy() & (length == longer))[0], np.nonzero(block["stored"].to_numpy())[0]
    if not len(asks) or not len(stored):
        return pd.DataFrame(columns=["word", "n_near", "near_n", "near"])
    a, b = near_pairs(list(words[asks]), list(words[stored]), longer, side)
    a, b = asks[a], stored[b]
    back = length[b] < longer  # the shorter word never asks
    a, b = np.concatenate([a, b[back]]), np.concatenate([b, a[back]])
    rank = np.empty(len(words), dtype=np.int64)
    rank[np.argsort(words.astype(str), kind="stable")] = np.arange(len(words))
    order = np.lexsort((rank[b], -counts[b], a))
    a, b = a[order], b[order]
    who, first, size = np.unique(a, return_index=True, return_counts=True)
    return pd.DataFrame({"word": words[who], "n_near": size, "near_n": counts[b[first]], "near": words[b[first]]})


def _blocks(frames: Iterator[pd.DataFrame], block: int) -> Iterator[pd.DataFrame]:
    """Whole groups of sorted rows, several of one RUN together, about ``block`` rows at a time."""
    held = None
    for frame in frames:
        held = frame if held is None else pd.concat([held, frame], ignore_index=True)
        ids, runs = (held.groupby(c, sort=False).ngroup().to_numpy() for c in (GROUP, RUN))
        starts = np.nonzero(np.diff(ids))[0] + 1
        if not len(starts):
            continue
        turns = np.nonzero(np.diff(runs))[0] + 1
        begin = 0
        while begin < starts[-1]:
            later = turns[np.searchsorted(turns, begin, "right") :]
            limit = min(begin + block, *later[:1], starts[-1])
            cut = starts[max(np.searchsorted(starts, limit, "right") - 1, np.searchsorted(starts, begin, "right"))]
            yield held.iloc[begin:cut]
            begin = cut
        held = held.iloc[begin:].reset_index(drop=True)
    if held is not None:
        while len(held):
            runs = held.groupby(RUN, sort=False).ngroup().to_numpy()
            cut = int(np.searchsorted(runs, runs[0], "right"))
            yield held.iloc[:cut]
            held = held.iloc[cut:]


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, near_n, near): for each of the distinct ``words(word, n)`` with words one edit away their number, and the one of largest n (ties: least).

    Words are dealt by the halves that a near word must share, so a word meets
    few others; within a block of such groups the bit-sliced index compares it
    with all at once. Each task sums up its links, so pairs are never written.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _blocks(frames, block):
            yield _summary(rows)

    found = _tiled(_halves(words), block).repartition(*GROUP).sortWithinPartitions(*GROUP).mapInPandas(run, FOUND)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))


def spelling_groups(docs: DataFrame, letters: int = 6, least: int = 5, factor: int = 5, damage: int = 199, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of ``docs(doc_id, text)``.

    A word's form is the near word of largest n (ties: least in code-point
    order), if it occurs at least ``factor`` times as often; its root is where
    following forms ends, the word itself without a form. As counts grow by
    the factor with each step, ways are short, and pointer doubling follows
    them in a number of rounds that the largest count bounds. Other columns
    are ignored; an empty table gives no rows.
    """
    if factor < 2:
        raise ValueError("factor must be 2 or more, so that ways end")
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.write(counted_words(docs, letters, least, damage), "words")
    good = F.col("near_n") >= factor * F.col("n")
    known = words.join(near_words(words, block), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("near")).alias("form"), F.when(good, F.col("near_n")).alias("form_n"))
    known = scratch.write(known, "known")
    most = words.agg(F.max("n")).first()[0] or least
    steps = max(math.ceil(math.log(most / least, factor)), 1) if most > least else 1
    ways = known.where("form is not null").select("word", F.col("form").alias("root"))
    for k in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ways = scratch.write(ways.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), f"ways{k}")
    return known.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same rows in DuckDB: CRC-32 from its table, near words by what is left when a letter is taken out.
ORACLE = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{6,}}')), '{UPPER}', '{LOWER}') AS run FROM documents),
d AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS s, run, count(*) AS k FROM runs GROUP BY ALL),
h AS (SELECT run, k, {crc32_sql("s")} AS h FROM d, tab),
w AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(k)::BIGINT AS n FROM h GROUP BY 1),
v AS MATERIALIZED (SELECT word, n FROM w WHERE length(word) >= 6 AND n >= 5),
o AS MATERIALIZED (SELECT word, n, p, left(word, p - 1) || substr(word, p + 1) AS rest FROM v, LATERAL (SELECT unnest(range(1, length(word) + 1))::INT AS p)),
near AS (SELECT a.word, b.word AS other, b.n FROM o a JOIN o b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT o.word, v.word, v.n FROM o JOIN v ON o.rest = v.word UNION SELECT v.word, o.word, o.n FROM o JOIN v ON o.rest = v.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS top FROM near GROUP BY word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, (SELECT min(other) FROM near x WHERE x.word = v.word AND x.n = top) AS near, top FROM v LEFT JOIN best USING (word)),
g AS MATERIALIZED (SELECT word, n, n_near, CASE WHEN top >= 5 * n THEN near END AS form, CASE WHEN top >= 5 * n THEN top END AS form_n FROM f),
r AS (SELECT word, word AS root FROM g UNION ALL SELECT r.word, g.form FROM r JOIN g ON g.word = r.root WHERE g.form IS NOT NULL),
l AS (SELECT r.word, r.root FROM r JOIN g ON g.word = r.root WHERE g.form IS NULL)
SELECT g.word, form, root, n, n_near, form_n FROM g JOIN l ON l.word = g.word
"""
