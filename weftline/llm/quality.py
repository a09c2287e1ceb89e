"""A quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.storage import Scratch

#: Labelled rows that a model is fitted on at most: those with the least hash of their doc_id.
FITTED_ROWS = 20_000
BINS, DEPTH, TREES, RATE = 64, 4, 80, 0.15
#: Ridge term of leaf values, and the least weight (sum of second derivatives) of a child.
RIDGE, LEAST_WEIGHT = 1.0, 1.0
#: Rows that are walked through all trees at once.
ROWS = 4096

#: Statistics of a text, in the order of the vector.
STATISTICS = (
    "log_bytes", "letters", "capitals", "digits", "spaces", "stops", "symbols", "non_ascii", "entropy", "packed", "word_bytes", "word_spread", "short_words", "distinct_words",
    "top_word", "repeated_next", "distinct_pairs", "symbol_ends", "log_lines", "line_words", "repeated_lines", "stopped_lines",
)
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
STOPS = np.zeros(256, dtype=bool)
STOPS[list(b".,;:!?'\"()-")] = True


def statistics(text: str | None) -> np.ndarray:
    """The vector of a whole text; shares are of bytes, words or lines. All statistics of a text without bytes (or null) are zero, those of one without words where they need words."""
    out = np.zeros(len(STATISTICS))
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return out
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    share = counts / len(raw)
    some = share[share > 0]
    letters = counts[LETTER].sum()
    spaces, digits, stops = share[[9, 10, 11, 12, 13, 32]].sum(), share[48:58].sum(), share[STOPS].sum()
    # Deflate in pieces of its window, so that no copy of a long text is made.
    packer = zlib.compressobj(1)
    packed = sum(len(packer.compress(raw[k : k + 65536])) for k in range(0, len(raw), 65536)) + len(packer.flush())
    out[:10] = np.log1p(len(raw)), letters / len(raw), counts[65:91].sum() / max(letters, 1), digits, spaces, stops, 1 - letters / len(raw) - digits - spaces - stops, share[128:].sum(), -(some * np.log2(some)).sum(), packed / len(raw)
    words = raw.split()
    if words:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        seen = Counter(words)
        ends = np.bincount(np.fromiter((w[-1] for w in words), dtype=np.uint8, count=len(words)), minlength=256)
        out[10:14] = sizes.mean(), sizes.std(), (sizes <= 3).mean(), len(seen) / len(words)
        out[14] = max(seen.values()) / len(words)
        out[15] = sum(map(bytes.__eq__, words, words[1:])) / len(words)
        out[16] = len(set(zip(words, words[1:], strict=False))) / len(words)
        out[17] = 1 - (ends[LETTER].sum() + ends[STOPS].sum() + ends[48:58].sum()) / len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    if lines:
        out[18:] = np.log1p(len(lines)), len(words) / len(lines), 1 - len(set(lines)) / len(lines), sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines)
    return out


@dataclass
class Trees:
    """Complete trees of one depth, flattened: for each tree the feature and threshold of its inner nodes in level order, and the values of its leaves."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        """The summed leaf values of each row; all trees are walked level by level, for ROWS rows at once."""
        out = np.full(len(x), self.base)
        trees, inner = np.arange(len(self.leaf))[None, :], self.feature.shape[1]
        for at in range(0, len(x) if len(self.leaf) else 0, ROWS):
            part = x[at : at + ROWS]
            node = np.zeros((len(part), len(self.leaf)), dtype=np.int64)
            while node[0, 0] < inner:
                right = np.take_along_axis(part, self.feature[trees, node], axis=1) > self.threshold[trees, node]
                node = 2 * node + 1 + right
            out[at : at + ROWS] += self.leaf[trees, node - inner].sum(axis=1)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -500, 500)))


def _edges(values: np.ndarray) -> np.ndarray:
    """Upper bounds of the bins of a feature: quantiles of its values, each once; the last bin has none."""
    return np.unique(np.quantile(values, np.arange(1, BINS) / BINS, method="lower"))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosted trees for labels 0 and 1 by the logistic loss, each level split by histograms of first and second derivatives.

    Labels of one kind, or none, give the constant of their share (none: one
    half), kept off 0 and 1 by a row of each kind.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    if len(np.unique(y)) < 2:
        return Trees(base, np.zeros((0, inner), dtype=np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [_edges(x[:, f]) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], axis=1)
    margin = np.full(len(y), base)
    feature, threshold, leaf = np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        first, second = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            width = 2**level
            f, cut, gain = _splits(bins, node, first, second, width)
            split = gain > 1e-9
            at = width - 1 + np.arange(width)
            feature[t, at] = np.where(split, f, 0)
            # A cut after the last bound can gain nothing, so the bound is there.
            threshold[t, at] = [edges[k][c] if ok else np.inf for k, c, ok in zip(f, cut, split, strict=True)]
            node = 2 * node + (split[node] & (bins[np.arange(len(y)), f[node]] > cut[node]))
        g, h = np.bincount(node, first, leaves), np.bincount(node, second, leaves)
        leaf[t] = -RATE * g / (h + RIDGE)
        margin += leaf[t, node]
    return Trees(base, feature, threshold, leaf)


def _splits(bins: np.ndarray, node: np.ndarray, first: np.ndarray, second: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node of a level the best (feature, last bin of the left child, gain)."""
    best_gain, best_f, best_cut = np.zeros(width), np.zeros(width, dtype=np.int64), np.zeros(width, dtype=np.int64)
    for f in range(bins.shape[1]):
        place = node * BINS + bins[:, f]
        g, h = (np.bincount(place, w, width * BINS).reshape(width, BINS).cumsum(axis=1) for w in (first, second))
        total_g, total_h = g[:, -1:], h[:, -1:]
        gain = g**2 / (h + RIDGE) + (total_g - g) ** 2 / (total_h - h + RIDGE) - total_g**2 / (total_h + RIDGE)
        gain[(h < LEAST_WEIGHT) | (total_h - h < LEAST_WEIGHT)] = 0
        cut = gain.argmax(axis=1)
        top = gain[np.arange(width), cut]
        better = top > best_gain
        best_gain[better], best_f[better], best_cut[better] = top[better], f, cut[better]
    return best_f, best_cut, best_gain


def remainder(doc_id: str = "doc_id") -> Column:
    """CRC-32 of a doc_id's text (null: the empty text) modulo 3; 1 marks the held-out rows."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, x): the vector of each whole text, the only input of a score."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[["doc_id", "held_out"]].assign(x=[statistics(t) for t in frame["text"]])

    rows = docs.select("doc_id", (remainder() == 1).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, f"doc_id {key}, held_out boolean, x array<double>")


def fitted(vectors: DataFrame, labels: DataFrame, rows: int = FITTED_ROWS) -> Trees:
    """Trees for ``labels(doc_id, quality)`` of rows that are not held out.

    At most ``rows`` labels and ``rows`` of their vectors, those of least hash,
    are taken: a few megabytes, which is all that the driver sees. Labels but 0
    and 1, and those without a document, count for nothing; a label counts once
    for each different vector of its doc_id. The order of rows is fixed, so the
    same tables give the same trees.
    """
    known = labels.where("quality in (0, 1)").where(remainder() != 1).select("doc_id", F.col("quality").cast("int").alias("quality"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    found = vectors.join(F.broadcast(some), "doc_id").select("doc_id", "quality", "x").distinct()
    found = found.orderBy(F.xxhash64("doc_id", "x"), "doc_id", "quality", "x").limit(rows).toPandas()
    return fit(np.array(found["x"].tolist()).reshape(len(found), len(STATISTICS)), found["quality"].to_numpy(dtype=float))


def scored(vectors: DataFrame, trees: Trees) -> DataFrame:
    key = vectors.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            score = trees.scores(np.array(frame["x"].tolist()).reshape(len(frame), len(STATISTICS)))
            yield frame[["doc_id", "held_out"]].assign(score=score, predicted=(score >= 0.5).astype(np.int32))

    return vectors.mapInPandas(run, f"doc_id {key}, held_out boolean, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = FITTED_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs(doc_id, text)``.

    Each text is read once, for its vector; fitting and scoring read the
    vectors. Equal texts have equal scores; a null text scores as an empty
    one; without labels every score is one half. Other columns are ignored.
    """
    vectors = Scratch(docs.sparkSession, "quality").write(document_statistics(docs), "vectors")
    return scored(vectors, fitted(vectors, labels, rows))
