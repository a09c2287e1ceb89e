"""Operator 13: held-out accuracy, trees against a plain walk, and splits against all cuts."""

import zlib

import numpy as np
from fixtures import documents, texts
from pyspark.sql import functions as F

from weftline.llm import queries, quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op13_quality_trees"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len(got) == docs and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in got.items())
    rows = [(got[r.doc_id].score, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if got[r.doc_id].held_out]
    good, bad = [s for s, q in rows if q], [s for s, q in rows if not q]
    assert len(bad) > 5 and np.mean([(s >= 0.5) == q for s, q in rows]) > 0.95
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.97


def walk(trees: quality.Trees, row: np.ndarray) -> float:
    total = trees.base
    for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
        total += leaf[node - len(feature)]
    return total


def test_flat_trees_walk_like_plain_ones():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5)).round(1)  # many ties
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = quality.fit(x, y, trees=15, depth=3)
    more = np.concatenate([x, rng.normal(size=(9000, 5))])
    assert np.allclose(trees.margins(more), [walk(trees, r) for r in more])
    assert ((trees.scores(x) >= 0.5) == y).mean() > 0.95


def test_first_split_is_the_best_cut():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 20, size=(300, 4)).astype(float)
    y = (rng.random(300) < 0.2 + 0.03 * x[:, 2]).astype(float)
    trees = quality.fit(x, y, trees=1, depth=1)
    p = 1 / (1 + np.exp(-trees.base))

    def gain(left):
        part = lambda m: (p - y[m]).sum() ** 2 / (m.sum() * p * (1 - p) + quality.RIDGE)
        return part(left) + part(~left)

    cuts = {(f, c): gain(x[:, f] <= c) for f in range(4) for c in np.unique(x[:, f])[:-1]}
    assert np.isclose(cuts[int(trees.feature[0, 0]), float(trees.threshold[0, 0])], max(cuts.values()))


def test_hostile_tables(spark):
    rows = texts()
    labels = spark.createDataFrame([(r[0], k % 2, 1) for k, r in enumerate(rows) if r[0] is not None] + [(None, 1, 0), (1, None, 0), (10**9, 0, 0), (4, 7, 0)], "doc_id long, quality int, x int")
    docs = documents(spark, rows).withColumn("score", F.lit("a column of another name"))
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(rows)
    text = {}
    for r, (doc_id, t, *_) in zip(sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0)), sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        assert r.doc_id == doc_id
        text.setdefault(doc_id, set()).add(t)
    empty = {r.score for r in got if text[r.doc_id] <= {"", None}}
    assert len(empty) == 1
    again = quality.quality_scores(docs.repartition(2), labels.repartition(2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))




def test_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.quality_scores(documents(spark), none).collect()} == {0.5}
    assert quality.quality_scores(documents(spark, []), none).count() == 0
    one = spark.createDataFrame([(1, 1, 0), (4, 1, 0)], none.schema)
    assert len({r.score for r in quality.quality_scores(documents(spark), one).collect()}) == 1


def test_statistics_of_odd_texts():
    for t in (None, "", " \n\t", "\ud800", "x", "é" * 70000, "a b " * 50000, "\n" * 9):
        v = quality.statistics(t)
        assert v.shape == (len(quality.STATISTICS),) and np.isfinite(v).all()
    assert not quality.statistics(None).any()
