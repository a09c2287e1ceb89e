"""Joins whose sides Spark takes for smaller than they are (exploded, aggregated from that, well compressed) broadcast neither."""

import pytest
from fixtures import documents
from pyspark.sql import functions as F
from test_near_copies import planted

import corpus_pipeline
from weftline.llm import components, near_copies, simhash, storage


def plans(spark, work):
    """Final plans of all that ``work`` runs, and its rows."""
    store = spark._jsparkSession.sharedState().statusStore()

    def known():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.executionsList()
        return {(e := found.apply(k)).executionId(): e.physicalPlanDescription() for k in range(found.size())}

    before = set(known())
    rows = work()
    return [p.split("== Initial Plan ==")[0] for k, p in known().items() if k not in before], rows


def test_exploded_grid_cells(spark):
    points = spark.range(60).select(F.col("id").alias("node"), F.expr("shiftleft(1L, cast(id as int))").alias("fingerprint"))
    run, rows = plans(spark, lambda: components.connected_components(simhash.fingerprint_links(points)).collect())
    assert any("Generate" in p and "SortMergeJoin" in p for p in run)  # 70 rows a point
    assert not any("Broadcast" in p for p in run)
    assert sorted((r.node, r.component) for r in rows) == [(k, 0) for k in range(60)]


@pytest.mark.parametrize("stage", ["near_dedup", "passage_dedup"])
def test_stages_of_the_pipeline(spark, monkeypatch, stage):
    """With no table small enough to be broadcast after a count; blocks of large groups are one row for thousands, so Spark may choose there."""
    monkeypatch.setattr(near_copies, "SMALL", 0)
    docs = storage.Scratch(spark, "test").write(documents(spark, planted()), "docs")
    run, rows = plans(spark, lambda: getattr(corpus_pipeline, stage)(spark, docs, "").collect())
    assert any("SortMergeJoin" in p for p in run) and rows
    assert [p for p in run if "Broadcast" in p and "blocks" not in p] == []


def test_broadcast_after_a_count(spark):
    left, right = spark.range(50), spark.range(10)
    small, _ = plans(spark, lambda: left.join(storage.broadcast_up_to(right, 10), "id").collect())
    large, rows = plans(spark, lambda: left.join(storage.broadcast_up_to(right, 9), "id").collect())
    assert any("BroadcastHashJoin" in p for p in small) and not any("Broadcast" in p for p in large) and len(rows) == 10
