"""Dense groups that the pruned graph alone does not join."""

from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from test_web import brute_links

from weftline.llm import vector_graph


def test_sql_form_on_linked_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(v) for v in rng.normal(size=8)]) for k in range(30)]
    rows += [(100 + k, [v + 0.05 * float(rng.normal()) for v in rows[k % 7][1]]) for k in range(40)]
    rows += [(200, None), (201, [0.0] * 8), (202, [1.0, None] * 4), (203, rows[3][1]), (204, [float("nan")] * 8)]
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": pa.array([r[0] for r in rows]), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float64()))}))
    got = vector_graph.vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert Counter(tuple(r) for r in got) == Counter(con.sql(vector_graph.ORACLE).fetchall())
    assert sum(r.n_links for r in got) > 100


@pytest.mark.parametrize("block", [4000, 50])
def test_two_dense_groups(spark, monkeypatch, block):
    monkeypatch.setattr(vector_graph, "BLOCK", block)
    rng = np.random.default_rng(3)
    a, b = (x / np.linalg.norm(x) for x in rng.normal(size=(2, 64)))
    b -= a * (a @ b)
    b = 0.92 * a + np.sqrt(1 - 0.92**2) * b / np.linalg.norm(b)
    rows = [[float(np.float32(v)) for v in c + rng.normal(size=64) * 0.002] for c in (a, b) for _ in range(60)]
    rows = [(k, x) for k, x in enumerate(rows)]
    got = vector_graph.vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert Counter(tuple(r) for r in got) == brute_links(rows, 0.9)


def test_dense_groups_beside_many_pairs(spark):
    """Two groups of 60 at a cosine of about 0.93, each row linked to all 119 others: a mean over vectors would not notice if half of that were lost."""
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x)
    a, b = (unit(x) for x in rng.normal(size=(2, 64)))
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * unit(b - a * (a @ b))
    rows = [c + rng.normal(size=64) * 0.001 for c in (a, b) for _ in range(60)]
    for _ in range(1500):
        x = unit(rng.normal(size=64))
        rows += [x, x + rng.normal(size=64) * 0.02]
    order = rng.permutation(len(rows))
    rows = [(int(k), [float(np.float32(v)) for v in rows[k]]) for k in order]
    got = {r.vec_id: r for r in vector_graph.vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    x = np.array([v for _, v in sorted(rows)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    true = near.sum(axis=1)
    found = np.array([got[k].n_links for k in range(len(rows))])
    assert (found <= true).all() and true[:120].min() == 119
    asked = np.arange(0, len(rows), 50)
    assert found[asked].sum() >= 0.9 * true[asked].sum() and found.sum() >= 0.95 * true.sum()
    assert (found[:120] >= 0.9 * true[:120]).mean() >= 0.95
    assert {got[k].component_id for k in range(120)} == {0}
