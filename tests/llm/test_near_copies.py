"""Near copies of the pipeline's stage against brute force."""

import random
from collections import Counter

import pytest
from fixtures import SCHEMA, documents, sentence, texts

from weftline.llm import near_copies


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def brute_copies(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return Counter((r[0], least.get(find(i))) for i, r in enumerate(rows))


def planted(seed=7):
    """Texts with copies at similarities of about 0.7 to 0.95."""
    rng, rows = random.Random(seed), texts()
    for k in range(40):
        words = sentence(rng, 120).split()
        rows.append((1000 + 2 * k, " ".join(words), "en", "s0", 1))
        for at in rng.sample(range(20), 1 + k % 5):
            words[at * 6] = "changed"
        rows.append((1001 + 2 * k, " ".join(words), "en", "s0", 1))
    return rows


@pytest.mark.parametrize("block", [2048, 5])
def test_copies_at_four_fifths(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rows = planted()
    got = near_copies.copy_groups(documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == brute_copies(rows)
    assert near_copies.copy_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chain_of_weak_candidates(spark, monkeypatch):
    """Neighbours in a long chain share much, but not enough, and a copy of every fourth is near enough: sets meet by band, not by component."""
    monkeypatch.setattr(near_copies, "BLOCK", 20)
    rng, rows = random.Random(11), []
    words = sentence(rng, 6000).split()
    for k in range(160):
        own = words[k * 30 : k * 30 + 200]
        rows.append((2 * k, " ".join(own), "en", "s0", 1))
        if k % 4 == 0:
            rows.append((2 * k + 1, " ".join([*own[:-3], "one", "two", "three"]), "en", "s0", 1))
    sent = []
    real = near_copies._links_within
    most = lambda members: members.groupBy("node").count().agg({"count": "max"}).first()[0] or 0
    monkeypatch.setattr(near_copies, "_links_within", lambda members, percent: sent.append(most(members)) or real(members, percent))
    got = near_copies.copy_groups(documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == brute_copies(rows)
    assert len({c for _, c in brute_copies(rows)}) == 160
    assert max(sent) <= near_copies.BANDS


def test_stage_drops_near_copies(spark):
    import corpus_pipeline

    rows = [r for r in planted() if r[0] is not None and r[0] >= 1000]
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, documents(spark, rows), "").collect()}
    assert kept == {component for _, component in brute_copies(rows)}


def test_stage_tells_rows_of_one_id_apart(spark):
    import corpus_pipeline

    rng = random.Random(1)
    a, b, c = (sentence(rng, 40) for _ in range(3))
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (1, a, "en", "s", 1), (20, b, "en", "s", 1), (None, a, "en", "s", 1), (None, c, "en", "s", 1), (3, None, "en", "s", None), (4, "", "en", "s", 0)]
    kept = corpus_pipeline.near_dedup(spark, documents(spark, rows), "").collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(1, a), (1, b), (None, c), (3, None)])
