"""Operators on pages, lists and vectors, and the pipeline."""

import base64
import hashlib
import sys
from collections import Counter
from datetime import date, datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from fixtures import SCHEMA, documents, sentence, texts
from pyspark.sql import functions as F

from weftline.llm import language, url_lists, vector_graph, warc

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
PAGES = "page_id long, url string, html string"


# --- language ----------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs.where("doc_id % 5 != 0"))
    rest = docs.where("doc_id % 5 = 0").select("lang", "text").collect()
    right = sum(language.LANGUAGES[int(model[language.trigrams(r.text)].sum(axis=0).argmax())] == r.lang for r in rest)
    assert right / len(rest) > 0.98


def test_fusion_against_brute_force(spark):
    rng = np.random.default_rng(0)
    n, langs = 60, ("a", "b")
    rows = []
    for k in range(n):
        host = ("h0.x.com", "h1.x.com", "h2.y.org")[int(rng.integers(3))]
        rows.append((k, [float(v) for v in rng.normal(0, 1, 2)], bool(rng.random() > 0.1), ("a", "b", "q", None)[int(rng.integers(4))], host if rng.random() > 0.1 else None))
    df = spark.createDataFrame(rows, "id long, loglik array<double>, letters boolean, declared string, host string").withColumns({"domain": F.substring_index("host", ".", -2), "suffix": F.substring_index("host", ".", -1)})
    got = {r.id: r for r in language.fuse(df, langs).collect()}
    own = {k: int(np.argmax(ll)) if ok else None for k, ll, ok, _, _ in rows}
    form = lambda d: "none" if d is None else d if d in langs else "other"
    said = np.ones((2, 4))
    forms = ["none", "other", *langs]
    for k, _, _, d, _ in rows:
        if own[k] is not None:
            said[own[k], forms.index(form(d))] += 1
    said = np.log(said / said.sum(axis=1, keepdims=True))
    cut = lambda h, level: ["", (h or "").split(".")[-1], ".".join((h or "").split(".")[-2:]), h or ""][level]
    for k, ll, _, d, h in rows:
        prior = None
        for level in range(4):
            c = np.zeros(2)
            for j, *_, other in rows:
                if own[j] is not None and j != k and cut(other, level) == cut(h, level):
                    c[own[j]] += 1
            prior = (c + 1) / (c.sum() + 2) if prior is None else (c + language.PARENT * prior) / (c.sum() + language.PARENT)
        logs = np.log(prior) + said[:, forms.index(form(d))] + ll
        odds = np.exp(logs - logs.max())
        assert got[k].priors == pytest.approx(prior.tolist()) and got[k].posterior == pytest.approx(odds.max() / odds.sum())
        assert got[k].lang_found == langs[int(logs.argmax())]


def test_page_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(1, None, None), (2, "no url", ""), (3, "http://a.example.com/", "<html lang=fr><p>123</p>"), (3, "http://a.example.com/", "<html lang=fr><p>123</p>"), (None, "https://x/", "<html lang='EN-us'><body>" + "the that and this " * 3000)]
    got = language.page_languages(spark.createDataFrame(rows, PAGES).withColumn("lang", F.lit(1)), docs).collect()
    assert Counter((r.page_id, r.declared, r.accepted) for r in got) == Counter([(1, None, False), (2, None, False), (3, "fr", False), (3, "fr", False), (None, "en", True)])
    assert language.page_languages(spark.createDataFrame([], PAGES), docs).count() == 0
    assert language.page_languages(spark.createDataFrame(rows, PAGES), docs.limit(0)).count() == len(rows)


def test_rejected_documents(spark):
    rows = texts()
    kept = language.in_known_language(documents(spark, rows))
    no_letters = {r[0] for r in rows if not language.LETTER.search(r[1] or "")}
    assert kept.columns == documents(spark).columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - no_letters
    assert language.in_known_language(spark.createDataFrame([], SCHEMA)).count() == 0


# --- URL lists ---------------------------------------------------------------------------------

DAY = date(2024, 1, 1)


def test_as_of_join(spark):
    day = lambda n: DAY + timedelta(n)
    entries = [("l", "a.com", "block", "add", day(5)), ("l", "a.com", "block", "drop", day(20)), ("l", "a.com", "block", "add", day(100)), ("l", "a.com", "block", "add", day(5)), ("m", "x.a.com/in", "allow", "add", day(0)),
               ("m", "b.com", "block", "add", day(3)), ("m", "b.com", "block", "drop", day(3)), ("m", "com", "allow", "drop", day(1)), (None, "c.com/p/q", "block", "add", day(1)), ("m", None, "block", "add", day(1)), ("m", "a.com", "block", "add", None), ("m", "a.com", "allow", "add", day(300))]
    urls = ["http://a.com/", "https://x.a.com/in/page", "https://x.a.com/inside", "http://b.com/", "http://c.com/p/q/r?z", "http://c.com/p/qq", "bad", None, "http://a.com/"]
    times = [datetime(2024, 1, 1) + timedelta(days=n, hours=9) for n in (0, 4, 5, 19, 20, 99, 100, 299, 300, 364)] + [None]
    rows = [(k, u, t) for k, u in enumerate(urls) for t in times]
    got = url_lists.evaluate(spark.createDataFrame(rows, "page_id long, url string, fetched_at timestamp").withColumn("bin", F.lit(1)), spark.createDataFrame(entries, "list_id string, pattern string, verdict string, action string, day date"))

    spans = []
    for key in {e[:3] for e in entries if e[1] and e[4]}:
        days = sorted({e[4] for e in entries if e[:3] == key and e[4]})
        for k, x in enumerate(days):
            if not any(e[3] == "drop" for e in entries if e[:3] == key and e[4] == x):
                spans.append((*key[1:], x, days[k + 1] if k + 1 < len(days) else date.max))

    def covers(pattern, url):
        host, _, path = url.partition("://")[2].partition("/")
        if "/" not in pattern:
            return host == pattern or host.endswith(f".{pattern}")
        p_host, _, p_path = pattern.partition("/")
        return host == p_host and f"/{path.partition('?')[0]}/".startswith(f"/{p_path}/")

    def verdict(url, at):
        hits = [(len(p), v == "allow", p) for p, v, a, b in spans if url and "://" in url and at and a <= at.date() < b and covers(p, url)]
        best = max(hits, default=None)
        return len(hits), best and best[2], bool(best) and not best[1]

    assert Counter(tuple(r) for r in got.collect()) == Counter((k, u, t, *verdict(u, t)) for k, u, t in rows)


def test_empty_lists(spark):
    none = spark.createDataFrame([], "list_id string, pattern string, verdict string, action string, day date")
    captures = spark.createDataFrame([(1, "http://a.com/", datetime(2024, 1, 1))], "page_id long, url string, fetched_at timestamp")
    assert url_lists.evaluate(captures, none).collect() == [(1, "http://a.com/", datetime(2024, 1, 1), 0, None, False)]
    assert url_lists.evaluate(captures.limit(0), none).count() == 0


def test_url_list_query(spark):
    from oracle import database, same_rows

    from weftline.llm.queries import ORACLE_SQL, QUERIES

    sf = "/root/testdata/sf0.001"
    for name, sql in ORACLE_SQL.items():
        assert same_rows(QUERIES[name](spark, sf), database(sf), sql)


# --- vectors -----------------------------------------------------------------------------------


def brute_links(rows, least):
    v = {}
    for k, (_, x) in enumerate(rows):
        if x and all(c is not None and np.isfinite(c) for c in x) and any(x):
            a = np.array(x, np.float64)
            v[k] = a / np.linalg.norm(a)
    near = {k: [j for j in v if j != k and v[j] @ v[k] >= least] for k in v}
    out = Counter()
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        first = min(rows[j][0] for j in seen)
        out[i, len(near.get(k, [])), first, i == first] += 1
    return out


@pytest.mark.parametrize("block", [4000, 30])
def test_vector_groups(spark, monkeypatch, block):
    monkeypatch.setattr(vector_graph, "BLOCK", block)
    monkeypatch.setattr(vector_graph, "SHARD", 60)
    rng = np.random.default_rng(0)
    rows = [rng.normal(size=16) for _ in range(150)]
    centre = rng.normal(size=16)
    rows += [centre + rng.normal(size=16) * 0.1 for _ in range(60)] + [centre] * 5 + [rows[0] * 2, rows[1] + 0.05]
    rows = [[float(np.float32(c)) for c in x] for x in rows]
    rows += [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, [float("inf")] * 16]
    rows = [(k * 2 + 3, x) for k, x in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"unit": F.lit(1), "label": F.lit(2)})
    got = Counter(tuple(r) for r in vector_graph.vector_groups(df).collect())
    assert got == brute_links(rows, 0.9)


def test_no_vectors(spark):
    assert vector_graph.vector_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    one = spark.createDataFrame([(5, None)], "vec_id long, embedding array<float>")
    assert vector_graph.vector_groups(one).collect() == [(5, 0, 5, True)]


# --- WARC --------------------------------------------------------------------------------------


def test_archive(spark, tmp_path):
    rows = [(1, "http://a/", "x"), (2, "http://b/", "x"), (3, None, None), (4, "u", ""), (5, "u", "é" * 9000), (6, "line\r\nWARC-Type: fake", "a\r\n\r\nb"), (2, "http://b/", "x"), (None, "n", "x")]
    got = warc.archived_pages(spark.createDataFrame(rows, PAGES).withColumn("payload", F.lit(1))).drop("uri").collect()
    sha1 = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    want = Counter()
    done = set()
    for p, _, h in rows:
        top = max((q or -1) for q, _, x in rows if (x or "") == (h or ""))
        first = p == top and top not in done  # of rows with one page_id one is the response
        done |= {top} if first else set()
        want[p, len((h or "").encode()), sha1(h), "response" if first else "revisit", None if first else top] += 1
    assert Counter(tuple(r) for r in got) == want
    assert warc.archived_pages(spark.createDataFrame([], PAGES)).count() == 0


def test_payloads_are_stored_once_and_records_rebuilt(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://h/{k}", "same" if k % 2 else f"own {k}") for k in range(20)], PAGES)
    warc.write_archive(pages, f"{tmp_path}/w")
    assert spark.read.parquet(f"{tmp_path}/w/payloads").count() == 11
    records = warc.read_records(spark, f"{tmp_path}/w").collect()
    assert len(records) == 20 and all(bytes(r.record).startswith(b"WARC/1.1\r\nWARC-Type: re") and bytes(r.record).endswith(b"\r\n\r\n") for r in records)
    assert sum(bytes(r.record).count(b"same") for r in records) == 1
    warc.write_archive(pages, f"{tmp_path}/v", least=5)
    types = warc.parse_records(warc.read_records(spark, f"{tmp_path}/v")).groupBy("record_type").count().collect()
    assert {r["record_type"]: r["count"] for r in types} == {"response": 20}


# --- pipeline ----------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import random

    import corpus_pipeline
    from test_near_copies import brute_copies
    from test_tables import brute_contamination

    rng = random.Random(4)
    rows = [r for r in texts(9) if r[0] is not None]
    seen = set()
    rows = [r for r in rows if not (r[0] in seen or seen.add(r[0]))]
    item = sentence(rng, 20)
    rows += [(900, sentence(rng, 30) + " " + item, "en", "s0", 1), (901, sentence(rng, 50), "en", "s0", 1), (902, sentence(rng, 50), "de", "s1", 1)]
    documents(spark, rows, clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    now = [r for r in rows if language.LETTER.search(r[1] or "")]
    stay = {d for d, c in brute_copies(now) if d == c}
    now = [r for r in now if r[0] in stay]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), _ in zip(corpus_pipeline.STAGES[:2], range(2), strict=True):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert sorted(r.doc_id for r in docs.collect()) == sorted(r[0] for r in now)

    data = {r[0]: r[1].encode() for r in now}
    size = corpus_pipeline.PASSAGE_BYTES
    count = Counter(b[k : k + size] for b in data.values() for k in range(len(b) - size + 1))
    kept = {}
    for d, b in data.items():
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if count[b[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        text = bytes(c for c, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
        if text.strip():
            kept[d] = text
    dirty = {k[0] for k in brute_contamination([(d, t) for d, t in kept.items()], [(1, item)]) if k[-1]}
    assert 900 in dirty
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == set(kept) - dirty and {901, 902} <= set(out) and all(r.round_trip for r in out.values())
