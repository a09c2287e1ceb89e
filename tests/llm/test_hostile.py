"""Inputs that break a rule of thumb: odd urls, one-byte texts, long copies, missing libraries."""

import base64
import hashlib
from collections import Counter

from test_web import PAGES

from weftline.llm import warc


def test_archive_of_odd_urls(spark):
    urls = ["http://x.org/pРС", "http://x.org/\r\n\r\nX: y", "\r\n", "a\rb\nc", "http://x.org/中文", None, "http://x/%0D"]
    rows = [(k, u, h) for k, (u, h) in enumerate([(u, f"own \r\n\r\n {u}") for u in urls] + [(u, "same") for u in urls] + [(u, "\r\n\r\n") for u in urls])]
    got = warc.archived_pages(spark.createDataFrame(rows, PAGES)).collect()
    top = {h: max(p for p, _, x in rows if x == h) for _, _, h in rows}
    line = lambda p, u: f"urn:page:{p}" if u is None else u.replace("\r", "%0D").replace("\n", "%0A")
    digest = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    want = Counter((p, len(h.encode()), digest(h), "response" if p == top[h] else "revisit", None if p == top[h] else top[h], line(p, u)) for p, u, h in rows)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.uri) for r in got) == want


def test_short_payloads_are_responses_all(spark, tmp_path):
    rows = [(k, "u", "tiny" if k % 3 else f"long enough {k % 2}") for k in range(30)]
    got = warc.archived_pages(spark.createDataFrame(rows, PAGES), least=8).groupBy("record_type").count().collect()
    assert {r["record_type"]: r["count"] for r in got} == {"response": 22, "revisit": 8}


def test_wrong_bytes_stop_the_job(spark, tmp_path):
    import pytest
    from pyspark.sql import functions as F

    warc.write_archive(spark.createDataFrame([(1, "u", "abc"), (2, "v", "abd")], PAGES), f"{tmp_path}/w")
    records = warc.read_records(spark, f"{tmp_path}/w")
    assert warc.parse_records(records).count() == 2
    broken = records.withColumn("record", F.encode(F.replace(F.decode("record", "UTF-8"), F.lit("abd"), F.lit("abx")), "UTF-8"))
    with pytest.raises(Exception, match="does not match its header"):
        warc.parse_records(broken).collect()


def test_texts_that_repeat_themselves_at_once(spark):
    from fixtures import SCHEMA, sentence
    import random

    from test_tables import brute_removal

    from weftline.llm import suffixes

    rng = random.Random(2)
    s = lambda n: sentence(rng, n)
    bodies = ["a" * 5000, s(20) + "a" * 450 + s(20), s(20) + "a" * 400 + s(20), s(20) + "ab" * 300 + s(20), "b" + "ab" * 200, ("x" * 350 + "y") * 20, ("0123456789" * 30 + "q") * 6, s(60) + " " * 399 + s(60), "=" * 401, ("abc" * 50 + "z") * 9 + s(10)]
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(bodies)]
    for some in (rows, rows[:1], rows[3:5]):
        got = suffixes.removal_report(spark.createDataFrame(some, SCHEMA), 400).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_removal(some, 400)


def test_a_run_of_one_byte_has_few_anchors():
    from weftline.llm import suffixes

    data = b"a" * (20 << 20)
    place, first, last, spans = suffixes.anchors(data, 400)
    assert len(place) < 100 and suffixes._merge(spans) == [(0, len(data))]


def test_long_copies_of_items(spark):
    """Cost follows the length of a copied text, and so do the rows."""
    import random

    from fixtures import SCHEMA, sentence
    from test_tables import brute_contamination

    from weftline.llm import decontaminate

    item = sentence(random.Random(3), 20_000)
    rows, items = [(1, item, "en", "s", 1), (2, f"{item} more", "en", "s", 1)], [(1, item), (2, "word"), (3, "nowhere at all")]
    got = decontaminate.contamination(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == brute_contamination(rows, items)


def test_archive_leaves_no_tables(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (3, None, None)], "page_id long, url string, html string")
    before = len(spark.catalog.listTables())
    first = sorted(map(str, warc.archived_pages(pages).collect()))
    assert len(spark.catalog.listTables()) == before and sorted(map(str, warc.archived_pages(pages).collect())) == first


def test_a_read_archive_leaves_no_tables_and_stays_bucketed(spark, tmp_path):
    before = {t.name for t in spark.catalog.listTables()}
    warc.write_archive(spark.createDataFrame([(k, "u", f"own {k % 5}") for k in range(9)], PAGES), f"{tmp_path}/w")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        records = warc.read_records(spark, f"{tmp_path}/w")
        assert {t.name for t in spark.catalog.listTables()} == before
        assert "Bucketed: true" in records._jdf.queryExecution().executedPlan().toString()
        again = warc.read_records(spark, f"{tmp_path}/w")
        assert sorted(map(str, records.collect())) == sorted(map(str, again.collect())) and records.count() == 9
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
