"""Rules and quirks that the shared tables do not show."""

import random
import re
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.functions.urls import parse_link
from weftline.operators import admission, crawl, enrich, graph, search
from weftline.shared import ROWS_OUT
from weftline.sources import bucketed, store, tables
from weftline.streaming import jobs

T0 = datetime(2024, 1, 1)


def test_robots_standard(spark):
    files = [("a", "user-agent: Bot\nuser-agent: two\nDisallow: /x\nAllow: /x/y$\n\nUser-Agent: *\nDisallow: /"), ("b", "Disallow: /lost\nUser-agent: *\nDisallow:\nDisallow: /q?*z"), ("c", "")]
    rules = crawl.robots_rules(spark.createDataFrame(files, "domain string, contents string"))
    links = spark.createDataFrame([(d, p, q) for d in "abcd" for p, q in (("/x", None), ("/x/y", None), ("/x/yy", None), ("/q", "az"), ("/lost", None))], "domain string, path string, query string")
    got = lambda agent: {(r.domain, r.path) for r in crawl.robots_filter(links, rules, agent).collect()}
    everything = {(r.domain, r.path) for r in links.collect()}
    assert everything - got("bot") == {("a", "/x"), ("a", "/x/yy"), ("b", "/q")}
    assert everything - got("none") == {("a", p) for p in ("/x", "/x/y", "/x/yy", "/q", "/lost")} | {("b", "/q")}


def matches(pattern, target):
    end = pattern.endswith("$")
    return re.match(".*".join(map(re.escape, (pattern[:-1] if end else pattern).split("*"))) + ("$" if end else ""), target, re.S) is not None


def test_robots_by_prefix(spark):
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("ab/*$?."[: rng.choice((3, 7))]) for _ in range(n))
    rules = [(d, "*", rng.random() < 0.5, "/" * (rng.random() < 0.8) + letters(rng.randint(1, 6)), k) for k, d in enumerate("abc" * 30)]
    links = [(d, "/" + letters(rng.randint(0, 7)).replace("?", "").replace("*", "a"), rng.choice([None, "a", "b/a"])) for d in "abcd" * 40]
    want = set()
    for d, path, query in links:
        target = path + ("" if query is None else "?" + query)
        hits = [(len(p), allow) for e, _, allow, p, _ in rules if e == d and matches(p, target)]
        if not hits or max(hits)[1]:
            want.add((d, path, query))
    df, used = spark.createDataFrame(links, "domain string, path string, query string"), spark.createDataFrame(rules, "domain string, agent string, allow boolean, pattern string, line int")
    assert {tuple(r) for r in crawl.robots_filter(df, used).collect()} == want and len(want) < len(set(links))


def test_robots_of_a_large_domain(spark):
    """10^5 links and 10^3 rules of one domain: pairs with equal heads alone are formed."""
    big = F.lit("big").alias("domain")
    links = spark.range(100_000).select(big, F.format_string("/s%03d/page/%d", F.col("id") % 2000, F.col("id")).alias("path"), F.lit(None).cast("string").alias("query"))
    rules = spark.range(1000).select(big, F.lit("*").alias("agent"), F.lit(False).alias("allow"), F.concat(F.format_string("/s%03d/", F.col("id")), F.when(F.col("id") % 2 == 0, "*/1").otherwise("")).alias("pattern"))
    hits = crawl._pattern_hits(links, rules.select("domain", "allow", "pattern"))
    assert hits.count() == 50 * 500 + sum(str(k).startswith("1") for k in range(100_000) if k % 2000 < 1000 and k % 2 == 0)


def requests(spark, rows):
    return spark.createDataFrame([(k, d, u, T0 + timedelta(seconds=s)) for k, (d, u, s) in enumerate(rows)], "request_id long, domain string, url string, ts timestamp")


ROWS = [("d", "a", 0), ("d", "a", 2), ("d", "a", 3), ("d", "b", 4), ("d", "a", 5), ("d", "a", 9), ("d", "a", 10), ("e", "a", 1), ("e", "c", 1)]
WANT = [True, False, True, True, True, False, False, True, False]


def test_admission(spark):
    got = {r.request_id: r.admitted for r in crawl.crawl_admission(requests(spark, ROWS)).collect()}
    assert [got[k] for k in range(len(ROWS))] == WANT


def in_files(spark, df, at, *parts):
    """A stream whose micro-batches are the given parts of df."""
    for k, part in enumerate(parts):
        df.where(part).coalesce(1).write.parquet(f"{at}/in/p={k}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in/*")


def greedy(rows, gap):
    """(request_id: admitted) by the rule itself."""
    last, out = {}, {}
    for r in sorted(rows, key=lambda r: (r.ts, r.request_id)):
        out[r.request_id] = r.domain is not None and (r.domain not in last or r.ts - last[r.domain] >= timedelta(seconds=gap))
        if out[r.request_id]:
            last[r.domain] = r.ts
    return out


@pytest.mark.parametrize(("gap", "bin_seconds"), [(2, 3), (40, 7)])
def test_min_gap(spark, gap, bin_seconds):
    rng = random.Random(gap)
    rows = [(k, rng.choice(["a", "a", "a", "b", "c", None]), "u", T0 + timedelta(milliseconds=rng.choice((250, 1000)) * rng.randrange(600))) for k in range(400)]
    df = spark.createDataFrame(rows, "request_id long, domain string, url string, ts timestamp")
    got = {r.request_id: r.admitted for r in admission.min_gap_admission(df, gap, bin_seconds).collect()}
    assert got == greedy(df.collect(), gap) and sum(got.values()) > 3


def test_min_gap_stream_keeps_little(spark, tmp_path):
    rng = random.Random(7)
    rows = sorted((T0 + timedelta(milliseconds=500 * rng.randrange(2000)), k) for k in range(600))
    df = spark.createDataFrame([(k, f"d{k % 90}" if ts < T0 + timedelta(seconds=300) else "z", "u", ts) for ts, k in rows], "request_id long, domain string, url string, ts timestamp")
    cut = [f"ts >= timestamp'{T0 + timedelta(seconds=100 * k)}' and ts < timestamp'{T0 + timedelta(seconds=100 * k + 100)}'" for k in range(10)]
    save = lambda b, k: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={k}")
    run = jobs.min_gap_stream(in_files(spark, df, tmp_path, *cut), 3).writeStream.foreachBatch(save).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination()
    got = {r.request_id: r.admitted for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == greedy(df.collect(), 3) == {r.request_id: r.admitted for r in admission.min_gap_admission(df, 3).collect()}
    held = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    assert max(held) > 20 and held[-1] <= 1  # 90 domains came, the last hold one


def test_admission_forgets(spark, tmp_path):
    rng = random.Random(9)
    rows = [(k, f"d{k // 150}", f"u{rng.randrange(40)}", T0 + timedelta(seconds=(k // 150) * 4000 + rng.randrange(900) * 3)) for k in range(900)]
    df = spark.createDataFrame(rows, "request_id long, domain string, url string, ts timestamp")
    want = {r.request_id: r.admitted for r in crawl.crawl_admission(df, 30, 100).collect()}
    assert want != {r.request_id: r.admitted for r in crawl.crawl_admission(df, 30).collect()}
    cut = [f"ts >= timestamp'{T0 + timedelta(seconds=3000 * k)}' and ts < timestamp'{T0 + timedelta(seconds=3000 * k + 3000)}'" for k in range(8)]
    sizes = []

    def save(b, k):
        b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={k}")

    def step(b, k):
        jobs.admit_batches(f"{tmp_path}/state", save, 30, 100)(b, k)
        sizes.append((spark.read.parquet(f"{tmp_path}/state/spells/{k}").count(), spark.read.parquet(f"{tmp_path}/state/chains/{k}").count()))

    in_files(spark, df, tmp_path, *cut).writeStream.foreachBatch(step).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert {r.request_id: r.admitted for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want
    assert max(s for s, _ in sizes) <= 2 and max(c for _, c in sizes) <= 40  # of 6 domains with up to 40 URLs each


def test_batches_admitted_by_url(spark, tmp_path):
    df = requests(spark, ROWS)
    for k, part in enumerate((df.where("request_id < 3"), df.where("request_id between 3 and 5"), df.where("request_id > 5"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/p={k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    save = lambda b, k: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={k}")

    def twice(batch, k):  # as after a failure
        for _ in range(2):
            jobs.admit_batches(f"{tmp_path}/state", save)(batch, k)

    stream.writeStream.foreachBatch(twice).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = {r.request_id: r.admitted for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert [got[k] for k in range(len(ROWS))] == WANT


def test_labels_and_terms_that_are_unknown(spark):
    nodes = spark.createDataFrame([(1, ["SearchTerm"], "oslo"), (2, ["Title"], "Oslo")], "node_id long, labels array<string>, text string")
    assert [r.node_id for r in search.saved_search(nodes, search.saved_term(nodes, 1)).collect()] == [2]
    for call in (lambda: search.saved_term(nodes, 2), lambda: search.saved_term(nodes, 3), lambda: graph.nodes_with_label(nodes, "Titel")):
        with pytest.raises(ValueError):
            call()


def test_flags_set_or_toggled(spark):
    links = spark.createDataFrame([("a", "/", None, 8), ("a", "/", "q", 0)], "domain string, path string, query string, flags int")
    failed = links.select("domain", "path", "query")
    none = failed.withColumn("html", F.lit("")).limit(0)
    for mode, want in (("default", [8, 8]), ("reference", [0, 8])):
        out, pages = crawl.apply_fetch_results(links, none, failed, mode)
        assert [r.flags for r in out.orderBy(F.col("query").asc_nulls_first()).collect()] == want and pages.count() == 0


def test_an_answer_marks_the_link_that_asked(spark):
    links = spark.createDataFrame([("p", 1, "a", "/", None, 0), ("p", 2, "a", "/", None, 0), ("q", 1, "a", "/", None, 0), ("q", 2, "a", "/", None, 4)], "project_id string, node_id long, domain string, path string, query string, flags int")
    asked = links.drop("flags")
    got, failed = asked.where("project_id = 'p' and node_id = 2").withColumn("html", F.lit("x")), asked.where("project_id = 'q' and node_id = 1")
    out, pages = crawl.apply_fetch_results(links, got, failed, by=["project_id", "node_id"])
    assert sorted((r.project_id, r.node_id, r.flags) for r in out.collect()) == [("p", 1, 0), ("p", 2, 1), ("q", 1, 8), ("q", 2, 4)]
    assert [(r.project_id, r.node_id, r.domain, r.html) for r in pages.collect()] == [("p", 2, "a", "x")]


def test_new_links_treat_null_queries_as_equal(spark):
    rows = [("p", "a", "/", None), ("p", "a", "/", "q"), ("p", "a", "/", None)]
    found = spark.createDataFrame(rows, "project_id string, domain string, path string, query string")
    assert crawl.new_links(found, found.where("query is null")).collect() == found.where("query = 'q'").collect()
    assert crawl.new_links(found, found.limit(0)).count() == 2


def test_upsert_is_idempotent(spark):
    schema = "project_id string, node_id long, labels array<string>, text string, flags int, written_at timestamp"
    old = spark.createDataFrame([("p", 1, ["L"], "a", 1, T0)], schema)
    new = spark.createDataFrame([("p", 1, ["M"], "b", 0, T0 + timedelta(1)), ("p", 2, ["N"], "c", 0, T0)], schema)
    once = tables.upsert_nodes(old, new)
    rows = sorted((r.node_id, r.labels, r.text, r.flags) for r in once.collect())
    assert rows == [(1, ["L"], "b", 1), (2, ["N"], "c", 0)]
    assert sorted(tables.upsert_nodes(once, new).collect()) == sorted(once.collect())


def test_writing_a_project_keeps_the_others(spark, tmp_path):
    nodes = spark.createDataFrame([("one", 1), ("two", 2)], "project_id string, node_id long")
    edges = spark.createDataFrame([("one", 1, 1), ("two", 2, 2)], "project_id string, src long, dst long")
    for name in ("one", "two", "one"):
        tables.write_graph(nodes.where(F.col("project_id") == name), edges.where(F.col("project_id") == name), f"{tmp_path}/g")
    n, e = tables.read_graph(spark, f"{tmp_path}/g")
    assert sorted(r.node_id for r in n.collect()) == sorted(r.src for r in e.collect()) == [1, 2]


def state(at):
    """Names and times of all data files below a folder."""
    return {str(f.relative_to(at)): f.stat().st_mtime_ns for f in Path(at).rglob("*.parquet")}


def test_store_writes_what_it_touches(spark, tmp_path):
    at = f"{tmp_path}/graph"
    stored = store.GraphStore(spark, f"file://{at}", buckets=4)

    def rows(project, ids, text, day=0):
        n = spark.createDataFrame([(project, k, ["L"], text, 0, T0 + timedelta(day)) for k in ids], "project_id string, node_id long, labels array<string>, text string, flags int, written_at timestamp")
        return n, n.select("project_id", F.col("node_id").alias("src"), F.lit(1).alias("pos"), (F.col("node_id") + 1).alias("dst"), F.lit("ParentOf").alias("label"), "written_at")

    assert stored.upsert(*rows("one", range(40), "a")) and stored.upsert(*rows("two/2 x", range(10), "b"))
    before = state(at)
    assert stored.upsert(*rows("one", [3], "c", 1), batch=5)
    new = {f for f in state(at) if f not in before}
    assert len([f for f in new if "/nodes/" in f"/{f}"]) == len([f for f in new if "/edges/" in f"/{f}"]) == 1  # one part of each, and a ledger
    assert all(state(at)[f] == t for f, t in before.items())
    content = lambda s, *p: sorted((r.project_id, r.node_id, r.text) for r in s.read(*p)[0].collect())
    once = content(stored)
    assert ("one", 3, "c") in once and len(once) == 50 and stored.read()[1].count() == 50
    files = state(at)
    assert not stored.upsert(*rows("one", [3], "d", 2), batch=5) and not stored.upsert(*rows("one", [3], "d", 2), batch=1)
    assert state(at) == files and content(stored) == once
    assert content(stored, "two/2 x") == [("two/2 x", k, "b") for k in range(10)]
    # A batch that died before its ledger leaves files that nobody sees, and is written anew.
    stored.upsert(*rows("one", range(40), "lost", 9), batch=6)
    for f in Path(f"{at}/ledger/{6:012d}").iterdir():
        f.unlink()
    assert content(stored) == once
    assert stored.upsert(*rows("one", [4], "e", 3), batch=6) and ("one", 4, "e") in content(stored) and ("one", 3, "c") in content(stored)
    now = content(stored)
    assert stored.vacuum() > 0 and content(stored) == now and stored.committed() == [0, 1, 5, 6] and not stored.upsert(*rows("one", [9], "z"), batch=0)


PAGE = '<html><head><title>T</title></head><body><h1>H</h1><p>one</p><ul><li>i</li></ul><a href="/x">in</a><a href="https://new.example/y?q">out</a></body></html>'


def test_streamed_pages_are_those_of_the_batch(spark, tmp_path):
    pages = spark.createDataFrame([("p", "https://a.example/", PAGE, T0), ("p", "https://b.example/z?k=1", PAGE.replace("one", "two"), T0), ("q", "https://a.example/", "plain", T0), ("p", "http://a.example/#top", PAGE, T0 + timedelta(minutes=1))], "project_id string, url string, html string, fetched_at timestamp")
    for k in range(2):
        pages.where(f"minute(fetched_at) = {k}").coalesce(1).write.parquet(f"{tmp_path}/in/p={k}")
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    streamed, batch = store.GraphStore(spark, f"file://{tmp_path}/s", buckets=2), store.GraphStore(spark, f"file://{tmp_path}/b", buckets=2)
    jobs.stream_graph(stream, streamed, f"{tmp_path}/c").awaitTermination()
    files = state(f"{tmp_path}/s")
    links = pages.where("minute(fetched_at) = 0").select("project_id", parse_link(F.col("url")).alias("l"), "html", "fetched_at").select("project_id", "l.*", "html", "fetched_at")
    assert not jobs.save_pages(links, streamed, 0) and state(f"{tmp_path}/s") == files  # run again: nothing
    assert jobs.save_pages(links, batch)
    both = [[sorted(map(str, df.collect())) for df in s.read()] for s in (streamed, batch)]
    assert both[0] == both[1]
    nodes, edges = batch.read("p")
    count = {tuple(r.labels): r["count"] for r in nodes.groupBy("labels").count().collect()}
    assert count == {("DomainName",): 3, ("Link",): 5, ("Content", "WebPage"): 2, ("Content", "WebMetadata"): 2, ("Title", "Partial"): 2, ("Heading", "Partial"): 2, ("Paragraph", "Partial"): 2, ("UnorderedPoints", "Partial"): 2, ("ListItem", "Partial"): 2}
    assert edges.where("label = 'ParentOf'").count() == 2 * (5 + 1 + 2) and edges.where("label = 'BelongsTo'").count() == 5


def test_link_streamed_with_two_contents(spark, tmp_path):
    rows = [("p", "https://a.example/", PAGE, T0), ("p", "http://a.example/", PAGE.replace("one", "two"), T0), ("p", "https://a.example/", PAGE, T0 + timedelta(seconds=5))]
    spark.createDataFrame(rows, "project_id string, url string, html string, fetched_at timestamp").repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("project_id string, url string, html string, fetched_at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stored = store.GraphStore(spark, f"file://{tmp_path}/s", buckets=2)
    jobs.stream_graph(stream, stored, f"{tmp_path}/c").awaitTermination()
    nodes, edges = stored.read("p")
    text = lambda label: sorted(r.text for r in nodes.where(F.array_contains("labels", label)).collect())
    assert text("WebPage") == sorted({r[2] for r in rows}) and text("Paragraph") == ["one", "two"]
    assert nodes.where(F.array_contains("labels", "Link")).count() == 3 and edges.where("label = 'PathOf'").count() == 2


def test_explore_takes_the_first_way(spark):
    nodes = spark.createDataFrame([(1, ["Objective"]), (2, ["Link"]), (3, ["Link"]), (4, ["DomainName"]), (5, ["Title"]), (6, ["Link"])], "node_id long, labels array<string>")
    edges = spark.createDataFrame([(1, 1, 3), (1, 2, 2), (1, 3, 5), (3, 1, 4), (2, 1, 4), (4, 1, 1), (5, 1, 6)], "src long, pos int, dst long")
    got = {r.node_id: (r.depth, r.parent) for r in graph.explore(nodes, edges).collect()}
    assert got == {1: (0, None), 3: (1, 1), 2: (1, 1), 4: (2, 3)}


def test_both_ways_of_exploring(spark):
    rng = random.Random(2)
    label = {k: rng.choice(["Link", "Link", "DomainName", "Title"]) for k in range(2, 120)} | {1: "Objective"}
    nodes = spark.createDataFrame([(k, [v]) for k, v in label.items()], "node_id long, labels array<string>")
    edges = spark.createDataFrame([(rng.randint(1, 119), p, rng.randint(1, 119)) for p in range(500)] + [(1, 1000 + k, rng.randint(2, 119)) for k in range(6)], "src long, pos int, dst long")
    ways = {bottom_up: {r.node_id: (r.depth, r.parent, tuple(r.rank)) for r in graph.explore(nodes, edges, bottom_up=bottom_up).collect()} for bottom_up in (0.0, 0.3, 10.0)}
    assert ways[0.0] == ways[0.3] == ways[10.0] and len(ways[0.0]) > 40


def test_changes_are_pruned_by_folder(spark, tmp_path):
    rows = [(k % 7, k, k + 1, "ParentOf", T0 + timedelta(days=40 * (k % 5), hours=k % 7)) for k in range(60)]
    edges = spark.createDataFrame(rows, "src long, pos int, dst long, label string, written_at timestamp")
    tables.write_edge_changes(edges, f"{tmp_path}/log")
    ms = int((T0 + timedelta(days=160, hours=3)).replace(tzinfo=timezone.utc).timestamp() * 1000)
    found = tables.edges_changed_since(spark, f"{tmp_path}/log", ms)
    latest = {s: max(r[4] for r in rows if r[0] == s) for s in range(7)}
    assert sorted((r.src, r.pos, r.dst) for r in found.collect()) == sorted(r[:3] for r in rows if latest[r[0]] > T0 + timedelta(days=160, hours=3))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(changed_in" in plan and "Exchange" not in plan


def test_bucketed_tables_do_not_move(spark, tmp_path):
    nodes = spark.range(400).select(F.col("id").alias("node_id"), F.when(F.col("id") < 4, F.array(F.lit("DomainName"))).when(F.col("id") < 40, F.array(F.lit("Link"))).otherwise(F.array(F.lit("WebPage"))).alias("labels"), F.format_string("d%d.example", "id").alias("text"), F.struct(F.format_string("/%d", "id").alias("path"), F.lit(None).cast("string").alias("query")).alias("link"))
    edges = spark.range(4, 400).select(F.col("id").alias("src"), F.lit(1).alias("pos"), F.when(F.col("id") < 40, F.col("id") % 4).otherwise(4 + F.col("id") % 36).alias("dst"), F.when(F.col("id") < 40, "BelongsTo").otherwise("ContentOf").alias("label"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        with bucketed.bucketed_graph(nodes, edges, f"file://{tmp_path}/g", 4) as (n, e):
            first = n.where(F.array_contains("labels", "WebPage")).join(graph.first_neighbor(e, "ContentOf").withColumnRenamed("src", "node_id"), "node_id")
            assert first.count() == 360 and "Exchange" not in first._jdf.queryExecution().executedPlan().toString()
            found = {r.page_id: r.url for r in graph.page_urls(n, e).collect()}
            plan = graph.page_urls(n, e)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") <= 4 and "Exchange hashpartitioning(src" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == {k: f"https://d{(4 + k % 36) % 4}.example/{4 + k % 36}" for k in range(40, 400)}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("weftline_")]


def test_siblings_in_long_form(spark):
    """One parent of 200,000 children: a row a member, no list."""
    n = 200_000
    explored = spark.range(n).select((F.col("id") + 1).alias("node_id"), F.lit(1).alias("depth"), F.lit(0).cast("long").alias("parent"), F.array(F.lit(1)).alias("rank"))
    nodes = spark.range(n).select((F.col("id") + 1).alias("node_id"), F.when(F.col("id") % 2 == 0, F.array(F.lit("Link"), F.lit("Content"))).otherwise(F.array(F.lit("Link"))).alias("labels"))
    members = graph.sibling_groups(explored, nodes)
    assert members.columns == ["parent", "labels", "element", "members", "node_id"] and members.count() == n
    assert {tuple(r) for r in members.select("labels", "element", "members").distinct().collect()} == {("Content,Link", 1, n // 2), ("Link", 2, n // 2)}


def test_many_terms_use_an_automaton(spark, monkeypatch):
    parts = spark.createDataFrame([(1, "The Nile and Oslo"), (2, "x"), (3, None), (4, "oslo"), (5, "İzmir ÉCLAIR")], "node_id long, text string").withColumn("term", F.lit("clash"))
    terms = spark.createDataFrame([("oslo",), ("OSLO",), ("NILE",), ("x",), ("zzz",), ("",), ("Ni",), (None,), ("oslo",), ("éclair",), ("izmir",)], "term string")
    want = {("oslo", 1), ("oslo", 4), ("OSLO", 1), ("OSLO", 4), ("NILE", 1), ("x", 2), ("", 1), ("", 2), ("", 4), ("", 5), ("Ni", 1), ("éclair", 5)}
    for few, many in ((32, 50_000), (1, 50_000), (1, 3)):
        monkeypatch.setattr(search, "FEW_TERMS", few)
        monkeypatch.setattr(search, "AUTOMATON_TERMS", many)
        got = [tuple(r) for r in search.saved_search_all(parts, terms).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    plan = search.saved_search_all(parts, terms)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_hits_come_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(search, "HITS", 50)
    texts = pa.record_batch({"node_id": list(range(40)), "low": ["abcd" * (k % 3) for k in range(40)]})
    terms = [("a", "a"), ("A", "a"), ("bc", "bc"), ("bcda", "bcda"), ("", ""), ("x", "x")]
    out = list(search.hit_batches(terms)(iter([texts])))
    assert len(out) > 2 and max(b.num_rows for b in out) <= 50
    got = [(r["term"], r["node_id"]) for b in out for r in b.to_pylist()]
    assert sorted(got) == sorted((t, k) for t, low in terms for k in range(40) if low in "abcd" * (k % 3))


def test_long_terms_take_more_passes(spark, monkeypatch):
    parts = spark.createDataFrame([(1, "aaaabbbb"), (2, "bbbbcccc")], "node_id long, text string")
    terms = spark.createDataFrame([("aaaa",), ("bbbb",), ("cccc",), ("dddd",)], "term string")
    monkeypatch.setattr(search, "FEW_TERMS", 1)
    monkeypatch.setattr(search, "AUTOMATON_CHARS", 6)
    found = search.saved_search_all(parts, terms)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") >= 3
    assert sorted(map(tuple, found.collect())) == [("aaaa", 1), ("bbbb", 1), ("bbbb", 2), ("cccc", 2)]


def test_entities_come_in_bounded_batches():
    find = enrich.entity_batches(lambda: enrich.gazetteer({"Person": ["Al"], "Place": ["Rome"]}), 0.5)
    texts = pa.record_batch({"page_id": [str(k) for k in range(3000)], "content": ["Al in Rome", None, "Al"] * 1000, "_names": [["Person"]] * 3000})
    out = list(find(iter([texts])))
    assert len(out) > 2 and max(b.num_rows for b in out) <= ROWS_OUT
    rows = [r for b in out for r in b.to_pylist()]
    assert [len(r["entities"]) for r in rows] == [1, 0, 1] * 1000 and rows[2]["page_id"] == "2" and rows[2]["entities"][0]["matching_text"] == "Al"


def test_context_stays_on_the_page(spark):
    parts = spark.createDataFrame([(1, 0, "hit"), (1, 1, "next"), (1, 2, "far"), (2, 0, "other"), (2, 1, "")], "page_id long, pos int, text string")
    assert sorted((r.page_id, r.pos) for r in search.search_with_context(parts, ["HIT"]).collect()) == [(1, 0), (1, 1)]


def test_incremental_mark(spark):
    rows = spark.createDataFrame([(1, T0), (2, T0 + timedelta(milliseconds=5))], "node_id long, written_at timestamp")
    fresh, mark = jobs.incremental_sync(rows)
    assert fresh.count() == 2
    assert jobs.incremental_sync(rows, mark)[0].count() == 0 and jobs.incremental_sync(rows, mark)[1] == mark
    assert [r.node_id for r in jobs.incremental_sync(rows, mark - 5)[0].collect()] == [2]
