"""Dated URL lists applied to captures as of their fetch time, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.storage import Scratch, broadcast_up_to

#: Days in a bin of the as-of join.
BIN_DAYS = 32
URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)"


def validity(entries: DataFrame) -> DataFrame:
    """(list_id, pattern, verdict, valid_from, valid_to) of ``entries(list_id, pattern, verdict, action, day)``.

    An ``add`` holds from its day up to the day of the next change of the same
    entry (null: still held). Changes of one entry on one day count once, and a
    ``drop`` outweighs an ``add`` of that day; this also bounds an entry's
    history by its days before it is ordered. Rows with a null key or day say
    nothing; null list_ids are a list of their own.
    """
    key = ["list_id", "pattern", "verdict"]
    by_day = entries.where("pattern is not null and verdict is not null and day is not null").groupBy(*key, "day").agg(F.max(F.col("action") == "drop").alias("dropped"), F.max(F.col("action") == "add").alias("added")).where("dropped or added")
    until = F.lead("day").over(Window.partitionBy(*key).orderBy("day"))
    return by_day.select(*key, F.col("day").alias("valid_from"), until.alias("valid_to"), "dropped").where("not dropped").drop("dropped")


def _patterns(host: Column, path: Column, depth: int) -> Column:
    """Host, its parent domains, and host with each path prefix up to ``depth`` folders."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    if depth < 1:
        return domains
    folders = F.filter(F.split(path, "/"), lambda x: x != "")
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.size(folders), F.lit(depth))), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(folders, 1, i), "/")))
    return F.array_distinct(F.concat(domains, prefixes))


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, url, fetched_at, active, pattern, blocked): a row for each row of ``captures(page_id, url, fetched_at)``.

    An entry's pattern is a domain (it covers its subdomains) or a host with a
    path prefix of whole folders. Of the entries active on the capture's day the
    one with the longest pattern decides, and ``allow`` wins a tie; ``active``
    counts the entries that apply. Without any, a capture is not blocked.

    The as-of join is an equi-join on pattern and a bin of days into which
    intervals are cut, so a pattern with a long history costs a capture only
    the changes of one bin, and rows of a hot host can be split by AQE. A null
    or malformed url matches nothing, a null time too.
    """
    last = captures.agg(F.max(F.to_date("fetched_at"))).first()[0]
    spans = Scratch(captures.sparkSession, "lists").write(validity(entries), "spans")  # read three times
    depth = spans.agg(F.max(F.size(F.filter(F.split("pattern", "/"), lambda x: x != ""))) - 1).first()[0] or 0
    number = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / BIN_DAYS)
    end = F.least(F.coalesce(F.date_sub("valid_to", 1), F.lit(last)), F.lit(last))
    bins = spans.where(F.col("valid_from") <= F.lit(last)).withColumn("bin", F.explode(F.sequence(number(F.col("valid_from")), F.greatest(number(F.col("valid_from")), number(end)))))
    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, URL, 1))
    seen = captures.select("page_id", "url", "fetched_at", F.monotonically_increasing_id().alias("row"), F.to_date("fetched_at").alias("at"), host.alias("host"), F.regexp_extract(url, URL, 2).alias("path"))
    keys = seen.select("page_id", "url", "fetched_at", "row", "at", number(F.col("at")).alias("bin"), F.explode(_patterns(F.col("host"), F.col("path"), int(depth))).alias("pattern"))
    active = (F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    hits = keys.join(broadcast_up_to(bins, 50_000), ["pattern", "bin"], "left").withColumn("hit", F.coalesce(active, F.lit(False)))
    best = F.max(F.when(F.col("hit"), F.struct(F.length("pattern").alias("size"), (F.col("verdict") == "allow").alias("allow"), F.col("pattern").alias("pattern"))))
    out = hits.groupBy("row", "page_id", "url", "fetched_at").agg(F.count_if("hit").alias("active"), best.alias("best"))
    return out.select("page_id", "url", "fetched_at", "active", F.col("best.pattern").alias("pattern"), F.coalesce(~F.col("best.allow"), F.lit(False)).alias("blocked"))


def _number(column: str) -> Column:
    return F.conv(F.substring(F.md5(F.col(column)), 1, 6), 16, 10).cast("long")


def derived_captures(pages: DataFrame) -> DataFrame:
    """Captures of the pages table, with fetch times spread over 2024 by page_id."""
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id") * 7919, F.lit(366)) * 86400 + 3600).alias("fetched_at"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """A dated list made from the pages' own hosts: some blocked for a while, some for good,
    whole domains, and first folders of some hosts allowed again."""
    url = F.coalesce("url", F.lit(""))
    parts = pages.select(F.lower(F.regexp_extract(url, URL, 1)).alias("host"), F.regexp_extract(url, r"://[^/?#]*/([^/?#]+)", 1).alias("folder")).where("host != ''").distinct()
    hosts = parts.select("host", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("domain")).distinct().withColumn("h", _number("host"))
    domains = hosts.where("domain != ''").select("domain").distinct().withColumn("h", _number("domain"))
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    h = F.col("h")
    row = lambda df, name, pattern, verdict, action, n: df.select(F.lit(name).alias("list_id"), pattern.alias("pattern"), F.lit(verdict).alias("verdict"), F.lit(action).alias("action"), day(n).alias("day"))
    some, host = hosts.where(h % 3 == 0), F.col("host")
    out = row(some, "hosts", host, "block", "add", h % 200)
    out = out.unionByName(row(some.where(h % 2 == 0), "hosts", host, "block", "drop", h % 200 + 45))
    out = out.unionByName(row(some.where(h % 4 == 0), "hosts", host, "block", "add", h % 200 + 90))
    out = out.unionByName(row(domains.where(h % 4 == 1), "domains", F.col("domain"), "block", "add", h % 300))
    folders = parts.where("folder != ''").withColumn("h", _number("host")).where(h % 5 == 0)
    return out.unionByName(row(folders, "folders", F.concat(host, F.lit("/"), F.col("folder")), "allow", "add", h % 100))


#: The same rows in DuckDB: every capture against every entry's intervals.
ORACLE = r"""
WITH c AS (SELECT page_id, url, TIMESTAMP '2024-01-01 01:00:00' + to_days((page_id * 7919 % 366)::INT) AS fetched_at,
    lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)', 1)) AS host,
    list_filter(string_split(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)', 2), '/'), lambda x: x <> '') AS dirs,
    regexp_extract(coalesce(url, ''), '://[^/?#]*/([^/?#]+)', 1) AS folder FROM pages),
hosts AS (SELECT DISTINCT host, regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS domain, ('0x' || substr(md5(host), 1, 6))::BIGINT AS h FROM c WHERE host <> ''),
domains AS (SELECT domain, ('0x' || substr(md5(domain), 1, 6))::BIGINT AS h FROM (SELECT DISTINCT domain FROM hosts WHERE domain <> '')),
e AS (
  SELECT 'hosts' AS list_id, host AS pattern, 'block' AS verdict, 'add' AS action, h % 200 AS n FROM hosts WHERE h % 3 = 0
  UNION ALL SELECT 'hosts', host, 'block', 'drop', h % 200 + 45 FROM hosts WHERE h % 3 = 0 AND h % 2 = 0
  UNION ALL SELECT 'hosts', host, 'block', 'add', h % 200 + 90 FROM hosts WHERE h % 3 = 0 AND h % 4 = 0
  UNION ALL SELECT 'domains', domain, 'block', 'add', h % 300 FROM domains WHERE h % 4 = 1
  UNION ALL SELECT 'folders', f.host || '/' || f.folder, 'allow', 'add', h % 100 FROM (SELECT DISTINCT host, folder FROM c WHERE host <> '' AND folder <> '') f JOIN hosts USING (host) WHERE h % 5 = 0),
v AS (SELECT *, DATE '2024-01-01' + n::INT AS valid_from, lead(DATE '2024-01-01' + n::INT) OVER (PARTITION BY list_id, pattern, verdict ORDER BY n) AS valid_to FROM e),
k AS (SELECT page_id, url, fetched_at, unnest(list_distinct(list_concat(
    [array_to_string(string_split(host, '.')[i:], '.') FOR i IN range(1, len(string_split(host, '.')) + 1)],
    [host || '/' || array_to_string(dirs[1:i], '/') FOR i IN range(0, least(len(dirs), 1) + 1)]))) AS pattern FROM c),
m AS (SELECT k.page_id, k.url, k.fetched_at, k.pattern, v.verdict FROM k JOIN v ON k.pattern = v.pattern AND v.action = 'add'
      AND v.valid_from <= k.fetched_at::DATE AND (v.valid_to IS NULL OR k.fetched_at::DATE < v.valid_to)),
b AS (SELECT page_id, url, fetched_at, count(*) AS active, max({'n': length(pattern), 'a': verdict = 'allow', 'p': pattern}) AS best FROM m GROUP BY ALL)
SELECT c.page_id, c.url, c.fetched_at, coalesce(active, 0)::BIGINT AS active, best.p AS pattern, coalesce(NOT best.a, false) AS blocked
FROM c LEFT JOIN b USING (page_id, url, fetched_at)
"""
