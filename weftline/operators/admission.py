"""Politeness by a minimum gap: of a domain's requests, those that come long enough after the last one admitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.shared import Steps

#: Seconds of a domain's time that one task sorts; a hot domain is spread over such bins.
BIN_SECONDS = 600


def _bin(micros: Column, bin_seconds: int) -> Column:
    return F.floor(micros / (bin_seconds * 1_000_000)).cast("long")


def _started(rows: DataFrame, wait: int, bin_seconds: int, seen: DataFrame | None = None) -> DataFrame:
    """Adds ``bin`` and ``starts`` to ``rows(domain, request_id, micros)``: whether nothing of the domain came less than ``wait`` microseconds before.

    ``seen(domain, last)`` has the time of each domain's last request before these rows.
    """
    rows = rows.withColumn("bin", _bin(F.col("micros"), bin_seconds))
    bins = rows.groupBy("domain", "bin").agg(F.max("micros").alias("last"))
    before = F.lag("last").over(Window.partitionBy("domain").orderBy("bin"))  # a row a bin: few enough for a window over a domain
    bins = bins.select("domain", "bin", before.alias("before"))
    if seen is not None:
        bins = bins.join(seen.select("domain", F.col("last").alias("seen")), "domain", "left").select("domain", "bin", F.coalesce("before", "seen").alias("before"))
    order = Window.partitionBy("domain", "bin").orderBy("micros", "request_id")
    out = rows.join(bins, ["domain", "bin"]).withColumn("before", F.coalesce(F.lag("micros").over(order), "before"))
    return out.withColumn("starts", F.col("before").isNull() | (F.col("micros") - F.col("before") >= wait)).drop("before")


def first_of_spell(rows: DataFrame, forget: int, bin_seconds: int = BIN_SECONDS, seen: DataFrame | None = None) -> DataFrame:
    """Adds ``first`` (micros, request_id) to ``rows(domain, request_id, micros, …)``: the first request of the domain's spell, which ends when no request comes for more than ``forget`` seconds.

    ``seen(domain, first, last)`` has the spell that each domain was in before these rows.
    """
    started = _started(rows, forget * 1_000_000 + 1, bin_seconds, seen)
    start = F.when(F.col("starts"), F.struct("micros", "request_id"))
    bins = started.groupBy("domain", "bin").agg(F.max(start).alias("top"))
    by_bin = Window.partitionBy("domain").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("domain", "bin", F.last("top", ignorenulls=True).over(by_bin).alias("earlier"))
    if seen is not None:
        bins = bins.join(seen.select("domain", F.col("first").alias("seen")), "domain", "left").select("domain", "bin", F.coalesce("earlier", "seen").alias("earlier"))
    order = Window.partitionBy("domain", "bin").orderBy("micros", "request_id").rowsBetween(Window.unboundedPreceding, 0)
    out = started.withColumn("own", F.last(start, ignorenulls=True).over(order)).join(bins, ["domain", "bin"])
    return out.select(*rows.columns, F.coalesce("own", "earlier").alias("first"))


def _marked(requests: DataFrame, gap: int, bin_seconds: int) -> DataFrame:
    """(request_id, starts, next, next_starts) of ``requests(domain, request_id, micros)``.

    ``starts``: nothing of the domain came less than ``gap`` seconds before, so
    the request is admitted whatever was admitted before it. ``next`` is the
    domain's first request ``gap`` seconds or more later. Both are looked for in
    the bin of the time in question; where it has no such request, the bins
    around it give their last or first one.
    """
    wait = gap * 1_000_000
    started = _started(requests, wait, bin_seconds)
    seen = started.select("domain", F.col("micros").alias("at"), F.lit(1).alias("kind"), F.struct("micros", "request_id", "starts").alias("found"), F.lit(None).cast(requests.schema["request_id"].dataType).alias("asker"))
    asked = started.select("domain", (F.col("micros") + wait).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(seen.schema["found"].dataType).alias("found"), F.col("request_id").alias("asker"))
    both = seen.unionByName(asked).withColumn("bin", _bin(F.col("at"), bin_seconds))
    # Backwards in time, so that the frame only grows; of equal times requests come first, the least id last.
    back = Window.partitionBy("domain", "bin").orderBy(F.desc("at"), F.desc("kind"), F.desc("found.request_id")).rowsBetween(Window.unboundedPreceding, 0)
    answers = both.withColumn("next", F.last("found", ignorenulls=True).over(back)).where("kind = 0")
    # The bins that hold requests, and those that are only asked about, in one order.
    asks = answers.where("next is null").select("domain", "bin").distinct()
    firsts = started.groupBy("domain", "bin").agg(F.min(F.struct("micros", "request_id", "starts")).alias("first"))
    later = Window.partitionBy("domain").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    after = asks.join(firsts, ["domain", "bin"], "full").select("domain", "bin", F.last("first", ignorenulls=True).over(later).alias("after"))
    found = answers.join(after, ["domain", "bin"], "left").select(F.col("asker").alias("request_id"), F.coalesce("next", "after").alias("next"))
    return started.select("request_id", "starts").join(found, "request_id").select("request_id", "starts", F.col("next.request_id").alias("next"), F.col("next.starts").alias("next_starts"))


def min_gap_admission(requests: DataFrame, gap: int = 2, bin_seconds: int = BIN_SECONDS) -> DataFrame:
    """Adds ``admitted`` to requests(request_id, domain, url, ts), by a greedy minimum gap in the order of ts and request_id.

    A domain's first request is admitted, and each that comes ``gap`` seconds
    (1 or more) or more after the last one admitted. Each request points to the
    domain's next one that would be admitted after it; those admitted are what
    the pointers reach from requests that are admitted for sure. Pointers are
    doubled, so a way of n steps takes log2(n) rounds, and joined by request_id
    (which names a request), so a hot domain is spread like any other. Requests
    without a domain are not admitted.
    """
    if gap < 1:
        raise ValueError("gap must be 1 second or more")
    steps = Steps(requests.sparkSession, "gap")
    plain = requests.select("domain", "request_id", F.unix_micros("ts").alias("micros"))
    marked = steps.write(_marked(plain, gap, bin_seconds), "marked")
    admitted = marked.where("starts").select("request_id")
    jumps = marked.where("next is not null and not next_starts").select("request_id", "next")
    k = 0
    while not jumps.isEmpty():
        reached = admitted.join(jumps, "request_id").select(F.col("next").alias("request_id"))
        # Each way begins at another sure request and none leads into another, so nothing is reached twice.
        admitted = steps.write(admitted.unionByName(reached), f"admitted{k}")
        jumps = steps.write(jumps.join(jumps.select(F.col("request_id").alias("next"), F.col("next").alias("far")), "next").select("request_id", F.col("far").alias("next")), f"jumps{k}")
        steps.drop(f"admitted{k - 1}", f"jumps{k - 1}")
        k += 1
    return requests.join(admitted.withColumn("admitted", F.lit(True)), "request_id", "left").select(*requests.columns, F.coalesce("admitted", F.lit(False)).alias("admitted"))
