"""Structured Streaming twins of the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.functions.urls import parse_link
from weftline.operators.admission import first_of_spell
from weftline.operators.crawl import url_chains, whole_seconds
from weftline.operators.html import page_parts
from weftline.operators.ingest import page_graph
from weftline.shared import Steps, drop
from weftline.sources.store import GraphStore


def incremental_sync(rows: DataFrame, mark_ms: int | None = None) -> tuple[DataFrame, int | None]:
    """Rows written after the mark, and the new mark (the largest time among them, or the old one)."""
    fresh = rows if mark_ms is None else rows.where(F.unix_millis("written_at") > mark_ms)
    top = fresh.agg(F.max(F.unix_millis("written_at"))).first()[0]
    return fresh, mark_ms if top is None else top


def stream_sync(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """The same for a stream: the checkpoint holds the mark, each micro-batch goes to the sink."""
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_links(pages: DataFrame, delay: str = "1 hour", contents: bool = False) -> DataFrame:
    """Distinct links of a stream of fetched pages(project_id, url, html, fetched_at), with page_id if there; rows later than ``delay`` are dropped.

    With ``contents``, a link has a row for each of its contents, told apart by their SHA-256.
    """
    own = [c for c in ("page_id",) if c in pages.columns]
    links = pages.withColumn("l", parse_link(F.col("url"))).select("project_id", *own, "l.*", "html", "fetched_at").where("domain is not null")
    links = links.withColumn("query", F.coalesce("query", F.lit(""))).withWatermark("fetched_at", delay)
    key = ["project_id", "domain", "path", "query"]
    return links.withColumn("_sha", F.sha2("html", 256)).dropDuplicatesWithinWatermark([*key, "_sha"]).drop("_sha") if contents else links.dropDuplicatesWithinWatermark(key)


def stream_pages(pages: DataFrame, save: Callable[[DataFrame, int], None], checkpoint: str, delay: str = "1 hour"):
    """Runs ``stream_links`` over what is there and hands each micro-batch of new pages to ``save``."""
    return stream_links(pages, delay).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_parts(pages: DataFrame, save: Callable[[DataFrame, int], None], checkpoint: str, delay: str = "1 hour"):
    """The same, but each micro-batch's new pages (with page_id) are parsed, and their parts handed to ``save``."""
    found = page_parts(stream_links(pages, delay))
    return found.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_graph(pages: DataFrame, store: GraphStore, checkpoint: str, delay: str = "1 hour"):
    """Runs ``stream_links`` over what is there and merges each micro-batch's nodes and edges into the store: domains, links, pages, metadata, parts and the links found.

    A link that comes again with other contents has two pages, as in the reference, so nothing depends on which comes first.
    The store's ledger holds the numbers of micro-batches, so one that is run again changes nothing.
    """
    return stream_links(pages, delay, contents=True).writeStream.foreachBatch(lambda batch, k: save_pages(batch, store, k)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def save_pages(batch: DataFrame, store: GraphStore, k: int | None = None) -> bool:
    """Merges a batch of pages into the store; the batch is parsed only if it has rows and does not count yet."""
    if k is not None and k in store.committed():
        return False
    steps = Steps(batch.sparkSession, "ingest")
    batch = steps.write(batch, "batch")
    done = not batch.isEmpty() and store.upsert(*page_graph(batch, steps), k)
    steps.drop("batch", "pages", "parts")
    return done


ADMISSION = "request_id long, domain string, url string, ts timestamp, admitted boolean"
#: What is kept between micro-batches: each domain's spell, and each late URL's last request and whether it is denied.
SPELLS = "domain string, first struct<micros: long, request_id: long>, last long"
CHAINS = "domain string, url string, micros long, request_id long, denied boolean"


def admit_batches(root: str, save: Callable[[DataFrame, int], None], gap: int = 2, forget: int | None = None) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that hands ``save`` each micro-batch of requests(request_id, domain, url, ts) with ``admitted``.

    The rule is that of crawl_admission. Work is dealt by (domain, url), so a hot
    domain is spread over its URLs; of a domain only its spell is kept. State
    tables of each batch are written under the shared folder ``root``, so a
    batch that is run again starts from the one before it. With ``forget``,
    domains and URLs without a request for more than so many seconds before
    the latest one leave the state, which then grows with what is active and
    not with what was ever seen. Requests must arrive in the order of their
    times, micro-batch by micro-batch.
    """

    def step(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        columns = ["request_id", "domain", "url", "ts"]

        def before(name: str, schema: str) -> DataFrame:
            return spark.read.schema(schema).parquet(f"{root}/{name}/{k - 1}") if k else spark.createDataFrame([], schema)

        def written(df: DataFrame, name: str) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{root}/{name}/{k}")
            return spark.read.schema(df.schema).parquet(f"{root}/{name}/{k}")

        batch = written(batch.select(*columns).withColumn("micros", F.unix_micros("ts")), "batch")
        plain, spells, chains = batch.where("domain is not null"), before("spells", SPELLS), before("chains", CHAINS)
        if forget is None:
            new = plain.groupBy("domain").agg(F.min(F.struct("micros", "request_id")).alias("own"), F.max("micros").alias("own_last")).join(spells, "domain", "full")
            spells = written(new.select("domain", F.coalesce("first", "own").alias("first"), F.greatest("last", "own_last").alias("last")), "spells")
            known = plain.join(spells.select("domain", "first"), "domain")
        else:
            known = written(first_of_spell(plain, forget, seen=spells), "known")
            new = known.groupBy("domain").agg(F.max("first").alias("first"), F.max("micros").alias("last"))
            latest = new.agg(F.max("last")).first()[0]
            kept = spells.join(new, "domain", "left_anti")
            spells = written(new.unionByName(kept if latest is None else kept.where(F.col("last") >= latest - forget * 1_000_000)), "spells")
        opens = (F.col("micros") == F.col("first.micros")) & (F.col("request_id") == F.col("first.request_id"))
        is_late = ~opens & (whole_seconds(F.col("micros"), F.col("first.micros")) > gap)
        rows = chains.withColumn("ts", F.lit(None).cast("timestamp")).unionByName(known.where(is_late).select(*columns, "micros", F.lit(False).alias("denied")))
        rows = written(url_chains(rows, gap, forget), "rows")
        last = rows.groupBy("domain", "url").agg(F.max(F.struct("micros", "request_id", "denied")).alias("l")).select("domain", "url", "l.*")
        if forget is not None and latest is not None:
            last = last.where(F.col("micros") >= latest - forget * 1_000_000)
        written(last, "chains")
        late = rows.where("ts is not null").select(*columns, (~F.col("denied")).alias("admitted"))
        unknown = batch.where("domain is null").select(*columns, F.lit(False).alias("admitted"))
        save(known.where(~is_late).select(*columns, opens.alias("admitted")).unionByName(late).unionByName(unknown), k)
        for name in ("batch", "known", "rows"):
            drop(spark, f"{root}/{name}/{k}")
        for name in ("spells", "chains"):
            drop(spark, f"{root}/{name}/{k - 2}")

    return step


def min_gap_stream(requests: DataFrame, gap: int = 2, delay: str = "0 seconds") -> DataFrame:
    """min_gap_admission of a stream of requests(request_id, domain, url, ts), in the state store.

    A domain's state is the time of its last admission. It has a time limit: once
    the watermark (``delay`` behind the latest request) is ``gap`` seconds past
    it, the next request is admitted anyway, and the state goes. So the store
    holds the domains of the last seconds only. All requests of a domain in a
    micro-batch meet in one task, one after the other; requests of a domain
    must arrive in the order of their times, micro-batch by micro-batch.
    """

    def admit(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        # The frames of a key are not in order: numbers are sorted, rows are not gathered in Python objects.
        rows = pd.concat(list(frames)).sort_values(["ts", "request_id"])
        micros, out = rows["ts"].astype("int64").to_numpy() // (1 if rows["ts"].dtype.name.endswith("us]") else 1000), []
        for t in micros.tolist():
            out.append(last is None or t - last >= gap * 1_000_000)
            last = t if out[-1] else last
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + gap * 1000, state.getCurrentWatermarkMs() + 1))
        yield rows.assign(admitted=out)[["request_id", "domain", "url", "ts", "admitted"]]

    own = requests.where("domain is not null").withWatermark("ts", delay)
    return own.groupBy("domain").applyInPandasWithState(admit, ADMISSION, "last long", "append", GroupStateTimeout.EventTimeTimeout)
