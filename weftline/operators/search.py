"""Text search over parts(page_id, pos, kind, text)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import contains_any
from weftline.shared import Steps

#: Terms up to which Spark tests each text for each term; more go through an automaton.
FEW_TERMS = 32
#: Terms of one automaton and their characters, which bound its memory; more take several passes over the texts.
AUTOMATON_TERMS, AUTOMATON_CHARS = 500_000, 4_000_000
#: Hits that a task holds at once.
HITS = 1 << 16


def saved_search(nodes: DataFrame, term: str) -> DataFrame:
    """Titles, headings and paragraphs that contain the term, without regard to case, in id order."""
    shown = F.arrays_overlap("labels", F.array(*map(F.lit, ("Title", "Heading", "Paragraph"))))
    return nodes.where(shown & F.lower("text").contains(term.lower())).orderBy("node_id")


def saved_term(nodes: DataFrame, node_id: int) -> str:
    """The text of a SearchTerm node, to search for; any other node, or none, is an error."""
    found = nodes.where((F.col("node_id") == node_id) & F.array_contains("labels", "SearchTerm")).select("text").first()
    if found is None:
        raise ValueError(f"node {node_id} is no search term")
    return found.text


def saved_search_all(parts: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, node_id) for each of the distinct ``terms(term)`` and each of ``parts(node_id, text)`` that contains it, without regard to case.

    Neither texts nor pieces of them are shuffled: terms go to all tasks, a few
    (counted first) as a broadcast table, more as Aho-Corasick automata that
    read a batch of texts once for all of their terms. An automaton has a
    bounded number of terms, so terms without end take passes, not memory. An
    empty term is in every text, a null one and a null text in none.
    """
    spark = parts.sparkSession
    distinct = terms.where("term is not null").select("term", F.lower("term").alias("low")).distinct()
    few = distinct.limit(FEW_TERMS + 1).collect()
    if len(few) <= FEW_TERMS:
        return parts.select("node_id", "text").join(F.broadcast(distinct), F.lower("text").contains(F.col("low"))).select("term", "node_id")
    table = Steps(spark, "terms").write(distinct, "terms")
    n, chars = table.agg(F.count("*"), F.sum(F.length("low"))).first()
    passes = max(-(-n // AUTOMATON_TERMS), -(-chars // AUTOMATON_CHARS))
    found = [_found(parts, [tuple(r) for r in table.where(F.pmod(F.xxhash64("term"), F.lit(passes)) == k).collect()]) for k in range(passes)]
    return reduce(DataFrame.unionByName, found)


def _found(parts: DataFrame, terms: list[tuple[str, str]]) -> DataFrame:
    """(term, node_id) of the texts that hold a term, by one automaton over the terms' lower-case forms."""
    key = parts.schema["node_id"].dataType.simpleString()
    return parts.where("text is not null").select("node_id", F.lower("text").alias("low")).mapInArrow(hit_batches(terms), f"term string, node_id {key}")


def hit_batches(terms: list[tuple[str, str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(term, node_id) of batches of (node_id, lower-case text), in batches of bounded size.

    A text's hits are numbers; Arrow looks up terms and ids, so a hit makes no Python row.
    """
    by_low: dict[str, list[str]] = {}
    for term, low in terms:
        by_low.setdefault(low, []).append(term)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, number = ahocorasick.Automaton(), itemgetter(1)
        for k, low in enumerate(by_low):
            if low:
                automaton.add_word(low, k)
        automaton.make_automaton()
        always = [k for k, low in enumerate(by_low) if not low]
        names = pa.array([t for own in by_low.values() for t in own], pa.string())
        counts = np.fromiter(map(len, by_low.values()), np.int64, len(by_low))
        starts = np.cumsum(counts) - counts

        def rows(batch: pa.RecordBatch, places: list[int], sizes: list[int], hits: list[int]) -> Iterator[pa.RecordBatch]:
            lows, place = np.array(hits, np.int64), np.repeat(places, sizes)
            n = counts[lows]  # terms that differ in case only have one lower-case form
            place, first = np.repeat(place, n), np.repeat(starts[lows] - (np.cumsum(n) - n), n)
            out = pa.RecordBatch.from_arrays([names.take(pa.array(first + np.arange(len(first)))), batch.column("node_id").take(pa.array(place))], ["term", "node_id"])
            for at in range(0, out.num_rows, HITS):
                yield out.slice(at, HITS)

        for batch in batches:
            places, sizes, hits = [], [], []
            for place, low in enumerate(batch.column("low")):
                own = [*always, *set(map(number, automaton.iter(low.as_py())))] if len(automaton) else always
                places.append(place)
                sizes.append(len(own))
                hits += own
                if len(hits) >= HITS:
                    yield from rows(batch, places, sizes, hits)
                    places, sizes, hits = [], [], []
            if hits:
                yield from rows(batch, places, sizes, hits)

    return run


def search_with_context(parts: DataFrame, terms: list[str]) -> DataFrame:
    """Parts that match a term themselves, or whose predecessor on the page does, with ``matches``."""
    match = (F.length("text") > 0) & contains_any(F.col("text"), terms)
    order = Window.partitionBy("page_id").orderBy("pos")
    marked = parts.withColumn("matches", F.coalesce(match, F.lit(False)))
    return marked.withColumn("_before", F.coalesce(F.lag("matches").over(order), F.lit(False))).where(F.col("matches") | F.col("_before")).drop("_before")


def multi_term_search(parts: DataFrame, terms: list[str]) -> DataFrame:
    """(page_id, parts): for each page with a match the places of matching parts and of those right after them."""
    found = search_with_context(parts, terms)
    return found.groupBy("page_id").agg(F.array_sort(F.collect_list("pos")).alias("parts"))
