"""Classification and entities by pluggable models, and the reports made from them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.answers import parse_llm_json
from weftline.functions.text import contains_any
from weftline.functions.urls import host_name
from weftline.schemas import CLASSIFICATION, ENTITY, ENTITY_NAMES, PLAN
from weftline.shared import arrow_batches, python_rows

ANSWER_SCHEMA = "{ is_relevant: boolean, reason: string, insight_if_classified_as_relevant: string | null }"


def classification_question(prompt: Column) -> Column:
    """What follows the first ``": "`` of a settings prompt, up to the next one; the whole prompt without one."""
    pieces = F.split(prompt, ": ")
    return F.when(F.size(pieces) > 1, F.get(pieces, F.lit(1))).otherwise(prompt)


def classification_prompts(pages: DataFrame, settings: DataFrame) -> DataFrame:
    """(project_id, page_id, prompt) of pages(project_id, page_id, content) and settings(project_id, prompt)."""
    rows = pages.join(settings.select("project_id", classification_question(F.col("prompt")).alias("q")), "project_id")
    text = F.concat("q", F.lit("\n\nContent:\n"), "content", F.lit(f"\n\nAnswer as JSON of this form:\n{ANSWER_SCHEMA}\n"))
    return rows.select("project_id", "page_id", text.alias("prompt"))


def keyword_model(keywords: list[str]) -> Callable[[list[str]], list[str]]:
    """A stand-in for a language model: a text is relevant if it holds a keyword."""

    def answer(prompts: list[str]) -> list[str]:
        import json

        out = []
        for prompt in prompts:
            low = prompt.lower()
            hit = next((k for k in keywords if k.lower() in low), None)
            value = {"is_relevant": hit is not None, "reason": f"holds {hit}" if hit else "no keyword", "insight_if_classified_as_relevant": hit}
            out.append(json.dumps({"id": "m", "content": [{"type": "text", "text": "```json\n" + json.dumps(value) + "\n```"}]}))
        return out

    return answer


def classify(prompts: DataFrame, make_model: Callable[[], Callable[[list[str]], list[str]]]) -> DataFrame:
    """prompts with ``answer``; the model is made once a task and gets batches of prompts."""
    schema = T.StructType([*prompts.schema.fields, T.StructField("answer", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for frame in frames:
            yield frame.assign(answer=model(frame["prompt"].tolist()))

    return prompts.mapInPandas(run, schema)


def parse_classifications(answers: DataFrame) -> DataFrame:
    """(page_id, is_relevant, reason, insight) of ``answers(page_id, answer)``; those that do not parse are left out."""
    rows = answers.select("page_id", parse_llm_json(F.col("answer"), CLASSIFICATION).alias("a")).where("not a.parse_error and a.value.is_relevant is not null")
    return rows.select("page_id", "a.value.is_relevant", "a.value.reason", F.col("a.value.insight_if_classified_as_relevant").alias("insight"))


def objective_plan(answers: DataFrame) -> DataFrame:
    """(objective_id, pos, tool, values): the tools a plan asks for, with keywords, prompt or entity names as values."""
    tools = answers.select("objective_id", F.posexplode(parse_llm_json(F.col("answer"), PLAN)["value"]["tools_needed_to_accomplish_objective"]).alias("pos", "t"))
    keywords, prompt = F.col("t.Crawler.keywords_to_get_accurate_results_from_web_search"), F.col("t.Classifier.prompt_to_classify_content_as_relevant_to_objective_or_not")
    names = F.filter("t.NamedEntityExtraction", lambda n: n.isin(*ENTITY_NAMES))
    tool = F.when(F.col("t.Crawler").isNotNull(), "Crawler").when(F.col("t.Classifier").isNotNull(), "Classifier").when(F.col("t.NamedEntityExtraction").isNotNull(), "NamedEntityExtraction")
    values = F.when(tool == "Crawler", keywords).when(tool == "Classifier", F.array(prompt)).otherwise(names)
    return tools.select("objective_id", "pos", tool.alias("tool"), values.alias("values")).where("tool is not null")


def gazetteer(names: dict[str, list[str]], dates: str = r"\b\d{4}-\d{2}-\d{2}\b") -> Callable[[str, set[str]], list[tuple[str, str, int, int, float]]]:
    """A stand-in for an entity model: listed words, and dates by a pattern; (class, text, start, end, probability)."""
    patterns = [(c, re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(words, key=lambda w: (-len(w), w)))) + r")\b")) for c, words in names.items() if words]
    patterns.append(("Date", re.compile(dates)))

    def find(text: str, wanted: set[str]) -> list[tuple[str, str, int, int, float]]:
        return sorted(((c, m[0], m.start(), m.end(), 1.0) for c, p in patterns if c in wanted for m in p.finditer(text)), key=lambda e: e[2])

    return find


def extract_entities(pages: DataFrame, labels: DataFrame, make_extractor: Callable[[], Callable], least: float = 0.5) -> DataFrame:
    """(page_id, entities) of pages(project_id, page_id, content) whose project asks for entities in ``labels(project_id, names)``.

    Spans of unknown classes and those less likely than ``least`` are dropped; the extractor is made once a task.
    """
    asked = pages.join(labels.select("project_id", F.col("names").alias("_names")), "project_id").select("page_id", "content", "_names")
    schema = T.StructType([pages.schema["page_id"], T.StructField("entities", T.ArrayType(ENTITY))])
    return asked.mapInArrow(entity_batches(make_extractor, least), schema)


def entity_batches(make_extractor: Callable[[], Callable], least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Entities of batches of (page_id, content, names); of a batch only a few texts and some spans are Python objects at once."""
    names = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float32())
    spans = pa.list_(pa.struct(list(zip(ENTITY.names, names, strict=True))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = make_extractor()

        def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
            for page, text, asked in python_rows(batch):
                found = find(text or "", {n for n in asked if n in ENTITY_NAMES})
                yield page, [dict(zip(ENTITY.names, e, strict=True)) for e in found if e[0] in ENTITY_NAMES and e[4] >= least]

        for batch in batches:
            yield from arrow_batches(rows(batch), pa.schema([batch.schema.field("page_id"), pa.field("entities", spans)]))

    return run


def entity_rollup(page_entities: DataFrame, name: str | None = None) -> DataFrame:
    """(entity_name, matching_text): the distinct texts of each class over all pages, in long form, so that four classes are not four rows."""
    rows = page_entities.select(F.explode("entities").alias("e")).select("e.entity_name", "e.matching_text").distinct()
    return rows if name is None else rows.where(F.col("entity_name") == name)


def page_entity_groups(page_entities: DataFrame) -> DataFrame:
    """(page_id, entity_name, texts): per page and class the distinct texts in the order of their first mention."""
    rows = page_entities.select("page_id", F.posexplode("entities").alias("pos", "e")).groupBy("page_id", "e.entity_name", "e.matching_text").agg(F.min("pos").alias("pos"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "matching_text"))), lambda t: t["matching_text"])
    return rows.groupBy("page_id", "entity_name").agg(texts.alias("texts"))


def relevant_pages(pages: DataFrame, classifications: DataFrame, only_matches: bool = False) -> DataFrame:
    found = classifications.where("is_relevant") if only_matches else classifications
    return pages.join(found.select("page_id"), "page_id", "left_semi")


def classified_items(page_urls: DataFrame, classifications: DataFrame, is_relevant: bool | None = None) -> DataFrame:
    """(page_id, url, is_relevant, reason, insight) of pages with both a URL and a classification."""
    found = classifications if is_relevant is None else classifications.where(F.col("is_relevant") == is_relevant)
    return page_urls.join(found, "page_id").select("page_id", "url", "is_relevant", "reason", "insight")


def page_cards(metadata: DataFrame, urls: DataFrame, classifications: DataFrame, entity_groups: DataFrame) -> DataFrame:
    """One card for each page with metadata and a classification; all inputs are keyed by page_id."""
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    names = entity_groups.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("entity_name", "texts"))).alias("entities"))
    rows = metadata.join(classifications, "page_id").join(urls.select("page_id", F.col("url").alias("own_url")), "page_id", "left").join(names, "page_id", "left")
    tags = F.filter(F.transform(F.flatten(F.transform("tags", lambda t: F.split(t, ","))), lambda t: F.trim(t)), lambda t: t != "")
    url = F.coalesce(blank("url"), F.col("own_url"))
    site = F.coalesce(blank("site_name"), F.regexp_extract(host_name(url), r"^([^/?#:]*)", 1))
    return rows.select("page_id", url.alias("url"), site.alias("site_name"), "title", tags.alias("tags"), "is_relevant", "reason", "insight", "entities")
