"""Language of texts and pages by Bayesian fusion of several kinds of evidence."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.storage import Scratch, by_shuffle

LANGUAGES = ("de", "en", "es", "fr")
#: Hashed byte trigrams: 2 ** FEATURE_BITS of them, whatever the corpus holds.
FEATURE_BITS = 14
#: Trigrams overlap and depend on each other, so a text counts as this many independent ones at most.
TRIGRAMS = 200.0
#: Weight of the parent level in a host's prior, in pages.
PARENT = 5.0
#: Hosts up to which their counts are broadcast (some hundred bytes each).
HOSTS = 50_000
#: Trigrams a language must have been counted on before its level is known, and nats by which it must lie above what other languages get.
ENOUGH, GAP = 1 << 16, 1.0
SCRIPT = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->", re.S | re.I)
TAG = re.compile(r"<[^>]*>")
LETTER = re.compile(r"[^\W\d_]")


def visible_text(page: str | None) -> str:
    """The words of a page without scripts, styles, comments and tags."""
    return html.unescape(TAG.sub(" ", SCRIPT.sub(" ", page or "")))


def trigrams(text: str) -> np.ndarray:
    """Feature numbers of a text's byte trigrams, letters lower-cased, everything else as one space."""
    data = np.frombuffer(re.sub(r"[\W\d_]+", " ", f" {text.lower()} ").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.empty(0, np.int64)
    return (((data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - FEATURE_BITS)).astype(np.int64)


def train(labelled: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> np.ndarray:
    """Log probabilities (feature, language) with add-one smoothing, counted over all rows of ``labelled(text, lang)``.

    Rows with other labels are left out; a language without rows gets a flat
    distribution. Each task adds up its rows; at most features x languages sums
    reach the driver.
    """
    n = len(languages)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n, 1 << FEATURE_BITS), np.int64)
        for frame in frames:
            for text, lang in zip(frame["text"], frame["lang"], strict=True):
                total[languages.index(lang)] += np.bincount(trigrams(text), minlength=1 << FEATURE_BITS)
        k, feature = np.nonzero(total)
        yield pd.DataFrame({"k": k, "feature": feature, "n": total[k, feature]})

    rows = labelled.where(F.col("lang").isin(*languages) & F.col("text").isNotNull()).select("text", "lang")
    sums = rows.mapInPandas(count, "k long, feature long, n long").groupBy("k", "feature").agg(F.sum("n").alias("n")).toPandas()
    counts = np.ones((1 << FEATURE_BITS, n))
    counts[sums["feature"], sums["k"]] += sums["n"]
    return np.log(counts / counts.sum(axis=0))


def bounds(model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By language: the mean log likelihood per trigram below which a text is in none of the languages, and the deviation of one trigram.

    The bound is half way between what a language's own trigrams get under its
    distribution and the most that those of another language get there. A
    language with too few trigrams, or too near to another one, takes the mean
    bound of the rest; without any, nothing is bounded.
    """
    p = np.exp(model)
    levels = p.T @ model  # (of language, under language)
    own = np.diag(levels).copy()
    spread = np.sqrt(np.maximum((p * model**2).sum(axis=0) - own**2, 0))
    np.fill_diagonal(levels, -np.inf)
    others = levels.max(axis=0)
    known = (-model.min(axis=0) >= np.log(ENOUGH + len(model))) & (own - others >= GAP)
    if not known.any():
        return np.full(len(own), -np.inf), spread
    middle = (own + np.where(np.isfinite(others), others, own)) / 2
    return np.where(known, middle, middle[known].mean()), spread


def mean_loglik(model: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Mean log likelihood of a text's trigrams, by language (none: zeros); long texts are counted first, so memory does not grow with them."""
    if not len(features):
        return np.zeros(model.shape[1])
    if len(features) < len(model):
        return model[features].mean(axis=0)
    return np.bincount(features, minlength=len(model)) @ model / len(features)


def _within(model: np.ndarray, means: list[np.ndarray], sizes: list[int]) -> list[bool]:
    """Whether each text, given by its mean log likelihoods and trigrams, is as likely as texts of its likeliest language are; short texts get two deviations."""
    least, spread = bounds(model)
    out = []
    for mean, n in zip(means, sizes, strict=True):
        mean = mean if n else least
        k = mean.argmax()
        out.append(bool(mean[k] >= least[k] - 2 * spread[k] / np.sqrt(max(n / 3, 1))))  # trigrams overlap
    return out


def in_bounds(model: np.ndarray, found: list[np.ndarray]) -> list[bool]:
    """``_within`` for texts given by their trigrams."""
    return _within(model, [mean_loglik(model, f) for f in found], [len(f) for f in found])


def text_likelihoods(rows: DataFrame, model: np.ndarray, is_html: bool) -> DataFrame:
    """rows without ``text``, with ``loglik`` (an array, by language), ``letters`` (whether the text has any) and ``known`` (whether it is in bounds for a language)."""
    schema = T.StructType([*(f for f in rows.schema if f.name != "text"), T.StructField("loglik", T.ArrayType(T.DoubleType())), T.StructField("letters", T.BooleanType()), T.StructField("known", T.BooleanType())])

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            means, sizes, letters = [], [], []
            for raw in frame["text"]:
                text = visible_text(raw) if is_html else raw or ""
                found = trigrams(text)
                means.append(mean_loglik(model, found))
                sizes.append(len(found))
                letters.append(LETTER.search(text) is not None)
            loglik = [(m * min(n, TRIGRAMS)).tolist() for m, n in zip(means, sizes, strict=True)]
            yield frame.drop(columns="text").assign(loglik=loglik, letters=letters, known=_within(model, means, sizes))[schema.names]

    return rows.mapInPandas(score, schema)


def fuse(evidence: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """Adds ``text_lang``, ``lang``, ``posterior`` and ``priors`` to rows with loglik, letters, declared, host, domain and suffix.

    Every row is first put into the language that its text alone speaks for.
    Grouped counts of those give how often a language comes with each declared
    language, and how the languages are spread over each host, its domain, its
    address suffix and the whole table. A level's distribution is its counts plus PARENT
    times its parent's distribution (the whole table: plus one), and a row's own
    vote is taken off each level first. The posterior is text likelihood times
    declaration likelihood times host prior. Nulls in declared, host, domain or
    suffix are values of their own; a row without letters has no text evidence
    and casts no vote.
    """
    scratch = Scratch(evidence.sparkSession, "language")
    n = len(languages)
    own = F.array_position("loglik", F.array_max("loglik")).cast("int") - 1  # the first one of ties
    declared = F.when(F.col("declared").isin(*languages), F.col("declared")).otherwise(F.when(F.col("declared").isNull(), "none").otherwise("other"))
    rows = scratch.write(evidence.withColumns({"_own": F.when(F.col("letters"), own), "_declared": declared, "_host": F.coalesce("host", F.lit("")), "_domain": F.coalesce("domain", F.lit("")), "_suffix": F.coalesce("suffix", F.lit(""))}), "rows")
    votes = [F.count_if(F.col("_own") == k).cast("double") for k in range(n)]
    hosts = scratch.write(rows.groupBy("_host", "_domain", "_suffix").agg(F.array(*votes).alias("_at_host")), "hosts")
    summed = lambda level: F.array(*(F.sum(F.get("_at_host", F.lit(k))) for k in range(n))).alias(level)
    domains = hosts.groupBy("_domain", "_suffix").agg(summed("_at_domain"))
    suffixes = hosts.groupBy("_suffix").agg(summed("_at_suffix"))
    whole = hosts.agg(*(F.coalesce(F.sum(F.get("_at_host", F.lit(k))), F.lit(0.0)) for k in range(n))).first()
    forms = ["none", "other", *languages]
    table = {(r["_own"], r["_declared"]): r["n"] for r in rows.where("_own is not null").groupBy("_own", "_declared").agg(F.count("*").alias("n")).collect()}  # languages x forms
    levels = hosts.join(domains, ["_domain", "_suffix"]).join(suffixes, "_suffix").select("_host", "_domain", "_suffix", "_at_host", "_at_domain", "_at_suffix")
    # Spark would take the levels, as a product of three tables, for more than the rows.
    joined = rows.join(F.broadcast(levels) if hosts.limit(HOSTS + 1).count() <= HOSTS else by_shuffle(levels), ["_host", "_domain", "_suffix"])

    said = np.array([[table.get((k, f), 0) + 1 for f in forms] for k in range(n)], float)
    said = np.log(said / said.sum(axis=1, keepdims=True))
    names = np.array([*languages, None], dtype=object)
    added = [("text_lang", T.StringType()), ("lang_found", T.StringType()), ("posterior", T.DoubleType()), ("priors", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([*evidence.schema.fields, *(T.StructField(c, t) for c, t in added)])

    def posteriors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in (f for f in frames if len(f)):
            vote = frame["_own"].fillna(n).to_numpy().astype(int)
            mine = np.eye(n + 1)[vote][:, :n]
            top = np.array(whole) - mine
            prior = (top + 1.0) / (top.sum(axis=1, keepdims=True) + n)
            for level in ("_at_suffix", "_at_domain", "_at_host"):
                counts = np.array(frame[level].tolist()) - mine
                prior = (counts + PARENT * prior) / (counts.sum(axis=1, keepdims=True) + PARENT)
            logs = np.log(prior) + said[:, [forms.index(d) for d in frame["_declared"]]].T + np.array(frame["loglik"].tolist())
            odds = np.exp(logs - logs.max(axis=1, keepdims=True))
            yield frame.assign(text_lang=names[vote], lang_found=names[logs.argmax(axis=1)], posterior=odds.max(axis=1) / odds.sum(axis=1), priors=prior.tolist())[schema.names]

    return joined.mapInPandas(posteriors, schema)


def page_languages(pages: DataFrame, labelled: DataFrame, languages: tuple[str, ...] = LANGUAGES, accept: float = 0.5) -> DataFrame:
    """Language of every row of ``pages(page_id, url, html)``, by a text model from ``labelled(text, lang)``.

    Evidence: visible text, the ``lang`` of the html element (its primary
    subtag), the last label of the host, and host priors (host, last two labels,
    suffix, all). accepted: the text has letters, is as likely as texts of one of
    the languages are (``bounds``) and the posterior is ``accept`` or more. A null or malformed url has no host, a null html no text.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(
        "page_id", F.nullif(host, F.lit("")).alias("host"), F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")).alias("domain"), F.nullif(F.regexp_extract(host, r"([^.]+)$", 1), F.lit("")).alias("suffix"),
        F.nullif(F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z]+)", 1)), F.lit("")).alias("declared"), F.col("html").alias("text"),
    )
    out = fuse(text_likelihoods(rows, train(labelled, languages), is_html=True), languages)
    return out.select("page_id", "host", "suffix", "declared", "text_lang", F.col("lang_found").alias("lang"), "posterior", (F.col("letters") & F.col("known") & (F.col("posterior") >= accept)).alias("accepted"))


def _row_key(row: Column) -> Column:
    """128 bits of a row: a hash, and one that is seeded by it. Two rows of one key are taken for equal; 64 bits alone would make some of 10 ** 10 rows meet."""
    first = F.xxhash64(row)
    return F.concat(F.hex(first), F.lit(":"), F.hex(F.xxhash64(first, row)))


def in_known_language(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES, accept: float = 0.5) -> DataFrame:
    """The rows of docs whose text is in one of the languages, unchanged.

    The ``lang`` column is the declaration and trains the text model, ``source``
    is the host. Rows without letters in the text, less likely than texts of
    each language are (``bounds``), or with no language of posterior ``accept``
    or more, are rejected.
    """
    model = train(docs.select("text", "lang"), languages)
    rows = docs.withColumns({"_docs": F.struct(*docs.columns)}).select(F.col("_docs"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("suffix"))
    keyed = rows.withColumn("_key", _row_key(F.col("_docs")))
    found = fuse(text_likelihoods(keyed.select("_key", "declared", "host", "domain", "suffix", "text"), model, is_html=False), languages)
    bad = found.where(~(F.col("letters") & F.col("known") & (F.col("posterior") >= accept))).select("_key").distinct()
    return docs.withColumn("_key", _row_key(F.struct(*docs.columns))).join(bad, "_key", "left_anti").select(*docs.columns)
