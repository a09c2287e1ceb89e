"""Text functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_text(text: Column) -> Column:
    """Every run of (Unicode) white space becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x{1c}-\x{1f}&&[^\x{1c}-\x{1f}]]+", " "))


def slugify(text: Column) -> Column:
    """Lower case, other characters to dashes; one end is trimmed (the first that has dashes)."""
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.when(dashed.startswith("-"), F.regexp_replace(dashed, "^-+", "")).otherwise(F.regexp_replace(dashed, "-+$", ""))


def identifier_to_title(text: Column) -> Column:
    words = F.lower(F.regexp_replace(F.regexp_replace(text, "_", " "), "([a-z])([A-Z])", "$1 $2"))
    return F.trim(F.concat(F.upper(F.substring(words, 1, 1)), words.substr(F.lit(2), F.length(words))))


def time_ago(at: Column, now: Column) -> Column:
    """Age in words; null from twelve months of 30 days on, ``-`` without a time."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    seconds = F.floor((micros(now) - micros(at)) / 1_000_000)
    minutes, hours, days = (F.floor(seconds / n) for n in (60, 3600, 86400))
    months = F.floor(days / 30)
    say = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit} ago"))
    return F.when(at.isNull(), "-").when(seconds < 60, "Just now").when(minutes < 60, say(minutes, "mins")).when(hours < 24, say(hours, "hours")).when(days < 30, say(days, "days")).when(months < 12, say(months, "months"))


def preview(text: Column, n: int = 500) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def contains_any(text: Column, terms: list[str]) -> Column:
    """Whether a text holds any of the terms, without regard to case."""
    low = F.lower(text)
    return reduce(lambda a, t: a | low.contains(t.lower()), terms, F.lit(False))


def _pattern(terms: list[str]) -> str:
    quoted = ["\\Q" + t.replace("\\E", "\\E\\\\E\\Q") + "\\E" for t in ordered_terms(terms)]
    return "(?i)" + "|".join(quoted)


def ordered_terms(terms: list[str]) -> list[str]:
    """Terms by number of words, most first, then by alphabet."""
    return sorted(sorted(terms), key=lambda t: -len(t.split()))


def search_snippet(text: Column, terms: list[str], max_words: int = 50, mark: tuple[str, str] = ("<b>", "</b>")) -> Column:
    """Up to ``max_words`` words around the first match, terms marked, ``…`` at the end if cut.

    It starts at the beginning unless more than ``max_words`` words stand before
    the first match; then at three tenths of them, rounded half up.
    """
    words = F.split(text, r"\s+")
    at = F.regexp_instr(text, F.lit(_pattern(terms)))
    before = F.when(at > 0, F.size(F.split(text.substr(F.lit(1), at - 1), r"\s+"))).otherwise(0)
    start = F.when(before > max_words, F.floor(before * 0.3 + 0.5).cast("int")).otherwise(0)
    body = F.array_join(F.slice(words, start + 1, F.lit(max_words)), " ")
    marked = F.regexp_replace(body, _pattern(terms), f"{mark[0]}$0{mark[1]}")
    return F.when(start + max_words < F.size(words), F.concat(marked, F.lit("…"))).otherwise(marked)
