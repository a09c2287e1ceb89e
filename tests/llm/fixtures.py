"""Small inputs with the hard cases: nulls, empty and long texts, repeats, and columns that clash."""

import random

from pyspark.sql import DataFrame, SparkSession

WORDS = "the of and to in is it you that he was for on are with as his they be at one have this from".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def texts(seed: int = 1) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars) rows."""
    rng = random.Random(seed)
    out = [sentence(rng, rng.randint(1, 200)) for _ in range(40)]
    passage = sentence(rng, 90)
    out += [sentence(rng, k) + " " + passage + " " + sentence(rng, 5) for k in range(12)]
    out += [out[3]] * 6 + [out[4] + " tail"] * 2 + [out[5].upper(), out[5]]
    out += ["", None, " \n\t ", "x", "é" * 500, "ab" * 3000, "word " * 4000, "a  b\n\n c\t", "日本語 😀 ▁ <|endoftext|>", "12 34", "line of text\n" * 80]
    rows = [(k * 3 + 1, t, ("en", "de", None, "xx")[k % 4], ("s0", "s0", "s1", None)[k % 4], None if t is None else len(t)) for k, t in enumerate(out)]
    return rows + [rows[0], rows[0], (rows[1][0], "same id, other text", "en", "s0", 19), (None, "no id at all", "en", None, None), (None, out[3], "fr", "s2", 1)]


def documents(spark: SparkSession, rows: list[tuple] | None = None, clash: bool = True) -> DataFrame:
    """Rows in three partitions, with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(texts() if rows is None else rows, SCHEMA)
    if clash:
        df = df.withColumns({c: F.lit(7) for c in ("key", "fingerprint", "digest", "shard", "n", "ids", "w", "component_id", "spans", "lead")})
    return df.repartition(3)
