"""Answers of search services and language models as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.schemas import LLM_ENVELOPE


def parse_llm_json(answer: Column, schema: T.StructType) -> Column:
    """struct(value, parse_error) of a model's answer ``{id, content: [{type, text}]}``.

    The content must have exactly one item. A fence of three backquotes, with or
    without ``json``, is taken off its text, and the rest is read by ``schema``.
    """
    envelope = F.from_json(answer, LLM_ENVELOPE)
    one = F.when(F.size(envelope["content"]) == 1, F.get(envelope["content"], F.lit(0))["text"])
    bare = F.regexp_replace(F.regexp_replace(F.trim(one), r"^```(?:json)?", ""), r"```\s*$", "")
    value = F.from_json(F.trim(bare), schema)
    broken = value.isNull() | F.get_json_object(F.trim(bare), "$").isNull()
    return F.struct(F.when(~broken, value).alias("value"), broken.alias("parse_error"))
