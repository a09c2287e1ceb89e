import pytest
from pyspark.sql import functions as F

from weftline.functions import text, urls
from weftline.functions.answers import parse_llm_json
from weftline.schemas import CLASSIFICATION

PARSED = {
    "https://A.Example:443/für?q=ä b#f": ("a.example", "/f%C3%BCr", "q=%C3%A4%20b"),
    "http://u:p@a.example": ("a.example", "/", None),
    "https://a.example/x/../y/./z?": ("a.example", "/y/z", ""),
    "https://a.example/x/%2e%2E/": ("a.example", "/", None),
    "https://bücher.example/": ("xn--bcher-kva.example", "/", None),
    "https:\\\\a.example\\b": ("a.example", "/b", None),
    " https://a.example/\n ": ("a.example", "/", None),
    "https://10.0.0.1/": None,
    "https://[::1]/": None,
    "https://a.example:99999/": None,
    "mailto:x@a.example": None,
    "javascript:void(0)": None,
    "/relative": None,
    "": None,
    None: None,
}


def test_parse(spark):
    rows = spark.createDataFrame([(u,) for u in PARSED], "url string").select("url", urls.parse_link(F.col("url")).alias("l")).collect()
    for r in rows:
        assert (tuple(r.l) if r.l.domain else None) == PARSED[r.url], r.url
        assert urls.parse(r.url) == PARSED[r.url]


JOINED = {"/a b": "/a%20b", "c": "/x/c", "../c?q": "/c", "?q": "/x/y", "#f": "/x/y", "": "/x/y", "//b.example/z": "/z", "https://b.example/q": "/q", "http:r": "/x/r", "http://b.example": "/"}


def test_join(spark):
    rows = spark.createDataFrame([(h,) for h in JOINED], "href string").select("href", urls.resolve_href(F.lit("http://a.example/x/y?k=1"), F.col("href"))["path"].alias("p")).collect()
    assert {r.href: r.p for r in rows} == JOINED


@pytest.mark.parametrize(("said", "ok"), [('```json\n{"is_relevant": true, "reason": "r"}\n```', True), ('{"is_relevant": false}', True), ("```\n{}\n```", True), ("no json", False)])
def test_model_answers(spark, said, ok):
    import json

    rows = [(json.dumps({"id": "1", "content": [{"type": "text", "text": said}]}),), (json.dumps({"id": "1", "content": []}),), ("{",), (None,)]
    got = [r.e for r in spark.createDataFrame(rows, "a string").select(parse_llm_json(F.col("a"), CLASSIFICATION)["parse_error"].alias("e")).collect()]
    assert got == [not ok, True, True, True]


def test_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(text.clean_text(F.lit("  a \n b\t"))) == "a b"
    assert one(text.identifier_to_title(F.lit("oneTwo_three"))) == "One two three"
    assert one(text.slugify(F.lit("--A b!"))) == "a-b-"
    words = " ".join(f"w{k}" for k in range(200))
    cut = one(text.search_snippet(F.lit(words), ["w150", "w151 w152"]))
    assert cut.startswith("w45 ") and cut.endswith("w94…")
    assert one(text.search_snippet(F.lit("a (b) C"), ["(b)", "c"])) == "a <b>(b)</b> <b>C</b>"
    assert one(text.search_snippet(F.lit("nothing"), ["x"])) == "nothing"
