"""Language of pages whose text, declaration and host do not say the same."""

from pyspark.sql import functions as F
from test_web import PAGES

from weftline.llm import language


def test_each_kind_of_evidence_can_decide(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    by_lang = {lang: [r.text for r in docs.where((F.col("lang") == lang) & (F.length("text") > 300)).orderBy("doc_id").limit(12).collect()] for lang in ("de", "fr", "es", "en")}
    rows, n = [], 0

    def page(host, declared, text):
        nonlocal n
        n += 1
        rows.append((n, f"https://{host}/p{n}", f"<html{f' lang={declared}' if declared else ''}><body><p>{text}</p></body></html>"))
        return n

    for k in range(12):
        page("eins.de", "de", by_lang["de"][k % len(by_lang["de"])])
        page("un.fr", "fr", by_lang["fr"][k % len(by_lang["fr"])])
        page("one.example", "en", by_lang["en"][k % len(by_lang["en"])])
        page("dos.example", "es", by_lang["es"][k % len(by_lang["es"])])
    silent = "12 34"
    want = {
        page("eins.de", None, silent): "de",  # the host alone
        page("un.fr", None, silent): "fr",
        page("neu.de", None, silent): "de",  # the address suffix alone
        page("new.elsewhere", "es", silent): "es",  # the declaration alone
        page("eins.de", "fr", by_lang["es"][0]): "es",  # a clear text against both
        page("un.fr", "de", by_lang["en"][1]): "en",
    }
    got = {r.page_id: r for r in language.page_languages(spark.createDataFrame(rows, PAGES), docs).collect()}
    assert {k: got[k].lang for k in want} == want
    # Text and fused answer differ where the text says nothing or little, and pages without letters are never accepted.
    assert [k for k in want if got[k].accepted] == [k for k in want if got[k].lang in ("es", "en") and got[k].text_lang == got[k].lang]
    # A short word that fits two languages goes with its host.
    short = [page("eins.de", None, "in"), page("un.fr", None, "in")]
    both = {r.page_id: r for r in language.page_languages(spark.createDataFrame(rows, PAGES), docs).collect()}
    assert both[short[0]].text_lang == both[short[1]].text_lang and both[short[0]].posterior != both[short[1]].posterior
