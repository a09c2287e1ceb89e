"""Texts that are in none of the known languages."""

from fixtures import documents

from weftline.llm import language

FOREIGN = [
    "Dit is een gewone Nederlandse tekst over het weer en de mensen die in de stad wonen en elke dag naar hun werk gaan",
    "Questo è un testo italiano normale che parla del tempo e delle persone che vivono in città e vanno al lavoro ogni giorno",
    "Det här är en vanlig svensk text om vädret och människorna som bor i staden",
    "Это обычный русский текст о погоде и людях, которые живут в городе",
    "这是一个普通的中文文本关于天气和人们",
    "xqzv kjwq zzxk qwrtp zxcvb",
]


def test_other_languages_are_rejected(spark):
    """Clean texts of each language stay (seen and unseen by the model), foreign ones and keyboard junk go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 500").select("doc_id", "text", "lang", "source", "n_chars")
    own = docs.union(documents(spark, [(-1 - k, t, ("es", "de", None)[k % 3], "s0", len(t)) for k, t in enumerate(FOREIGN)], clash=False))
    kept = language.in_known_language(own).select("doc_id", "lang").collect()
    assert not [r for r in kept if r.doc_id < 0]
    share = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    for lang in language.LANGUAGES:
        assert sum(r.lang == lang for r in kept) >= 0.98 * share[lang]
    model = language.train(docs.where("doc_id % 5 != 0"))
    unseen = docs.where("doc_id % 5 = 0").collect()
    assert sum(language.in_bounds(model, [language.trigrams(r.text) for r in unseen])) >= 0.98 * len(unseen)


def test_pages_in_other_languages_are_not_accepted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    own = {r.lang: r.text for r in docs.where("length(text) between 2000 and 3000").orderBy("doc_id").collect()}
    rows = [(-k, "http://a.es/", f"<html lang=es><p>{t}</p>") for k, t in enumerate(FOREIGN, 1)] + [(k, "http://b.com/", f"<p>{own[x]}</p>") for k, x in enumerate(language.LANGUAGES)]
    got = {r.page_id: r.accepted for r in language.page_languages(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    assert got == {k: k >= 0 for k in got} and len(got) == 10
