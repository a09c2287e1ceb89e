import pyarrow as pa

from weftline.operators import html
from weftline.shared import ROWS_OUT


def kinds(page, *which):
    return [(k, t) for _, k, t, _, _ in html.parts(page) if k in which]


def test_implied_paragraph_ends():
    page = "<html><body><p><b>One<br><p>Two <i>x</i></p>three<p>Four<div>five</div></p></body>"
    assert kinds(page, "Paragraph") == [("Paragraph", "One"), ("Paragraph", "Two x"), ("Paragraph", "Four"), ("Paragraph", "")]


def test_raw_text_and_entities():
    page = '<html><title>A &amp; B</title><script>var t="</p><p>no</p>";</script><style>p{}</style><p>&copy; x</p><svg><title>S</title></svg>'
    assert kinds(page, "Title", "Paragraph") == [("Title", "A & B"), ("Paragraph", "© x"), ("Title", "S")]


def test_lists_and_items():
    page = "<html><ul><li>Foo <b>bar</b><ul><li>in</li></ul></li><li></li><ol><li>y</ol></ul><ul></ul><li>loose"
    rows = html.parts(page)
    assert [(k, parent, text) for parent, k, text, _, _ in rows] == [
        ("UnorderedPoints", None, None), ("ListItem", 0, "Foobar"), ("UnorderedPoints", None, None), ("ListItem", 2, "in"), ("ListItem", 0, ""), ("OrderedPoints", 0, None), ("ListItem", 5, "y"),
    ]


def test_skipped_anchors_hide_their_children():
    page = '<html><a href="#x"><h2>no</h2></a><a href="/y"><h2>yes</h2></a><a>none</a><a href="/z"></a><a href="/w"> </a>'
    assert kinds(page, "Heading") == [("Heading", "yes")]
    assert [(t, v) for _, k, t, _, v in html.parts(page) if k == "Anchor"] == [("yes", "/y"), (" ", "/w")]


def test_odd_pages(spark):
    rows = [(1, None), (2, ""), (3, "no tags"), (4, "<HTML><p>" + "x " * 50000), (5, "<html" + "<div>" * 3000 + "deep"), (4, "<html><p>again</p>")]
    found = html.page_parts(spark.createDataFrame(rows, "page_id long, html string"))
    assert sorted((r.page_id, len(r.text)) for r in html.extract_paragraphs(found).collect()) == [(4, 5), (4, 99999)]
    assert html.page_parts(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_parts_come_in_bounded_batches():
    pages = pa.record_batch({"page_id": list(range(900)), "html": [f"<html><p>{k}<p>b<p>c<a href='/x'>d</a>" for k in range(900)]})
    out = list(html.part_batches(iter([pages, pages.slice(0, 0)])))
    assert len(out) > 3 and max(b.num_rows for b in out) <= ROWS_OUT
    rows = [r for b in out for r in b.to_pylist()]
    assert [(r["page_id"], r["pos"], r["text"]) for r in rows if r["pos"] == 0] == [(k, 0, str(k)) for k in range(900)] and len(rows) == 3600


def test_links_to_unknown_domains_need_https(spark):
    pages = spark.createDataFrame([(1, "https://a.example/x/", '<html><a href="http://b.example/1">b</a><a href="https://c.example/">c</a><a href="http://c.example/2">c</a><a href="../y">y</a>')], "page_id long, url string, html string")
    links = html.extract_links(pages, html.extract_anchors(html.page_parts(pages)))
    assert sorted((r.domain, r.path) for r in links.collect()) == [("a.example", "/y"), ("c.example", "/"), ("c.example", "/2")]


def test_image_modes(spark):
    page = '<html><head><meta property="og:image" content="/a.png"><meta property="og:image:width" content="12"></head>'
    pages = spark.createDataFrame([(1, "https://a.example/p", page)], "page_id long, url string, html string")
    found = html.page_parts(pages)
    assert html.web_metadata(pages, found).first().image == "https://a.example/a.png"
    assert html.web_metadata(pages, found, mode="reference").first().image == "https://a.example/12"


def test_an_icon_image_is_the_favicon(spark):
    page = '<html><head><meta property="og:image" content="/img/apple-touch-icon.png"><meta property="og:image" content="/img/big.png"></head><body></body></html>'
    pages = spark.createDataFrame([(1, "https://a.org/x", page)], "page_id long, url string, html string")
    row = html.web_metadata(pages, html.page_parts(pages)).first()
    assert (row.favicon, row.image) == ("https://a.org/img/apple-touch-icon.png", "https://a.org/img/big.png")
