import io
import zipfile

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from oppflow.functions import arrays, html, text
from oppflow.sources import documents


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")).alias("x")).first().x


def test_white_space(spark):
    assert one(spark, "  a \t\nb\u2003c\x1d ", text.collapse) == "a b c"
    assert one(spark, " \u3000 ", text.optional_text) is None
    assert one(spark, None, text.collapse) is None


def test_lines(spark):
    assert one(spark, "a\r\n\n a \x0bb\u2028b  b\x0cc", text.clean_lines) == "a\nb\nb b\nc"
    assert one(spark, "", text.clean_lines) == ""


def test_ordered_distinct(spark):
    assert one(spark, ["Stra\u00dfe", " b ", None, "STRASSE", "B", "", "c"], text.ordered_distinct, "array<string>") == ["Stra\u00dfe", "b", "c"]
    assert one(spark, [], text.ordered_distinct, "array<string>") == []


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(max_size=5), max_size=6))
def test_ordered_distinct_against_python(spark, items):
    spaces = lambda s: "".join(" " if c.isspace() else c for c in s)
    want, seen = [], set()
    for i in items:
        s = " ".join(spaces(i).split())
        if s and s.lower().replace("\u00df", "ss") not in seen:
            seen.add(s.lower().replace("\u00df", "ss"))
            want.append(s)
    got = one(spark, items, text.ordered_distinct, "array<string>")
    if all(c.isascii() for i in items for c in i):
        assert got == want


def test_keys_and_references(spark):
    assert one(spark, "  ", lambda c: text.key_of(c, F.lit("b"))) is None
    assert one(spark, " a ", lambda c: text.key_of(c, F.lit("b"))) == one(spark, "a|b", text.content_hash)
    page = r'href="\/jobs\/12" href="/jobs/7" jobs/12'
    assert one(spark, page, lambda c: text.find_references(c, r"jobs/(\d+)")) == ["12", "7"]


def test_phone_and_window(spark):
    df = spark.createDataFrame([("06-1234 5678", "bel 06 12345678 nu"), ("12", "12"), (None, "x")], "p string, t string")
    assert [r.x for r in df.select(text.phone_supported(F.col("p"), F.col("t")).alias("x")).collect()] == [True, False, False]
    assert one(spark, "x" * 400 + "JAN" + "y" * 50, lambda c: text.window_around(c, [F.lit("jan"), F.lit("zz")], 3, 5, 10)) == "xxxJANyy"
    assert one(spark, "abcdef", lambda c: text.window_around(c, [F.lit("q")], 3, 5, 4)) == "abcd"


def test_json_and_unicode(spark):
    assert one(spark, '{"b": 1, "a": {"d": "\u00e9", "c": 2}}', text.canonical_json) == '{"a":{"c":2,"d":"\u00e9"},"b":1}'
    assert one(spark, "{bad \n json", text.canonical_json) == "{bad json"
    assert one(spark, "\ufb01 Stra\u00dfe", text.folded_nfkc) == "fi strasse"
    assert one(spark, "a\r\n\r\n\r\n\r\nb\u00a0 c ", text.document_text) == "a\n\nb c"
    assert one(spark, '{"a": "1"}', lambda c: text.merged_json(c, F.lit('{"a": "2", "b": "3"}'))) == '{"a":"2","b":"3"}'


def test_escapes(spark):
    assert one(spark, "a b+\u00e9.pdf", text.percent_encoded) == "a%20b%2B%C3%A9.pdf"
    assert one(spark, "<a href=\"x\">'&", text.html_escaped) == "&lt;a href=&quot;x&quot;&gt;&#039;&amp;"
    assert one(spark, "a\n\n b \n", text.paragraphs) == ["a", "b"]
    assert one(spark, "a\tb\nc\rd", text.without_controls) == "ab\ncd"


PAGE = """<html><head><title>Baan X - Site - Portaal</title><style>p{}</style></head><body><nav>Menu</nav><h1></h1>
<!-- x --><p hidden>weg</p><p aria-hidden="TRUE">deels</p><p style="Display : none">weg</p><input type="hidden" value="v">
<form><p>Adviseur &amp;amp; meer</p></form><button>Klik</button><p>Adviseur &amp;amp; meer<p>Slot</body></html>"""


def test_page(spark):
    row = spark.createDataFrame([(PAGE,), (None,)], "c string").select(html.parsed_page(F.col("c")).alias("p")).collect()
    p = row[0].p
    assert p.visible == "Baan X - Site - Portaal Menu deels Adviseur & meer Klik Adviseur & meer Slot"
    assert "weg" not in p.prepared and "Klik" not in p.prepared and p.prepared.count("Adviseur") == 1
    assert p.title == "Baan X - Site" and not p.truncated
    assert row[1].p.visible is None


def test_page_choices(spark):
    long = "<main>" + "woord " * 100 + "</main>"
    assert html.prepared_text(html.tree(f"<body><p>kop</p>{long}</body>")).startswith("woord")
    assert html.prepared_text(html.tree("<body><p>kop</p><main>kort</main></body>")).startswith("kop")
    assert html.title_of(html.tree('<meta property="og:title" content="A - B - C"><title>T</title>')) == "A - B"
    assert html.title_of(html.tree("<h2>Zoeken</h2><h3>Echt</h3>"), frozenset({"zoeken"})) == "Echt"
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert html.visible_text(html.tree(deep)) == "x"
    with pytest.raises(ValueError):
        html.parsed_page(F.lit("x"), 10)


def docx(body: str) -> bytes:
    out = io.BytesIO()
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {w}><w:p><w:r><w:t>Kop</w:t></w:r></w:p></w:hdr>")
    return out.getvalue()


def test_documents(spark):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "<w:tbl><w:tr>" + "".join(f"<w:tc>{p(t)}</w:tc>" for t in ("A", "b", "a")) + "</w:tr></w:tbl>"
    rows = [(docx(p("een") + table + p("twee")), documents.DOCX), (b"x", documents.DOCX), (b"%PDF-1.4", documents.PDF), (b"", documents.PDF), (b"x", "text/plain"), (None, None)]
    got = spark.createDataFrame(rows, "c binary, m string").select(documents.file_text(F.col("c"), F.col("m")).alias("r")).collect()
    assert got[0].r.text == "Kop\neen\nA | b\ntwee"
    assert [g.r.error for g in got] == [None, "broken", "no_reader", "empty", "unknown_type", "empty"]
    assert one(spark, "C:\\map\\cv\x01 2025.pdf", documents.safe_file_name) == "cv 2025.pdf"


def test_ranking(spark):
    order = ["a", "b", "c", "d"]
    df = spark.createDataFrame([([("a", 59), ("b", 85), ("c", 85), ("d", 60)],), ([("a", 1), ("b", None), ("c", 2), ("d", 0)],)], "s array<struct<label:string,score:int>>")
    got = df.select(arrays.matches(F.col("s"), order, 60, 3).alias("m"), arrays.tied_at_top(F.col("s")).alias("t")).collect()
    assert [(g.m, g.t) for g in got] == [(["b", "c", "d"], 2), ([], 1)]


def test_partial_dates(spark):
    rows = [(2020, 5, 2020, 4), (2020, 5, 2020, None), (2021, 1, 2020, 12), (None, None, 2020, 1)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    assert [r.x for r in df.select(arrays.range_valid(*map(F.col, "abcd")).alias("x")).collect()] == [False, True, False, True]


def test_file_issues(spark):
    def zipped(*parts):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for p in parts:
                z.writestr(p, "x")
        return out.getvalue()

    good = zipped("[Content_Types].xml", "word/document.xml")
    rows = [
        ("a.pdf", b"%PDF-1.7", documents.PDF), ("a.docx", good, documents.DOCX), (" \u200b", b"%PDF-", documents.PDF), (None, b"x", "x"), ("a", b"", documents.PDF), ("a", None, None),
        ("a", b"x", documents.PDF), ("a", zipped("word/document.xml"), documents.DOCX), ("a", b"x", documents.DOCX), ("a", b"x", "text/plain"), ("a", b"x" * (documents.MOST_BYTES + 1), documents.PDF),
    ]
    df = spark.createDataFrame(rows, "n string, c binary, m string")
    got = [r.i for r in df.select(documents.file_issue(F.col("n"), F.col("c"), F.col("m")).alias("i")).collect()]
    assert got == [None, None, "no_name", "no_name", "empty", "empty", "not_pdf", "not_docx", "not_docx", "unknown_type", "too_large"]
