"""Rows out of HTML pages and milestone XML."""

import html

import pytest
from pyspark.sql import functions as F

from glossa.sources.milestones import parse_milestones, unknown_books
from glossa.sources.pages import parse_options, parse_pages, require_options, unescape


def pages(spark, *bodies):
    rows = [(i, f'<html><div class="col_i_1_1_inf">{b}</div></html>') for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "page_id int, html string")


def verses(spark, body):
    got = parse_pages(pages(spark, body)).orderBy("pos").collect()
    return [(r["verse"], r["subtitle"], r["text"]) for r in got]


def n(x):
    return f'<span class="versiculo">{x}</span>'


def t(x):
    return f'<span class="texto">{x}</span>'


@pytest.mark.parametrize("body,expected", [
    (n(1) + t("In the beginning") + "<br/>" + n(2) + t("And the earth") + "<br>", [(1, "", "In the beginning"), (2, "", "And the earth")]),
    (n("A") + t("No") + "<br>", []),
    # a second number discards the open verse
    (n(1) + t("lost") + n(2) + t("kept") + "<br>", [(2, "", "kept")]),
    # text outside an open verse is ignored, empty verses are dropped
    (t("outside") + n(1) + t(" ") + "<br>" + t("after") + n(2) + t("two"), [(2, "", "two")]),
    # a mark without an integer does not close the open verse
    (n(1) + t("a") + n("x") + t("b") + "<br>" + t("c"), [(1, "", "a\nb")]),
    # subtitles: the last heading before the number, none before the first
    (n(1) + t("a") + "<br>" + '<h2 class="x estudio">One</h2><h2 class="other">no</h2>' + n(2) + t("b") + "<br>"
     + '<h2 class="estudio">Two</h2><h2 class="estudio"> Three </h2>' + n(3) + t("c") + "<br>" + n(4) + t("d"),
     [(1, "", "a"), (2, "One", "b"), (3, "Three", "c"), (4, "Three", "d")]),
    # a heading inside an open verse does not close it
    (n(1) + t("a") + '<h2 class="estudio">H</h2>' + t("b") + "<br>", [(1, "", "a\nb")]),
    # a break inside a text mark closes after that mark
    (n(1) + t("a<br>b") + t("c"), [(1, "", "ab")]),
    (n(" 7 ") + t(" <i>x</i> &amp; &eacute;&#233;&#xE9; y ") + "<BR />", [(7, "", "x & ééé y")]),
    ("nothing", []),
    # spans nested in a mark belong to it
    (n(1) + t("a <span>b <span class='x'>c</span></span> d") + "<br>" + n("<span>2</span>") + t("e"), [(1, "", "a b c d"), (2, "", "e")]),
    # comments do not count, attributes may lack quotes
    ("<!-- " + n(5) + t("no") + "<br> -->" + "<span class=versiculo>1</span><SPAN id=q class=texto>a</SPAN><br>", [(1, "", "a")]),
    # inner elements of the same name do not end the content
    ("<div>" + n(1) + t("a") + "<div></div><br></div>" + n(2) + t("b"), [(1, "", "a"), (2, "", "b")]),
    # a very long number mark, good and bad
    (n(" " * 1_000_000 + "3") + t("a") + "<br>" + n(" " * 1_000_000 + "x") + t("b"), [(3, "", "a")]),
])
def test_page_rules(spark, body, expected):
    assert verses(spark, body) == expected


def test_content_ends_at_its_own_tag(spark):
    page = ("<div class=top><span class=versiculo>8</span></div><DIV class='a col_i_1_1_inf b'>" + n(1) + t("a") + "<br></DIV>"
            + "<div>" + n(2) + t("footer") + "<br></div>")
    df = spark.createDataFrame([(1, page)], "page_id int, html string")
    assert [(r["verse"], r["text"]) for r in parse_pages(df).collect()] == [(1, "a")]


def test_page_without_content(spark):
    df = spark.createDataFrame([(1, "<div class='other'>" + n(1) + t("x") + "<br></div>")], "page_id int, html string")
    assert parse_pages(df).count() == 0


@pytest.mark.parametrize("value", ["a &lt;b&gt; &amp;amp; &copy;&nbsp;x", "&unknownname; & plain; &#0;", "&#x1F600;!&#8212;", "no", "&;&&amp;"])
def test_unescape(spark, value):
    if "#0" in value:
        value = value.replace("&#0;", "")
    got = spark.createDataFrame([(value,)], "t string").select(unescape(F.col("t"))).first()[0]
    assert got == html.unescape(value)


def test_options(spark):
    page = ('<select name="other"><option value="X">no</option></select><select id="a" name="libro">'
            '<option value="0">Libro</option><option value="GEN">Génesis</option>\n<option selected value="EXO"> Éxodo </option></select>')
    df = spark.createDataFrame([(1, page)], "page_id int, html string")
    got = {r["index"]: (r["id"], r["name"]) for r in parse_options(df).collect()}
    assert got == {1: ("GEN", "Génesis"), 2: ("EXO", "Éxodo")}
    with pytest.raises(ValueError):
        require_options(parse_options(df.withColumn("html", F.lit("<p>none</p>"))))


def test_milestones(spark):
    xml = ('<osis><p><verse osisID="Gen.1.1" sID="a"/>In the <w>begin\nning</w>  God<note>n</note><verse eID="a"/> between '
           '<verse osisID="FakeBook.1.1"/>no<verse eID="b"/><verse osisID="Gen.1"/>short<verse eID="c"/>'
           '<verse sID="q" osisID="1John.2.3"/>Light &amp; life<verse eID="q"/>'
           '<!-- <verse osisID="Gen.1.7"/>hidden<verse eID="h"/> <![CDATA[ --><verse osisID="Gen.1.8"/>In <![CDATA[the & <x> <!-- y]]> b'
           '<verse eID="h"/><verse osisID="Gen.1.9"/>open <verse osisID="Gen.1.10"/>ten<verse eID="z"/></p></osis>')
    docs = spark.createDataFrame([("f.xml", xml)], "file string, xml string")
    got = [(r["book"], r["chapter"], r["verse"], r["text"]) for r in parse_milestones(docs).orderBy("pos").collect()]
    assert got == [("genesis", "1", "1", "In the begin ning God n"), ("1_john", "2", "3", "Light & life"),
                   ("genesis", "1", "8", "In the & <x> <!-- y b"),
                   ("genesis", "1", "10", "ten")]
    assert [r["code"] for r in unknown_books(docs).collect()] == ["FakeBook"]
