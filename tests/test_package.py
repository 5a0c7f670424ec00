"""References, markers and moved results of packages."""

import posixpath

import pytest
from pyspark.sql import functions as F

from quire.functions.paths import relative, resolved
from quire.operators import package


@pytest.mark.parametrize(
    ("base", "href", "want"),
    [
        ("OPS/Text/a.xhtml", "../Images/x%20y.png?v=1#f", "OPS/Images/x y.png"), ("a.css", "./b/./c.ttf", "b/c.ttf"), ("OPS/a.css", "/top/d.png", "top/d.png"),
        ("OPS/a.css", "../../up.png", "../up.png"), ("a.css", "https://x/y.png", None), ("a.css", "data:abc", None), ("a.css", "#only", None), ("a.css", "", None), ("a.css", None, None), ("S\\a.css", "..\\b+c.png", "b+c.png"),
    ],
)
def test_resolved(spark, base, href, want):
    df = spark.createDataFrame([(base, href)], "b string, h string")
    assert df.select(resolved(F.col("b"), F.col("h"))).first()[0] == want


def test_relative_is_the_inverse(spark):
    cases = [("EPUB/a.xhtml", "EPUB/b.xhtml"), ("EPUB/t/a.xhtml", "EPUB/i/x.png"), ("a.xhtml", "i/x.png"), ("e/a.xhtml", "x.png"), ("a/b/c.css", "a/b/f/g.ttf")]
    got = spark.createDataFrame(cases, "d string, r string").select("d", "r", relative(F.col("d"), F.col("r")).alias("x"), resolved(F.col("d"), relative(F.col("d"), F.col("r"))).alias("back"))
    for r in got.collect():
        assert (r["x"], r["back"]) == (posixpath.relpath(r["r"], posixpath.dirname(r["d"]) or "."), r["r"])


def test_style_sheets_follow_renamed_resources(spark):
    css = "@import \"base.css\"; a{background:URL( '../i/x.png' )} b{src:url(f.ttf)} c{x:url(data:1)}"
    files = spark.createDataFrame([(1, "s/m.css", css), (2, "s/m.css", css), (1, "s/none.css", None)], "v int, name string, content string")
    names = spark.createDataFrame([(1, "i/x.png", "Images/x_v1.png"), (1, "s/base.css", "Styles/base.css"), (1, "s/m.css", "Styles/m_v1.css")], "v int, name string, new_name string")
    got = {(r["v"], r["name"]): r for r in package.rewritten(files, names, "v").collect()}
    assert got[1, "s/m.css"]["content"] == "@import \"base.css\"; a{background:url('../Images/x_v1.png')} b{src:url(f.ttf)} c{x:url(data:1)}"
    assert (got[1, "s/m.css"]["new_name"], got[1, "s/m.css"]["changed"]) == ("Styles/m_v1.css", 2)
    assert (got[2, "s/m.css"]["content"], got[2, "s/m.css"]["changed"], got[1, "s/none.css"]["content"]) == (css, 0, None)
    assert package.rewritten(files.limit(0), names, "v").count() == 0


def test_notes_keep_their_links_both_ways(spark):
    pages = [("Text/Chap.html", '<a id="c1" href="../Text/Notes.html#n1">1</a> <a href="https://x/">x</a>'), ("Text/Notes.html", "<a id='n1' href='Chap.html#c1'>1</a>")]
    files = spark.createDataFrame([(1, *p) for p in pages], "v int, name string, content string")
    names = spark.createDataFrame([(1, "Text/Chap.html", "EPUB/chap_0001.xhtml"), (1, "Text/Notes.html", "EPUB/chap_0002.xhtml")], "v int, name string, new_name string")
    got = {r["new_name"]: r["content"] for r in package.rewritten(files, names, "v", package.LINKS).collect()}
    assert got["EPUB/chap_0001.xhtml"] == '<a id="c1" href="chap_0002.xhtml#n1">1</a> <a href="https://x/">x</a>'
    assert got["EPUB/chap_0002.xhtml"] == "<a id='n1' href='chap_0001.xhtml#c1'>1</a>"


def test_missing_resources(spark):
    page = '<link rel="stylesheet" href="../s/a.css"/><link rel="next" href="no.html"/><img src="gone.png"/><image href="../i/x.png"/>'
    rows = [(1, "t/p.xhtml", page), (1, "s/a.css", "@import 'lost.css'; a{b:url(../i/x.png)}"), (1, "i/x.png", None)]
    got = package.missing_resources(spark.createDataFrame(rows, "v int, name string, content string"), "v").collect()
    assert {(r["name"], r["target"]) for r in got} == {("t/p.xhtml", "t/gone.png"), ("s/a.css", "s/lost.css")}


def test_markers_become_balanced_html(spark):
    import base64
    import json

    x = base64.urlsafe_b64encode(json.dumps({"tag": "sup", "attrs": {"class": ["a", "b"], "onclick": "bad", "id": '"'}}).encode()).decode().rstrip("=")
    cases = {
        "a<b ⟦b⟧x⟦i⟧y⟦/i⟧": "a&lt;b <b>x<i>y</i></b>", "⟦/b⟧z⟦br⟧": "z<br/>", "⟦s:color:red⟧r⟦/s⟧": '<span style="color:red">r</span>',
        f"⟦x:{x}⟧1⟦/x⟧": '<sup class="a b" id="&quot;">1</sup>', "⟦x:!!⟧1⟦/x⟧": "1", "⟦img:p/q.png⟧⟦fn:n1⟧": '<img src="p/q.png" alt="插图"/><a href="#n1"><sup>注</sup></a>', "⟦odd⟧k": "k",
    }
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "t string").select("t", package.markers_to_html(F.col("t")).alias("h"))
    assert {r["t"]: r["h"] for r in df.collect()} == {**cases, None: None}


def test_results_move_to_new_paragraphs(spark):
    kind = "b int, paragraphs array<string>, translated array<string>"
    old = spark.createDataFrame([(1, ["a", "", "b  c"], ["A", None, "BC"]), (2, ["a", "b"], ["A", "B"]), (3, ["a"], [None]), (5, ["a", " ", "b"], ["A", None, "B"])], kind)
    new = spark.createDataFrame([(1, ["a", "⟦img:x⟧", "b c"]), (2, ["b"]), (3, ["a"]), (4, ["n"]), (5, ["a", "b"])], "b int, paragraphs array<string>")
    got = {r["b"]: (r["translated"], r["safe"]) for r in package.migrated(old, new, "b").collect()}
    assert got == {1: (["A", "⟦img:x⟧", "BC"], True), 2: (None, False), 3: ([None], True), 4: (None, False), 5: (None, False)}
