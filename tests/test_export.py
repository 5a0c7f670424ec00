"""Volumes merged and exported, terms put right in packages, style sheets, and rewritten persons in packages."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.functions.html import text_nodes
from quire.operators import books, narrator, package, stylesheets
from quire.plans import export
from quire.sources import epub

PAGE = "<html><head><title>t</title>{}</head><body>{}</body></html>"


def packed(files):
    held = io.BytesIO()
    items = "".join(f'<item id="i{k}" href="{n}" media-type="{epub.media_type(n) if not n.endswith("html") else "application/xhtml+xml"}"/>' for k, n in enumerate(files))
    spine = "".join(f'<itemref idref="i{k}"/>' for k, n in enumerate(files) if n.endswith("html"))
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="b.opf"/></rootfiles></container>')
        z.writestr("b.opf", f"<package><metadata/><manifest>{items}</manifest><spine>{spine}</spine></package>")
        for n, data in files.items():
            z.writestr(n, data)
    return held.getvalue()


def volume(k, sheet="p{color:red;background:url(i.png)}"):
    return packed({"a.xhtml": PAGE.format('<link rel="stylesheet" href="s.css"/>', f'<h1>One {k}</h1><p>범진 went.<img src="i.png"/></p>'), "b.xhtml": PAGE.format("", '<h2>Two</h2><p>to <a href="a.xhtml">a</a></p>'), "s.css": sheet, "i.png": f"I{k}".encode(), "same.css": "q{}"})


def test_volumes_are_merged_and_written(spark):
    files = spark.createDataFrame([("1", bytearray(volume(1))), ("2", bytearray(volume(2)))], "path string, content binary")
    volumes = epub.read_chapters(files).withColumn("volume_no", F.col("book_id").cast("int"))
    resources = epub.read_resources(files).withColumn("volume_no", F.col("book_id").cast("int"))
    shared, names = export.merged_resources(resources)
    told = {(r["volume_no"], r["name"]): r["new_name"] for r in names.collect()}
    assert told[1, "same.css"] == told[2, "same.css"] == "same.css" and {told[v, "i.png"] for v in (1, 2)} == {"i.png", "i_v2.png"}
    assert {told[v, "s.css"] for v in (1, 2)} == {"s.css", "s_v2.css"}  # equal bytes, but they refer to unlike images
    sheets = {r["name"]: bytes(r["content"]).decode() for r in shared.collect() if r["name"].startswith("s")}
    assert "url('i.png')" in sheets[told[1, "s.css"]] and "url('i_v2.png')" in sheets[told[2, "s.css"]]
    texts, packages = export.exported(volumes, resources, [("범진", "范镇")], "书")
    assert texts.first()["text"].startswith("书\n\n书 第1卷\n\nOne 1\n\n范镇 went.【插图】\n\nTwo\n\nto a\n\n书 第2卷")
    p = epub.package(bytes(packages.first()["content"]))
    found = epub.chapters(p)
    assert [(c.title, c.heading_level, c.parent_index) for c in found] == [("书 第1卷", 1, None), ("One 1", 2, 1), ("Two", 2, 1), ("书 第2卷", 1, None), ("One 2", 2, 4), ("Two", 2, 4)]
    last = p.read("chap_0005.xhtml").decode()
    assert '<img src="i_v2.png"' in last and 'href="s_v2.css"' in last and 'href="chap_0005.xhtml"' in p.read("chap_0006.xhtml").decode()
    assert export.file_name(' a/b: "c" ') == "a_b_ _c" and export.file_name("...") == "book"


def test_style_sheets_are_shared_by_what_they_refer_to(spark):
    rows = [(1, "s.css", b"p{background:url(x.png)}"), (2, "s.css", b"p{background:url(x.png)}"), (3, "s.css", b"p{background:url(x.png)}"), (1, "x.png", b"1"), (2, "x.png", b"1"), (3, "x.png", b"3")]
    got = {(r["volume_no"], r["name"]): r["merged_name"] for r in books.shared_resources(spark.createDataFrame(rows, "volume_no int, name string, content binary")).collect()}
    assert got == {(1, "s.css"): "s.css", (2, "s.css"): "s.css", (3, "s.css"): "s_v3.css", (1, "x.png"): "x.png", (2, "x.png"): "x.png", (3, "x.png"): "x_v3.png"}


def test_terms_are_put_right_in_packages(spark):
    files = spark.createDataFrame([("1", bytearray(volume(1)))], "path string, content binary")
    pairs = [("went", "<left>"), ("One", "Eins"), ("", "x"), ("One", "no")]
    assert {tuple(r)[1:] for r in export.package_hits(files, pairs).collect()} == {("a.xhtml", "went", "<left>", 1), ("a.xhtml", "One", "Eins", 1)}
    row = export.fixed_packages(files, pairs).first()
    with zipfile.ZipFile(io.BytesIO(row["content"])) as z, zipfile.ZipFile(io.BytesIO(volume(1))) as old:
        assert row["changed"] == 1 and "<h1>Eins 1</h1><p>범진 &lt;left&gt;.<img" in z.read("a.xhtml").decode() and z.read("b.xhtml") == old.read("b.xhtml") and z.read("i.png") == b"I1"


@pytest.mark.parametrize(("selector", "hit"), [
    ("p", True), ("h9", False), (".k", True), ("p.k#i", True), ("div > p", True), ("div p b", True), ("div > b", False), ("h1 + div", True), ("h1 ~ p", False), ("[lang]", True), ('p[lang="ko"]', True), ("p[lang^=x]", False), ("*", True), ("p::x", None), ("a!b", None),
])
def test_selectors_are_matched(selector, hit):
    from quire.functions.html import tree

    assert stylesheets.found([tree('<h1>t</h1><div><p class="k l" id="i" lang="ko">x<b>y</b></p></div>')], selector) is hit


def test_unused_selectors_are_found(spark):
    css = "/* p{} */ p , .gone{a:b} @media print{ .used b {c:d} h4{e:f} } @font-face{src:url(f)} a:hover{} q!r{} .gone{x:y}"
    files = [("b", "s/a.css", css), ("b", "t/one.xhtml", PAGE.format('<link rel="Stylesheet" href="../s/a.css"/>', '<p>x</p><i class="used"><b>y</b></i>')), ("b", "free.css", "z{}"), ("c", "s/a.css", css)]
    df = spark.createDataFrame(files, "book string, name string, content string")
    assert {tuple(r) for r in stylesheets.unused(df, "book").collect()} == {("b", "s/a.css", ".gone", "unused"), ("b", "s/a.css", "h4", "unused"), ("b", "s/a.css", "q!r", "unknown")}
    assert stylesheets.selectors(css)[:2] == ["p", ".gone"]


def test_image_markers_are_led(spark):
    df = spark.createDataFrame([(["a⟦img:i.png⟧b⟦img:j.png⟧", "c", ""], {"i.png": "k/i.png"})], "p array<string>, m map<string,string>")
    assert df.select(package.image_markers(F.col("p"), F.col("m"))).first()[0] == ["a⟦img:k/i.png⟧b⟦img:j.png⟧", "c", ""]
    assert df.select(package.images_in(F.col("p"), F.lit("t/x.xhtml"))).first()[0] == ["a⟦img:../i.png⟧b⟦img:../j.png⟧", "c", ""]


BODY = "<h1>Kopf</h1><p>我走了 &amp; <b>我看见</b></p><p>“我来”</p><p>雨</p>"


def rewriting(spark):
    options = narrator.Options("林", "阿林")
    page = '<?xml version="1.0" encoding="utf-8"?>' + PAGE.format("", BODY)
    pages = spark.createDataFrame([("a.xhtml", bytearray(page.encode())), ("b.xhtml", bytearray(b"<p>x</p>"))], "file string, page binary")
    nodes = text_nodes(pages.select("file", F.col("page").cast("string").alias("html")), "file", "html")
    return options, pages, nodes, narrator.blocks(nodes, "file", options)


def test_persons_are_rewritten_by_prompts_replies_and_pages(spark):
    options, pages, nodes, blocks = rewriting(spark)
    numbered = narrator.batches(blocks, "file", 100)
    entries = spark.createDataFrame([(0, "k", "林", "person", "", True, [], False, []), (1, "k2", "林", "term", "", True, [], False, [])], "ord int, ko string, zh string, kind string, note string, confirmed boolean, alternatives array<string>, replace_short boolean, zh_history array<string>")
    asked = {r["file"]: r["prompt"] for r in narrator.prompts(numbered, blocks, "file", options, entries).collect()}
    assert "BLOCK a.xhtml#2\nCLASS narration\nSEGMENT 0: 我走了 & \nSEGMENT 1: 我看见\nEND\nBLOCK a.xhtml#4" in asked["a.xhtml"] and "“我来”" not in asked["a.xhtml"] and "- k -> 林 (person)" in asked["a.xhtml"] and "k2" not in asked["a.xhtml"]
    reply = '{"blocks": [{"id": "a.xhtml#4", "segments": ["雪<3"]}, {"id": "a.xhtml#2", "segments": ["林走了 & ", " 他看见 "]}]}'
    replies = spark.createDataFrame([("a.xhtml", 0, 1, reply, None), ("b.xhtml", 0, 1, "no", None)], "file string, batch int, seq int, reply string, error string")
    events = narrator.events(replies, numbered, blocks, "file", [("看见", "望见")])
    got = {(r["file"], r["block"]): (r["status"], r["segments"], r["error"]) for r in events.collect()}
    assert got == {("a.xhtml", 2): ("completed", ["林走了 & ", "他望见"], ""), ("a.xhtml", 4): ("completed", ["雪<3"], ""), ("b.xhtml", 1): ("failed", None, "no JSON: no")}
    state = narrator.state(blocks, events, "file")
    done = {r["file"]: r for r in narrator.rendered(pages, state, "file").collect()}
    assert bytes(done["a.xhtml"]["page"]).decode().endswith("<p>林走了 &amp; <b>他望见</b></p><p>“我来”</p><p>雪&lt;3</p></body></html>") and done["a.xhtml"]["done"] == [2, 4] and not done["b.xhtml"]["changed"]
    other = state.withColumn("segments", F.when(F.col("block") == 4, F.array(F.lit("风"))).otherwise(F.col("segments")))
    assert narrator.rendered(pages, other, "file").where("file = 'a.xhtml'").first()["differ"] == [4]
    view = narrator.preview(blocks, nodes, "file", options).first()
    assert (view["total"], view["eligible"], view["kept"], view["files"]) == (5, 3, 2, 2) and view["samples"][0] == "[a.xhtml] 我走了 & 我看见"


@pytest.mark.parametrize(("reply", "why"), [
    ("[]", "no list"), ('{"blocks": [1]}', "no list"), ('{"blocks": [{"id": "z", "segments": ["x"]}]}', "unknown"), ('{"blocks": [{"id": "a", "segments": ["x"]}]}', "number"), ('{"blocks": [{"id": "a", "segments": ["x", " "]}]}', "blank"),
    ('{"blocks": [{"id": "a", "segments": ["x", "<b>y</b>"]}]}', "markup"), ('{"blocks": [{"id": "a", "segments": ["x", 1]}]}', "no text"), ('{"blocks": []}', "missing blocks a"), ("?", "no JSON"),
])
def test_replies_that_are_not_whole_are_refused(reply, why):
    with pytest.raises(ValueError, match=why):
        narrator.parsed(reply, {"a": ["s ", "t"]})
    assert narrator.parsed('{"blocks": [{"id": "a", "segments": ["x", "y "]}]}', {"a": ["s ", "　t"]}) == {"a": ["x ", "　y"]}


def test_runs_go_on_only_with_the_same_source_and_options(spark):
    options, _, _, blocks = rewriting(spark)
    stored = {"mode": "first_to_third", "source_path": "/a", "source_fingerprint": "f", "options": options.record()}
    assert narrator.same_run(stored, options, "/a", "f") is None
    for change, why in (({"mode": "x"}, "kind"), ({"source_path": " "}, "source"), ({"source_fingerprint": "g"}, "content"), ({"options": None}, "options"), ({"options": options.record() | {"pronoun": "她"}}, "options")):
        assert narrator.same_run(stored | change, options, "/a", "f") == why
    old = blocks.withColumn("segments", F.when(F.col("block") == 4, F.array(F.lit("旧"))).otherwise(F.col("segments")))
    ledger = blocks.select("file", "block", F.lit(1).alias("seq"))
    assert {r["block"] for r in narrator.carried(blocks, ledger, old, "file").where("file = 'a.xhtml'").collect()} == {2}
