"""Sources, sinks, markup and the completion plan on small files."""

import zipfile

from pyspark.sql import functions as F

from quire.functions import html
from quire.operators.segment import chapters
from quire.plans import complete
from quire.sources import files
from quire.streaming import ledger


def test_texts_in_several_encodings(spark, tmp_path):
    text = "제1장 시작\n본문\n"
    for name, data in {"a": text.encode(), "b": text.encode("utf-8-sig"), "c": text.encode("cp949"), "d": text.encode("utf-16")}.items():
        (tmp_path / f"{name}.txt").write_bytes(data)
    rows = files.load(spark, str(tmp_path), "txt")
    assert {(r["title"], r["text"]) for r in rows.collect()} == {(n, text) for n in "abcd"}
    assert {tuple(r["paragraphs"]) for r in chapters(rows).collect()} == {("본문",)}


def test_epub_round_trip_and_missing_items(spark, tmp_path):
    data = files.epub_bytes("T", [("One & two", ["a < b", "c", "c"]), ("Three", [])])
    path = tmp_path / "x.epub"
    path.write_bytes(data)
    with zipfile.ZipFile(path, "a") as z:
        z.writestr("OEBPS/extra.css", "p{}")
    rows = files.load(spark, str(tmp_path), "epub").orderBy("chapter_index").collect()
    assert [(r["chapter_index"], r["title"], r["heading_level"], r["paragraphs"]) for r in rows] == [(0, "One & two", 1, ["a < b", "c"]), (1, "Three", 1, [])]
    assert {r["name"] for r in files.entries(spark, str(tmp_path)).collect()} >= {"OEBPS/extra.css", "mimetype"}
    broken = tmp_path / "y"
    broken.mkdir()
    with zipfile.ZipFile(path) as z, zipfile.ZipFile(broken / "y.epub", "w") as w:
        for n in z.namelist():
            if n != "OEBPS/chap_0001.xhtml":
                w.writestr(n, z.read(n))
    assert [r["title"] for r in files.epubs(spark, str(broken)).collect()] == ["One & two"]


def test_sinks(spark):
    df = spark.createDataFrame([("b", 1, "Two", ["y"]), ("b", 0, "One", ["w", "x"])], "book_id string, chapter_index int, title string, paragraphs array<string>")
    assert files.written_texts(df).first()["text"] == "One\n\nw\n\nx\n\nTwo\n\ny"
    assert [c[2] for c in files.epub_chapters(bytes(files.written_epubs(df).first()["content"]))] == ["One", "Two"]


def test_text_nodes_and_classes(spark):
    page = "<html><head><title>t</title><style>x</style></head><body><h1>H</h1><p>one<p>“two”<div class='diary'>three</div><p>（four）</p><!-- c --><script>s</script></body></html>"
    rows = html.text_nodes(spark.createDataFrame([(1, page), (2, None)], "id int, h string"), "id", "h").collect()
    assert [(r["class"], r["text"]) for r in rows] == [("narration", "t"), ("heading", "H"), ("narration", "one"), ("dialogue", "“two”"), ("letter", "three"), ("monologue", "（four）")]


def test_splicing_touches_text_alone():
    page = '<p class="ab">ab<!-- ab --><b>xab</b></p><script>ab</script><title>ab</title>'
    assert html.spliced(page, lambda t: t.replace("ab", "Q")) == ('<p class="ab">Q<!-- ab --><b>xQ</b></p><script>ab</script><title>ab</title>', 2)


def test_completion_records_failures_and_resumes(spark, tmp_path):
    # classes of the function itself travel to the workers by value
    class Echo:
        def complete(self, prompt):
            if "bad" in prompt:
                raise RuntimeError("no")
            return "\n".join(line.split("] ", 1)[1].upper() for line in prompt.splitlines()[1:])

    class Fixed:
        def complete(self, prompt):
            return "only one"

    chunks = spark.createDataFrame([("c1", ["a", "b"]), ("c2", ["bad", "x"])], "chunk_id string, paragraphs array<string>")
    first = complete.completed(complete.prompts(chunks, "do"), Echo, retries=2, delay=0).collect()
    done = spark.createDataFrame(first, complete.LEDGER)
    assert {(r["chunk_id"], r["error"], r["attempts"]) for r in first} == {("c1", None, 1), ("c2", "RuntimeError: no", 2)}
    second = complete.resumed(chunks, done, "do", Fixed, seq=1, delay=0).collect()
    assert [r["chunk_id"] for r in second] == ["c2"]
    both = spark.createDataFrame(first + second, complete.LEDGER)
    assert {r["chunk_id"]: r["final"] for r in complete.results(chunks, both).collect()} == {"c1": ["A", "B"], "c2": ["only one", ""]}
    assert {r["chunk_id"]: r["final"] for r in complete.results(chunks, done).collect()}["c2"] == ["bad", "x"]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    both.write.parquet(source)
    for _ in range(2):  # a second run finds nothing new
        ledger.finished(spark, source, out, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(out).select(F.count("*"), F.countDistinct("chunk_id")).first()[:] == (2, 2)


def test_splicing_reads_and_writes_entities():
    page = "<p>a &amp; b &lt;c&gt; é</p><p>x < y</p>"
    assert html.spliced(page, lambda t: t.replace("a & b", "p & <q>")) == ("<p>p &amp; &lt;q&gt; &lt;c&gt; é</p><p>x < y</p>", 1)
    assert html.spliced(page, lambda t: t.replace("x < y", "z")) == ("<p>a &amp; b &lt;c&gt; é</p><p>z</p>", 1)


def test_blocks_are_replaced_whole_or_not_at_all():
    page = '<body><h1>H</h1>\n<p>one <b>two</b></p><p>three</p><div id="k">four</div></body>'
    blocks = {2: (["one ", "two"], ["1 ", "<2>"]), 3: (["other"], ["3"]), 4: (["four"], ["a", "b"]), 9: (["x"], ["y"])}
    assert html.spliced_blocks(page, blocks) == (page.replace("one ", "1 ").replace("two", "&lt;2&gt;"), {2}, {3, 4, 9})
