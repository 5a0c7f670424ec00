"""Corrections of finished books, Unicode patterns, and the operators of books that have no query."""

import pytest
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.operators import archive, books, corrections, glossary, sample, segment

CHAPTER = "book string, chapter_index long, title string, heading_level int, parent_index long, paragraphs array<string>"


def chapters(spark, rows):
    return spark.createDataFrame([("b", *r) for r in rows], CHAPTER)


def said(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("chapter_index").collect()]


def test_patterns_take_blanks_and_digits_of_all_scripts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(t.Cleaning()(F.lit("　[1] 天亮了"))) == "天亮了" and one(t.Cleaning()(F.lit("（1） 天"))) == "（1） 天"
    assert one(t.Cleaning()(F.lit("　1２.　雨"))) == "雨"
    assert tuple(one(t.numbered_title(F.lit("第３章　桥"))))[:3] == ("３", "第３章　", "桥")
    assert tuple(one(t.numbered_title(F.lit("桥　（٢）"))))[2:] == ("桥", "　（٢）", "٢")
    assert [one(t.is_word_count_line(F.lit(x))) for x in ("本章字数：　12", "(本章字数: １２)", "字数 3")] == [True, True, False]
    assert one(t.is_skip_line(F.lit(" Copyright　. "))) and not one(t.looks_like_body_title(F.lit("　３　")))
    assert [one(t.number_of(F.lit(x))) for x in ("３", "٤2", "x")] == [3, 42, None]
    records = books.title_records(spark.createDataFrame([("EP.　７　夜",), ("无",), (None,)], "title string"))
    assert [(r["number"], r["prefix"], r["content"]) for r in records.collect()] == [(7, "EP.　", "　夜"), (None, "无", ""), (None, "", "")]
    stream = spark.createDataFrame([("b", 0, "序"), ("b", 1, "第　１章"), ("b", 2, "文")], "book_id string, ord int, text string")
    assert [(r["title"], r["n_paragraphs"]) for r in segment.resplit(stream, "^第\\s*\\d+章$").orderBy("chapter_index").collect()] == [("正文", 1), ("第　１章", 1)]


def test_user_headings_match_from_the_start(spark):
    patterns = segment.heading_patterns(["teil \\d+", "", "(", " ende"])
    assert len(patterns) == 2 and segment.heading_patterns(["[", " "]) == segment.HEADINGS
    rows = spark.createDataFrame([("b", "vor\nTEIL 1\na\nim teil 2 nicht\nEnde\nz")], "book_id string, text string")
    assert [(r["title"], r["paragraphs"]) for r in segment.chapters(rows, patterns).collect()] == [("正文", ["vor"]), ("TEIL 1", ["a", "im teil 2 nicht"]), ("Ende", ["z"])]


ROWS = [
    (1, "卷", 1, None, []), (2, "EP.1", 2, 1, ["（本章字数: 9）", "雨夜", "他走了。", "她留下。"]), (3, "制作说明", 2, 1, ["x"]),
    (4, "EP.2", 2, 1, ["EP.10", "一", "EP.11", "EP.12", "二", "三"]), (5, "尾", 2, 4, ["【书籍统计】", "终"]),
]


def test_formats_are_told_and_cleared(spark):
    df = chapters(spark, ROWS)
    told = corrections.format_details(df, "book").first()
    assert (told["chapters"], [x["title"] for x in told["notes"]], [(x["chapter_index"], x["lines"]) for x in told["counted"]]) == (5, ["制作说明", "尾"], [(2, 1)])
    assert tuple(corrections.clear_preview(df, "book").first()) == ("b", 5, 3, ["制作说明", "尾"], 1)
    assert tuple(corrections.clear_preview(df, "book", notes=False).first())[2:] == (5, [], 1)
    assert [(i, len(p)) for i, p in said(corrections.cleared(df), "chapter_index", "paragraphs")] == [(1, 0), (2, 3), (4, 6)]


def test_templates_are_stored_and_rendered(spark):
    plain = corrections.Template()
    assert corrections.Template.read(plain.write()) == plain == corrections.Template.read("{") == corrections.Template.read("[]")
    mine = corrections.Template.read('{"production_title": "说明", "production_lines": ["共 {chapter_count}/${total_chars}/{minutes}/{x}"], "word_count_template": "<{chars}>", "title_enabled": true, "title_style": {"bold": true, "color": "red", "italic": false, "margin": ""}}')
    assert mine.title_css == ".chapter-title { color:red; font-size:1.4em; font-weight:bold; margin-bottom:0.6em; letter-spacing:0.05em; line-height:1.4; }"
    assert corrections.css_rule({}, "x") == "" and corrections.css_rule({"align": "center"}, "!") == ".chapter-title { text-align:center; }" and corrections.paragraph_style(None) is None
    long = chapters(spark, [(1, "卷", 1, None, []), (2, "一", 2, 1, ["字" * 1234, "本章字数:3"]), (3, "说明", 2, 1, ["旧"])])
    view = corrections.add_preview(long, "book", mine, "now").first()
    assert (view["total_chars"], view["chapters"], view["minutes"], view["notes"], view["lines"], view["has_format"]) == (1240, 2, 3, 1, 1, True)
    made = said(corrections.with_format(long, "book", mine, "now"), "chapter_index", "parent_index", "title", "heading_level", "paragraphs")
    assert made == [(1, None, "卷", 1, []), (2, 1, "说明", 2, ["<12>", "共 2/1,234/3/"]), (3, 1, "一", 2, ["<1234>", "字" * 1234])]
    first = said(corrections.with_format(chapters(spark, [(5, "一", 2, None, ["a"])]), "book", plain, "now", "f.ttf"), "chapter_index", "parent_index", "title", "paragraphs")
    assert first[0][:3] == (1, None, "制作说明") and "生成时间：now" in first[0][3] and "• 封面字体：f.ttf（自用字体）" in first[0][3] and first[1] == (2, None, "一", ["(本章字数: 1)", "a"])


def test_chapters_are_split_on(spark):
    df = chapters(spark, ROWS)
    chosen = spark.createDataFrame([("b", 2), ("b", 4)], "book string, chapter_index long")
    view = said(corrections.split_preview(df, chosen, "book", "^EP\\.\\d+$"), "chapter_index", "status", "parts")
    assert view == [(2, "no_match", []), (4, "split", [("EP.10", 1), ("EP.11", 0), ("EP.12", 2)])]
    made = said(corrections.split_on(df, chosen, "book", "^EP\\.\\d+$"), "chapter_index", "parent_index", "title", "paragraphs")
    assert made == [(1, None, "卷", []), (2, 1, "EP.1", ROWS[1][4]), (3, 1, "制作说明", ["x"]), (4, 1, "EP.10", ["一"]), (5, 1, "EP.11", []), (6, 1, "EP.12", ["二", "三"]), (7, 6, "尾", ["【书籍统计】", "终"])]
    lead = said(corrections.split_on(df, chosen, "book", "^她"), "chapter_index", "title", "paragraphs")
    assert lead[1:3] == [(2, "EP.1", ["雨夜", "他走了。"]), (3, "她留下。", [])]


def test_placeholder_titles_are_replaced(spark):
    df = chapters(spark, ROWS)
    view = said(corrections.retitle_preview(df, "book", pattern=""), "chapter_index", "old", "new", "lines")
    assert view == [(2, "EP.1", "雨夜", 1), (4, "EP.2", "EP.10", 0)]
    made = said(corrections.retitled(df, "book", pattern=""), "chapter_index", "title", "paragraphs")
    assert made[1] == (2, "雨夜", ["他走了。", "她留下。"]) and made[2] == (3, "制作说明", ["x"])
    kept = said(corrections.retitled(df, "book", pattern="^他.", keep_prefix=True, counts=False, remove=False), "chapter_index", "title", "paragraphs")
    assert kept[1] == (2, "EP.1 他走", ROWS[1][4])


def test_texts_are_cut_anew(spark):
    made = said(corrections.recut(chapters(spark, ROWS), "book", "^EP\\.(\\d+)$", 1), "chapter_index", "title", "paragraphs")
    assert made == [(1, "正文", ["雨夜", "他走了。", "她留下。"]), (2, "10", ["一"]), (3, "11", []), (4, "12", ["二", "三"])]
    assert corrections.usable_pattern(" a+ ") == "a+" and corrections.usable_pattern("(") == ""


def test_chapters_are_renumbered_and_measured(spark):
    df = spark.createDataFrame([("b", 3, None, "x", ["ab", "c"]), ("b", 5, 3, "y", []), ("b", 9, 4, "z", ["d"])], "book_id string, chapter_index int, parent_index int, title string, paragraphs array<string>")
    assert said(segment.renumbered(df), "chapter_index", "parent_index", "title") == [(1, None, "x"), (2, 1, "y"), (3, None, "z")]
    assert said(segment.without_empty(df), "chapter_index", "parent_index", "title") == [(0, None, "x"), (1, None, "z")]
    assert [r[0] for r in df.orderBy("chapter_index").select(segment.chars_joined(F.col("paragraphs"))).collect()] == [4, 0, 1]
    rows = spark.createDataFrame([("b", "EP.1\na\nEP.2"), ("c", "a\nb")], "book_id string, text string")
    assert {(r["book_id"], r["title"]) for r in segment.heading_preview(rows, segment.heading_patterns(["ep\\."])).collect()} == {("b", "EP.1"), ("b", "EP.2"), ("c", "第 1 节")}


def test_samples_keep_to_their_budget(spark):
    assert sample.region_plan(60_000) == (3, 4) and sample.region_plan(1000) == (3, 2)
    chosen = spark.createDataFrame([("b", 1), ("b", 4)], "book string, position int")
    paragraphs = spark.createDataFrame([("b", p, o, "x" * 2000) for p in (1, 2, 4) for o in range(3)], "book string, position int, ord int, text string")
    got = sample.sampled_text(chosen, paragraphs, "book", F.lit(7000)).orderBy("position", "ord").collect()
    assert [(r["position"], r["ord"], len(r["text"])) for r in got] == [(1, 0, 2000), (1, 1, 1500), (4, 0, 2000), (4, 1, 1500)]
    assert sum(len(r["text"]) for r in sample.sampled_text(chosen, paragraphs, "book", F.lit(4000)).collect()) == 4000


def test_glossary_helpers(spark):
    rows = [(0, "강", "江", "person", "", True, ["河", " 江河 ", "江河", "江"], False, ["大江"]), (1, "", "山", "term", "注", True, ["峰"], False, []), (2, "물", "", "term", "", True, [], False, [])]
    df = spark.createDataFrame(rows, glossary.SCHEMA)
    assert glossary.looks_common(df).first()["common"] and not glossary.looks_common(df.where("ord = 0")).first()["common"]
    assert [r["ord"] for r in glossary.removed(df, spark.createDataFrame([("강",)], "ko string")).orderBy("ord").collect()] == [1, 2]
    assert df.where("ord = 0").select(glossary.clean_alternatives(F.col("alternatives"), F.col("ko"), F.col("zh"))).first()[0] == ["江河"]
    assert df.where("ord = 0").select(glossary.merged_alternatives(F.array(F.lit("长江")), F.col("alternatives"), F.col("ko"), F.col("zh"))).first()[0] == ["长江", "江河"]
    assert [(r["ord"], r["line"]) for r in glossary.prompt_lines(df).collect()] == [(0, "- 강 -> 江")]


@pytest.mark.parametrize(("name", "value"), [("a/Cover-1.JPG", True), ("recover.png", False), ("COVER", True)])
def test_names_and_audits(spark, name, value):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(t.is_cover_name(F.lit(name))) is value and one(t.is_html_name(F.lit("A.XHTML"))) and not one(t.is_html_name(F.lit("a.css")))
    assert [one(t.volume_of(F.lit(x))) for x in ("v12:a.html", "v:a", "a")] == ["v12", "", ""] and one(t.has_dialogue(F.lit("他说「好」"))) and not one(t.has_dialogue(F.lit("好")))
    titles = spark.createDataFrame([("a", "하나", "一"), ("a", "둘", " "), ("a", "셋̸", ""), ("a", " ", "x"), ("c", "넷", None)], "archive string, ko string, zh string")
    assert {tuple(r) for r in archive.title_audit(titles, "archive").collect()} == {("a", 2, 1, 1), ("c", 1, 0, 1)}
    chunks, done = (spark.createDataFrame(x, "id string") for x in ([("a",), ("b",)], [("b",), ("c",)]))
    assert archive.same_structure(chunks, done, "id") and not archive.same_structure(chunks, done.where("id = 'c'"), "id") and archive.same_structure(chunks, done.limit(0), "id")


def test_patterns_are_asked_for(spark):
    df = chapters(spark, [(k, f"EP.{k}", 2, None, ["本章字数: 3", f"标题{k}", "文"]) for k in range(30)] + [(40, "真", 2, None, ["x"])])
    asked = corrections.placeholder_prompt(sample.distinct_titles(df.withColumn("position", F.col("chapter_index")), "book"), "book").first()["prompt"]
    assert asked.endswith("- 真") and "- EP.0\n- EP.1" in asked
    heads = corrections.body_title_prompt(df, "book", lines=1, count=3).first()["prompt"]
    assert heads.endswith("[Chapter: EP.0]\n  标题0\n\n[Chapter: EP.14]\n  标题14\n\n[Chapter: EP.29]\n  标题29")
    said_ = lambda x: tuple(spark.range(1).select(corrections.said_pattern(F.lit(x)).alias("p")).first()["p"])
    assert [said_(x) for x in ('{"pattern": " ^a ", "found": false}', 'so {"pattern": "b"}', "{}", "no")] == [("^a", False), ("b", True), ("", False), ("", False)]


def test_books_are_put_in_order(spark):
    df = spark.createDataFrame([("b", 1, None, 1, "卷"), ("b", 2, 1, 2, "EP.9 末"), ("b", 3, 1, 2, "EP.2 初")], "book string, chapter_index long, parent_index long, heading_level int, title string")
    made = books.put_in_order(df, "book", "第 {n} 章", by_number=True).orderBy("chapter_index").collect()
    assert [(r["chapter_index"], r["parent_index"], r["title"], r["changed"]) for r in made] == [(1, None, "卷", False), (2, 1, "第 2 章 初", True), (3, 1, "第 9 章 末", True)]
    two = spark.createDataFrame([("s", 1, 0, "a", 1, None), ("t", 1, 0, "b", 6, None), ("s", 2, 0, "c", 1, None)], "series string, volume_no int, chapter_index int, title string, heading_level int, parent_index int")
    got = sorted((r["series"], r["chapter_index"], r["title"], r["heading_level"], r["parent_index"]) for r in books.merged_volumes(two, "书", "series").collect())
    assert got == [("s", 0, "书 第1卷", 1, None), ("s", 1, "a", 2, 0), ("s", 2, "书 第2卷", 1, None), ("s", 3, "c", 2, 2), ("t", 0, "书 第1卷", 1, None), ("t", 1, "b", 6, 0)]


def test_samples_are_chosen_and_told(spark):
    rows = spark.createDataFrame([("b", p, 5000 + p) for p in range(30)], "book string, position int, chars long")
    positions = lambda df: sorted(r["position"] for r in df.collect())
    assert positions(sample.chosen(rows, "book", 150_000, regions=None)) == positions(sample.strided(rows, "book")) == [4, 9, 14, 19, 24, 29]
    first, second = positions(sample.chosen(rows, "book", 150_000)), positions(sample.chosen(rows, "book", 150_000, round_=1))
    assert len(first) == 12 and not set(first) & set(second)
    chosen = sample.strided(rows, "book")
    assert sample.report_text(sample.report(rows, chosen, "book"), chosen, "book").first()["text"] == "6/30 chapters, 50000/150435 characters, at [4,9,14,19,24,29], 13% to 100%, start, middle and end covered"
