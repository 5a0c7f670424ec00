"""Replies of a completion service, glossaries from them, archives, and the completion plan."""

import json

import pytest
from pyspark.sql import functions as F

from quire.functions import replies
from quire.operators import terms
from quire.plans import complete
from quire.sources import archives

VALUES = [
    ("object", ['{"paragraphs": ["黑夜", "白天"]}', ""], ["黑夜", "白天"], "recovered"),
    ("lines", ['{"paragraphs": [', '"黑夜",', '"白天",', '"他说“好。”"', "]}"], ["黑夜", "白天"], "recovered"),
    ("inner quotes", ['{"paragraphs": ["他说"走"。", "她走了"]}'], ['他说"走"。', "她走了"], "recovered"),
    ("echoed", ['{"translation": ["甲乙", "丙丁"]} format: {"paragraphs": []}'], ["甲乙", "丙丁"], "recovered"),
    ("quote runs", ["““““来。””””", "走"], ["“来。”", "走"], "ok"), ("edges", ['"“来。”",', "走"], ["“来。”", "走"], "ok"),
    ("left quote", ['"半句', "走"], ["半句", "走"], "ok"), ("residue", ['"a" and "b"', "走"], ['"a" and "b"', "走"], "cleaned"),
    ("numbers stay", ["1. 甲", "走...."], ["1. 甲", "走...."], "ok"), ("blank", ["", " "], ["", ""], "unresolved"), ("one", ["甲"], ["甲", ""], "ok"), ("none", None, [], "unresolved"),
]


@pytest.mark.parametrize("fill", [False, True])
def test_stored_values_are_normalised(spark, fill):
    df = spark.createDataFrame([(n, v, 2, ["源一", "源二"]) for n, v, _, _ in VALUES], "name string, v array<string>, n int, s array<string>")
    got = {r["name"]: (r["x"]["paragraphs"], r["x"]["status"]) for r in df.select("name", replies.normalised(F.col("v"), F.col("n"), F.col("s"), fill).alias("x")).collect()}
    for name, _, want, status in VALUES:
        if fill and status == "unresolved":
            want, status = ["源一", "源二"], "ok" if name == "blank" else "fallback_source"
        elif fill:
            want = [w or s for w, s in zip(want, ["源一", "源二"], strict=True)]
        assert got[name] == (want, status), name
    free = df.select("name", replies.normalised(F.col("v"), F.lit(None).cast("int"), F.col("s")).alias("x"))
    assert {r["name"]: r["x"]["paragraphs"] for r in free.collect()}["lines"] == ["黑夜", "白天", "他说“好。”"]


def test_committed_values_are_cleaned_without_the_source(spark):
    df = spark.createDataFrame([(["““好””", ""],), (['{"paragraphs": ["甲甲", "乙乙"]}'],), (["x"],)], "v array<string>")
    assert [r[0] for r in df.select(replies.committed(F.col("v"))).collect()] == [["“好”", ""], ["甲甲", "乙乙"], ["x"]]


@pytest.mark.parametrize(("reply", "lines", "two"), [
    ('{"paragraphs": ["a", "b"]}', ["a", "b"], ["a", "b"]), ('so:\n```json\n["a", null, {"text": "b"}, 3]\n```', ["a", "b", "3"], ["a", "b"]), ('{"p1": "a", "p2": {"content": ["b"]}}', ["a", "b"], ["a", "b"]),
    ("a\n\n b ", ["a", "b"], ["a", "b"]), ('x [ "a" ] y', ["a"], ["a", ""]), ("{}", ["{}"], ["", ""]), (" ", [], ["", ""]), (None, [], ["", ""]), ('"a\\nb"', ["a\nb"], ["a", "b"]),
])
def test_replies_become_paragraphs(spark, reply, lines, two):
    df = spark.createDataFrame([(reply,)], "r string")
    assert tuple(df.select(replies.reply_lines(F.col("r")), replies.translated(F.col("r"), F.lit(2))).first()) == (lines, two)


def test_entries_are_read_from_replies(spark):
    said = {
        "groups": '{"people": [{"ko": "한강", "zh": "韩江", "kind": "person", "alts": "汉江,韩江,韩, 汉江"}], "terms": {"source": "별", "译名": "星"}, "places": "x"}', "map": '{"달": "月", "해": 3, "x": []}',
        "list": '["물 -> 水", "없음", {"원문": "불", "target": "火", "note": " n ", "confirmed": 1, "alternatives": ["烈火", 7]}, {"ko": "x"}]', "bad": "no names", "empty": "{}",
    }
    df = spark.createDataFrame(list(said.items()), "name string, reply string")
    got = {}
    for r in terms.parsed(df, "name").collect():
        got.setdefault(r["name"], []).append((r["ord"], r["ko"], r["zh"], r["kind"], r["note"], r["confirmed"], r["alternatives"], r["problem"]))
    plain = lambda k, ko, zh, **o: (k, ko, zh, o.get("kind", "term"), o.get("note", ""), o.get("confirmed", False), o.get("alts", []), None)
    assert sorted(got["groups"]) == [plain(0, "별", "星"), plain(1, "한강", "韩江", kind="person", alts=["汉江"])]
    assert got["map"] == [plain(0, "달", "月"), plain(1, "해", "3")] and "empty" not in got
    assert got["list"] == [plain(0, "물", "水"), plain(1, "불", "火", note="n", confirmed=True, alts=["烈火"])]
    assert [x[-1] for x in got["bad"]] == ["no names"]
    assert [(r["name"], r["ko"]) for r in terms.parsed(df, "name", 1).where("name = 'map'").collect()] == [("map", "달")]


ENTRIES = "ord int, ko string, zh string, kind string, note string, confirmed boolean, alternatives array<string>, replace_short boolean, zh_history array<string>"


def test_suggestions_and_nicknames_are_checked(spark):
    rows = [(0, "최범진", "崔范镇", "person", "", True, ["范镇哥"], False, []), (1, "달", "月", "term", "有", False, [], False, []), (2, "별이", "星", "term", "", False, [], False, [])]
    entries = spark.createDataFrame(rows, ENTRIES)
    more = spark.createDataFrame([(0, "최범진", "x", "person", "主角", False, ["范镇哥", "崔氏"]), (1, "달", "月", "term", "新", False, []), (2, "없", "无", "term", "n", False, ["甲乙"])], terms.ENTRY)
    got = {r["ko"]: (r["alternatives"], r["note"], r["changed_alternatives"], r["changed_note"]) for r in terms.enriched(entries, more).collect()}
    assert got == {"최범진": (["范镇哥", "崔氏"], "主角", True, True), "달": ([], "有", False, False), "별이": ([], "", False, False)}
    reply = {"entries": [{"ko": "최범진", "nicknames": [{"ko": "범진", "zh": "范镇"}, {"ko": "최범", "zh": "崔范"}, {"ko": "범", "zh": "范"}, {"ko": "범진", "zh": "阿镇"}, {"ko": "별이", "zh": "星星"}, "x"]}, {"ko": "남", "nicknames": [{"ko": "남자", "zh": "男"}]}, 3]}
    said = terms.said_nicknames(spark.createDataFrame([(json.dumps(reply),)], "reply string"))
    texts = spark.createDataFrame([("최범진이 왔다.",), ("그때 범진아 하고 불렀다. 최범진은",), (None,)], "text string")
    judged = terms.nicknames(entries, said, texts).orderBy("ord").collect()
    assert [(r["ko"], r["verdict"]) for r in judged] == [("범진", "added"), ("최범", "not_found"), ("범", "skipped"), ("범진", "skipped"), ("별이", "skipped"), ("", "skipped")]
    new = terms.nickname_entries(terms.nicknames(entries, said, texts)).collect()
    assert [(r["ko"], r["zh"], r["kind"], r["note"]) for r in new] == [("범진", "范镇", "person-nickname", "崔范镇的昵称")]
    assert spark.range(1).select(terms.without_name(F.lit("최범진에게 최범진 a.b"), F.lit("최범진"))).first()[0] == "  a.b"
    assert terms.prompt_text(entries).first()["text"].split("\n")[1] == "- 달 -> 月（有）" and terms.prompt_text(entries.limit(0)).first()["text"] == "（无）"
    asks = terms.extract_prompt(spark.createDataFrame([("b", " 글 "), ("c", " ")], "book string, text string"), "book", 9, "do", entries).collect()
    assert len(asks) == 1 and asks[0]["prompt"].endswith("글") and "- 달 -> 月 [term] (open)" in asks[0]["prompt"]


def stored(**more):
    return json.dumps({
        "source": "/in/Book one.txt", "total_chunks": 3, "chunk_signature": "s", "chunk_chars": 900, "txt_patterns": ["^a", " "], "completed": {"c1": ["x", 2], "c2": "no list"},
        "failed": {"c3": {"error": "e", "chapter_index": 4, "chapter_title": "T", "chunk_index": 1, "paragraphs": ["p"]}, "c4": "old"}, "chapter_titles": {"0": {"ko": "하나", "zh": "一"}, "1": "x"}, "metadata": {"a": 1},
    } | more)


def test_archives_are_read_changed_and_written(spark, tmp_path):
    for name, content in {"a.json": stored(), "bad.json": "{", "empty.json": "{}", "list.json": stored(completed=[1])}.items():
        (tmp_path / name).write_text(content)
    rows = archives.read(spark, str(tmp_path)).withColumn("archive", F.regexp_extract("archive", "([^/]*)$", 1))
    told = {r["archive"]: tuple(r)[1:] for r in archives.summary(rows).collect()}
    assert told["a.json"] == ("Book one", "/in/Book one.txt", 3, 2, 2, None) and [told[x][-1] for x in ("bad.json", "empty.json", "list.json")] == ["not JSON", "no source", "no completed"]
    one = rows.where("archive = 'a.json'")
    assert {(r["chunk_id"], tuple(r["paragraphs"] or ["-"])) for r in archives.completed(one).collect()} == {("c1", ("x", "2")), ("c2", ("-",))}
    assert {(r["chunk_id"], r["error"], r["chapter_index"], tuple(r["paragraphs"] or ["-"])) for r in archives.failed(one).collect()} == {("c3", "e", 4, ("p",)), ("c4", "old", None, ("-",))}
    assert [tuple(r)[1:] for r in archives.titles(one).collect()] == [("0", "하나", "一")]
    assert tuple(archives.settings(one, 1800, 2600, ["z"], True).first())[1:] == (900, 2600, ["^a"], True)
    done = archives.with_completed(one, spark.createDataFrame([("a.json", "c3", ["old"], 1), ("a.json", "c3", ["new"], 2)], "archive string, chunk_id string, paragraphs array<string>, seq long"))
    done = archives.with_titles(done, spark.createDataFrame([("a.json", 1, "둘", " 二 ", 1), ("a.json", 0, "하나", " ", 2)], "archive string, chapter_index int, ko string, zh string, seq long"))
    done = archives.failed_again(done, spark.createDataFrame([("a.json", "c1", "audit", 0, "T", 0, ["q"])], "archive string, chunk_id string, error string, chapter_index int, chapter_title string, chunk_index int, paragraphs array<string>"))
    back = json.loads(archives.to_json(done).first()["content"])
    assert back["completed"]["c3"] == ["new"] and set(back["completed"]) == {"c2", "c3"} and set(back["failed"]) == {"c1", "c4"} and back["failed"]["c1"]["paragraphs"] == ["q"]
    assert back["chapter_titles"] == {"0": {"ko": "하나", "zh": "一"}, "1": {"ko": "둘", "zh": "二"}} and back["metadata"] == {"a": 1}
    again = archives.from_json(archives.to_json(done)).first().asDict(recursive=True)
    assert again | {"archive": 0} == done.first().asDict(recursive=True) | {"archive": 0}


def test_runs_go_on_only_where_the_structure_is_the_same(spark):
    now = spark.createDataFrame([("a", "s", 3, 900, 2600, ["c1", "c9"])], "archive string, chunk_signature string, total_chunks int, chunk_chars int, max_paragraph_chars int, chunk_ids array<string>")
    cases = [({}, None), ({"chunk_signature": "t"}, "structure"), ({"chunk_signature": None, "chunk_chars": 901}, "settings"), ({"chunk_signature": None, "total_chunks": 4}, "chunks"), ({"chunk_signature": None, "completed": {"zz": ["x"]}}, "chunks"),
             ({"chunk_signature": "t", "completed": {}, "failed": {}, "total_chunks": 0}, None), ({"chunk_signature": None}, None)]
    for change, want in cases:
        rows = archives.from_json(spark.createDataFrame([("a", stored(**change))], "archive string, content string"))
        assert archives.resume_problem(rows, now).first()["problem"] == want, change
    rows = archives.from_json(spark.createDataFrame([("a", stored()), ("b", "{")], "archive string, content string"))
    wanted = spark.createDataFrame([("a", "/in/Book one.txt"), ("b", "x"), ("c", "y")], "archive string, source string")
    sizes = lambda **o: {r["archive"]: len(r["completed"]) for r in archives.for_resume(rows, wanted, **o).collect()}
    assert sizes() == {"a": 2, "b": 0, "c": 0} and sizes(resume=False) == {"a": 0, "b": 0, "c": 0}
    assert archives.for_resume(rows, wanted.where("archive = 'a'").withColumn("source", F.lit("other"))).first()["completed"] == {}


def test_names_metadata_and_glossaries_of_archives(spark, tmp_path):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert [one(archives.book_title(F.lit(x))) for x in ("/o/.烟灰_第1卷.translation_state.json", "夜 上卷.json", "书.JSON", "外传.json")] == ["烟灰", "夜", "书", ""]
    assert one(archives.state_file("/out/", F.lit("b"))) == "/out/.b.translation_state.json" and [one(archives.media_type(F.lit(x))) for x in ("a/b.WEBP", "x.css", "x")] == ["image/webp", "text/css", "application/octet-stream"]
    meta = {"css_resources": [{"name": "s.css", "content": "p{}"}], "images": [{"name": "i", "content": b"\x00\xff"}], "chapter_css": {"a": ("s.css",)}, "document_structure": {"a": {}}, "cover_image": "i"}
    back = archives.decoded_metadata(json.loads(json.dumps(archives.encoded_metadata(meta))))
    assert back == {"css_resources": [{"name": "s.css", "content": b"p{}"}], "images": [{"name": "i", "content": b"\x00\xff"}], "chapter_css": {"a": ["s.css"]}, "document_structure": {"a": {}}}
    assert archives.decoded_metadata({"images": [{"name": "i", "content": "a"}]})["images"][0]["content"] == b"a" and archives.decoded_metadata(None) == {}
    rows = [(0, "강", "江", "person", "n", True, ["河水", "江水"], True, ["大江"]), (1, "달", "月", "term", "", False, [], False, [])]
    path = tmp_path / "g.json"
    path.write_text(archives.glossary_to_json(spark.createDataFrame(rows, ENTRIES), "src", "raw", 9).first()["content"])
    assert json.loads(path.read_text())["entries"][0]["alternatives"] == "河水,江水"
    assert [tuple(r) for r in archives.read_glossary(spark, str(path)).orderBy("ord").collect()] == rows and archives.read_glossary(spark, str(tmp_path / "none.json")).count() == 0


def test_titles_are_asked_for_together(spark):
    chapters = spark.createDataFrame([("b", 0, "하나"), ("b", 1, ""), ("b", 2, "셋̸"), ("b", 3, "넷")], "book string, chapter_index int, title string")
    asked = complete.title_prompts(chapters, "book", "do").first()
    assert asked["prompt"].endswith("[0] 하나\n[3] 넷")

    class Service:
        def complete(self, prompt):
            return '{"titles": {"0": " 一 ", "2": "x", "3": ""}}'

    ledger = complete.asked(complete.title_prompts(chapters, "book", "do"), "book", Service, delay=0)
    assert [(r["chapter_index"], r["title_zh"]) for r in complete.title_results(chapters, ledger, "book").orderBy("chapter_index").collect()] == [(0, "一"), (1, None), (2, None), (3, None)]


def test_rounds_stop_when_nothing_is_pending(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", "T", ["a"]), ("c2", "T", ["b", "c"])], "chunk_id string, title string, paragraphs array<string>")
    flag = str(tmp_path / "once")

    class Flaky:
        def complete(self, prompt):
            import os

            if "[2]" in prompt and not os.path.exists(flag):
                open(flag, "w").close()
                raise OSError("down")
            return '{"paragraphs": ["' + '", "'.join(x[4:].upper() for x in prompt.split("\n") if x.startswith("[")) + '"]}'

    ledger = complete.rounds(spark, chunks, str(tmp_path / "ledger"), "do", lambda: complete.JsonRequired(Flaky()), retries=1, delay=0)
    assert sorted((r["chunk_id"], r["seq"], r["error"]) for r in ledger.collect()) == [("c1", 1, None), ("c2", 1, "OSError: down"), ("c2", 2, None)]
    assert tuple(complete.progress(chunks, ledger).first()) == (2, 2, 0, 0)
    assert {r["chunk_id"]: r["final"] for r in complete.results(chunks, ledger, [("A", "Ä")]).collect()} == {"c1": ["Ä"], "c2": ["B", "C"]}
    with pytest.raises(ValueError, match="no JSON"):
        complete.JsonRequired(type("S", (), {"complete": lambda s, p: "plain"})()).complete("x")
    none = complete.completed(complete.prompts(chunks, "do"), Flaky, stop=lambda: True)
    assert none.count() == 0


def test_malformed_chunks_are_found_with_their_source(spark):
    from quire.operators import archive

    chunks = spark.createDataFrame([(f"c{k}", 1, "T", ["源一", "源二"]) for k in range(4)], "chunk_id string, chapter_index int, title string, paragraphs array<string>")
    done = spark.createDataFrame([("c0", ["好", "了"]), ("c1", ['{"paragraphs": ["甲甲", "乙乙"]}', ""]), ("c2", ["", ""]), ("c9", ['"a" b "c"', "走"]), ("c3", None)], "chunk_id string, values array<string>")
    got = {r["chunk_id"]: (r["status"], r["issue"], r["repairable"], r["repaired"], r["known"]) for r in archive.malformed(done, chunks, "chunk_id").collect()}
    assert got == {"c1": ("recovered", "one blob", True, ["甲甲", "乙乙"], True), "c2": ("unresolved", "missing paragraphs", False, [], True), "c9": ("cleaned", "other", True, [], False)}
    saved = spark.createDataFrame([("b", "0", "하나", "一"), ("b", "1", "둘", ""), ("b", "2", "다른", "x")], "book string, key string, ko string, zh string")
    chapters = spark.createDataFrame([("b", 0, "하나"), ("b", 1, "둘"), ("b", 2, "셋"), ("b", 3, "")], "book string, chapter_index int, title string")
    assert [tuple(r) for r in archive.missing_titles(saved, chapters, "book").orderBy("chapter_index").collect()] == [("b", 1, "둘", ""), ("b", 2, "셋", "")]


def test_glossaries_are_improved_in_two_steps(spark):
    rows = [(0, "최범진", "崔范镇", "person", "", True, [], False, []), (1, "달", "月", "term", "", False, [], False, [])]
    entries = spark.createDataFrame(rows, ENTRIES)
    prompts = []

    def ask(row):
        prompts.append(row.first()["prompt"])
        short = {"entries": [{"ko": "최범진", "nicknames": [{"ko": "범진", "zh": "范镇"}]}]}
        return spark.createDataFrame([(json.dumps(short if len(prompts) == 1 else {"entries": [{"ko": "범진", "zh": "范镇", "alts": "范真", "note": "x"}, {"ko": "달", "zh": "月", "note": "天"}]}),)], "reply string")

    got = {r["ko"]: (r["kind"], r["alternatives"], r["note"]) for r in terms.improved(entries, spark.createDataFrame([("범진아 달",)], "text string"), ask).collect()}
    assert got == {"최범진": ("person", [], ""), "달": ("term", [], "天"), "범진": ("person-nickname", ["范真"], "崔范镇的昵称")}
    assert "달" not in prompts[0] and "- ko=범진 | zh=范镇 | kind=person-nickname | note=崔范镇的昵称 | alts=" in prompts[1]


def test_books_are_translated_by_chunks(spark, tmp_path):
    class Upper:
        def complete(self, prompt):
            if "bad" in prompt:
                raise OSError("no")
            return json.dumps([x.split("] ", 1)[1].upper() for x in prompt.split("\n") if x.startswith("[")])

    chapters = spark.createDataFrame([("b", 0, "T", ["aa", "bb", "cc"]), ("b", 1, "U", []), ("c", 0, "V", ["bad"])], "book_id string, chapter_index int, title string, paragraphs array<string>")
    done = complete.translated_books(spark, chapters, str(tmp_path / "l"), "do", Upper, pairs=[("BB", "ß")], chunk_chars=6, retries=1, delay=0)
    assert {(r["book_id"], r["chapter_index"]): r["paragraphs"] for r in done.collect()} == {("b", 0): ["AA", "ß", "CC"], ("b", 1): [], ("c", 0): ["bad"]}


def test_person_archives_are_read_and_written(spark, tmp_path):
    good = {"mode": "first_to_third", "source_path": "/a", "source_fingerprint": "f", "output_path": "/b", "options": {"name": "林"}, "blocks": {"x#1": {"file": "x", "index": 1, "source_segments": ["s"], "status": "failed", "error": "e"}, "x#2": 3}}
    cases = {"good": good, "kind": good | {"mode": "z"}, "options": good | {"options": []}, "blocks": good | {"blocks": None}, "source_path": good | {"source_path": " "}}
    rows = archives.person_from_json(spark.createDataFrame([(k, json.dumps(v)) for k, v in cases.items()] + [("not an object", "[")], "archive string, content string"))
    assert {r["archive"]: r["problem"] for r in rows.collect()} == {k: None if k == "good" else k for k in [*cases, "not an object"]}
    back = json.loads(archives.person_to_json(rows.where("archive = 'good'")).first()["content"])
    assert back["options"] == {"name": "林"} and back["blocks"] == {"x#1": {"file": "x", "index": 1, "classification": "narration", "source": "s", "source_segments": ["s"], "translated_segments": [], "status": "failed", "error": "e"}}
    path = tmp_path / "s.json"
    path.write_text("{}")
    assert archives.forget(spark, str(path)) and not archives.forget(spark, str(path)) and not path.exists()
