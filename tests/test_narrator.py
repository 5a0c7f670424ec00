import pytest
from pyspark.sql import functions as F

from quire.operators import archive, books, narrator, sample

BLOCK = "file string, block int, class string, segments array<string>, chars long"


def test_options_are_checked():
    o = narrator.Options(" A ", pronoun=" ", style="odd", strategy="odd").checked()
    assert (o.name, o.pronoun, o.style, o.strategy) == ("A", "他", "pronoun", "conservative")
    for bad in (narrator.Options("  "), narrator.Options("A", batch_chars=0)):
        with pytest.raises(ValueError):
            bad.checked()


def test_blocks_keep_their_numbers(spark):
    nodes = spark.createDataFrame(
        [("a", 0, 0, "h1", "heading", "T"), ("a", 2, 1, "p", "narration", "y"), ("a", 1, 1, "p", "narration", "xx"), ("a", 3, 2, "p", "dialogue", "z")],
        "file string, node int, block int, tag string, class string, text string",
    )
    by = lambda **o: {r["block"]: (r["segments"], r["chars"]) for r in narrator.blocks(nodes, "file", narrator.Options("A", **o)).collect()}
    assert by() == {1: (["xx", "y"], 3)}
    assert by(dialogue=True) == by(strategy="coverage") == {1: (["xx", "y"], 3), 2: (["z"], 1)}


def test_batches(spark):
    rows = [("a", i, "narration", [], n) for i, n in enumerate([4, 0, 0, 5, 9, 30, 1])] + [("b", 7, "narration", [], 99)]
    got = {(r["file"], r["block"]): r["batch"] for r in narrator.batches(spark.createDataFrame(rows, BLOCK), "file", 10).collect()}
    assert got == {("a", 0): 0, ("a", 1): 0, ("a", 2): 0, ("a", 3): 1, ("a", 4): 2, ("a", 5): 3, ("a", 6): 4, ("b", 7): 0}
    assert narrator.batches(spark.createDataFrame([], BLOCK), "file", 10).count() == 0


def test_batches_of_large_files_are_those_of_the_fold(spark):
    rows = [(f, i, "narration", [], (i * 7919 + i * i) % 23 * (i % 5 > 0) + 60 * (i % 97 == 5)) for f, n in (("a", 900), (None, 120), ("c", 1), ("d", 7)) for i in range(n)]
    blocks = spark.createDataFrame(rows, BLOCK)
    read = lambda most, **o: sorted((str(r["file"]), r["block"], r["batch"]) for r in narrator.batches(blocks, "file", most, **o).collect())
    for most in (50, 5000):
        folded = read(most)
        assert len(folded) == len(rows) and read(most, gathered=0) == folded
    assert read(50, gathered=10) == read(50)
    assert narrator.batches(blocks.where("false"), "file", 10, gathered=0).count() == 0


def test_ledger(spark):
    blocks = spark.createDataFrame([("a", 0, "narration", [" x ", "y"], 4), ("a", 1, "narration", ["z"], 1), ("a", 2, "narration", ["w"], 1)], BLOCK)
    edits = spark.createDataFrame(
        [("a", 0, 5, ["X", " Y "]), ("a", 1, 5, ["Z", "?"]), ("a", 2, 5, [" "]), ("a", 9, 5, ["q"]), ("a", 2, 6, None)], "file string, block int, seq int, segments array<string>"
    )
    events = narrator.manual(blocks, edits, "file")
    assert {(r["block"], r["seq"]): (r["segments"], r["problem"]) for r in events.collect()} == {
        (0, 5): ([" X ", "Y"], None), (1, 5): (None, "number of segments"), (2, 5): (None, "blank segment"), (9, 5): (None, "unknown block"), (2, 6): (None, "number of segments")
    }
    lost = narrator.failures(blocks, spark.createDataFrame([("a", 0, 1, "old"), ("a", 1, 1, None), ("a", 9, 1, "no")], "file string, block int, seq int, error string"), "file")
    now = narrator.state(blocks, lost.unionByName(events.where("problem IS NULL").drop("problem")), "file")
    assert {r["block"]: (r["status"], r["translated"]) for r in now.collect()} == {0: ("completed", [" X ", "Y"]), 1: ("failed", None), 2: ("pending", None)}
    assert [(r["block"], r["translated"], r["error"]) for r in narrator.failed(now).collect()] == [(1, [], "")]
    assert tuple(narrator.progress(now, "file").first()) == ("a", 1, 1, 1)


def test_malformed(spark):
    rows = [
        (1, ['{"paragraphs": [', '"a",'], ["a"], "recovered", "json lines"), (2, ["x", '"a",', '"b",'], ["a", "b"], "recovered", "json lines"),
        (3, ['{"paragraphs": ["a"]}', " "], ["a", ""], "recovered", "one blob"), (4, ["a", "b"], ["““a", "b"], "cleaned", "run of quotes"),
        (5, ["a", "b"], ["a", " "], "cleaned", "missing paragraphs"), (6, ["a", "b"], ["a", "b"], "fallback_source", "not repairable"),
        (7, None, ["a", "b"], "cleaned", "other"), (8, [None, "a", "b"], [], "cleaned", "other"),
    ]
    df = spark.createDataFrame(rows, "k int, raw array<string>, parsed array<string>, status string, want string")
    got = df.withColumn("got", archive.malformed_issue(F.col("raw"), F.col("parsed"), F.col("status"))).withColumn("r", archive.repairable(F.col("parsed"), F.col("status"))).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    assert [r["k"] for r in got if r["r"]] == [2, 4, 7]
    blocks = spark.createDataFrame([("s", True, ["a"]), ("", True, ["a"]), ("s", False, ["a"]), ("s", True, []), ("s", None, None), ("s", True, [" "])], "archive string, repairable boolean, repaired array<string>")
    assert tuple(archive.repair_counts(blocks).first()) == (1, 1, 3)


def test_titles(spark):
    titles = spark.createDataFrame([(0, "12. 이름 (3)"), (1, "이름 (4)"), (2, "이름"), (3, "다른")], "ord int, ko string")
    got = {r["ord"]: r["zh"] for r in archive.group_titles(titles, spark.createDataFrame([("이름", "12. 名字 (3)")], "core string, zh string")).collect()}
    assert got == {0: "12. 名字 (3)", 1: "名字 (4)", 2: "名字"}
    rows = [(1, "魂火 - 1"), (1, " 魂火 - 2 "), (1, None), (2, "甲"), (2, "甲"), (3, "甲"), (3, "乙"), (4, " ")]
    assert {r["s"]: r["title"] for r in books.common_title(spark.createDataFrame(rows, "s int, title string"), "s").collect()} == {1: "魂火", 2: "甲", 3: "", 4: ""}


@pytest.mark.parametrize(("n", "count"), [(0, 3), (1, 3), (2, 3), (4, 3), (6, 3), (23, 10), (5, 1), (8, 4)])
def test_evenly(spark, n, count):
    df = spark.range(n).selectExpr("1 AS b", "id AS position")
    k = min(count, n)
    want = sorted({round(i * (n - 1) / (k - 1)) for i in range(k)} if k > 1 else {0} if n else set())
    assert sorted(r["position"] for r in sample.evenly(df, "b", count).collect()) == want
