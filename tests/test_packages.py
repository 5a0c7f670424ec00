"""Packages read by ranges of entries, and files that appear together or not at all."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.sources import archives, epub, files, packages


def package(path, entries, stored=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", stored) as z:
        for name, data in entries.items():
            z.writestr(name, data)


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "books"
    (root / "deep").mkdir(parents=True)
    package(root / "a.epub", {"mimetype": "application/epub+zip", "OEBPS/one.xhtml": "<p>1</p>", "OEBPS/s.css": "p{}", "OEBPS/two.XHTML": "<p>2</p>"})
    package(root / "deep" / "b.EPUB", {f"p{k}.html": os.urandom(1000) for k in range(40)}, zipfile.ZIP_STORED)
    (root / "no.epub").write_bytes(b"no zip file")
    (root / "x.txt").write_text("text")
    return root


def test_entries_of_packages_in_ranges(spark, folder):
    rows = packages.entries(spark, str(folder), rangebytes="4500")
    got = {(os.path.basename(r["book"]), r["entry"]): r for r in rows.collect()}
    assert len(got) == 44 and rows.count() == 44 and got["a.epub", "OEBPS/two.XHTML"]["suffix"] == ".xhtml"
    assert bytes(got["a.epub", "OEBPS/s.css"]["content"]) == b"p{}" and got["b.EPUB", "p7.html"]["size"] == 1000
    with zipfile.ZipFile(folder / "deep" / "b.EPUB") as z:
        assert all(bytes(got["b.EPUB", n]["content"]) == z.read(n) for n in z.namelist())
    by_task = rows.where("suffix = '.html'").groupBy(F.spark_partition_id()).count().collect()
    assert len(by_task) > 5 and max(r["count"] for r in by_task) <= 8
    assert packages.entries(spark, str(folder / "a.epub")).count() == 4
    assert packages.entries(spark, str(folder), suffixes=".zip").count() == 0


def test_ranges_hold_every_item_once():
    assert packages.ranges([], 5) == [] and packages.ranges([9], 5) == [(0, 1)] and packages.ranges([1, 2, 3, 9, 1], 5) == [(0, 2), (2, 3), (3, 4), (4, 5)]


def test_conditions_reach_the_source(spark, folder):
    rows = packages.entries(spark, str(folder)).where("suffix = '.css' AND entry LIKE 'OEBPS/%' AND size > 1")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    left = next(line for line in plan.splitlines() if "Filter" in line)
    assert "size" in left and ".css" not in left and "OEBPS" not in left
    assert [r["entry"] for r in rows.collect()] == ["OEBPS/s.css"]
    reader = packages.PackageReader({"path": str(folder)})
    pushed = [packages.In(("suffix",), (".html", ".css")), packages.EqualTo(("book",), f"{folder}/a.epub"), packages.EqualTo(("size",), 3)]
    assert list(reader.pushFilters(pushed)) == [pushed[2]]
    assert [p.book for p in reader.partitions()] == [f"{folder}/a.epub"]
    assert [x[1] for p in reader.partitions() for x in reader.read(p)] == ["OEBPS/s.css"]


def test_files_appear_together(spark, tmp_path):
    target = tmp_path / "out"
    rows = spark.createDataFrame([(f"d{k % 3}/f{k}.txt", f"text {k}".encode()) for k in range(20)], "name string, content binary")
    packages.publish(rows.repartition(4), str(target))
    found = {os.path.relpath(os.path.join(d, n), target): open(os.path.join(d, n)).read() for d, _, names in os.walk(target) for n in names}
    assert found == {f"d{k % 3}/f{k}.txt": f"text {k}" for k in range(20)}
    with pytest.raises(Exception, match="there already"):
        packages.publish(rows.limit(1), str(target))
    packages.publish(spark.createDataFrame([("d0/f0.txt", "new")], "name string, content string"), str(target), overwrite=True)
    assert (target / "d0" / "f0.txt").read_text() == "new" and (target / "d1" / "f1.txt").read_text() == "text 1"
    assert not [n for n in os.listdir(target) if n.startswith(".staging")]


@pytest.mark.parametrize("bad", [("x", None), (None, b"x"), ("../out", b"x"), ("/abs", b"x"), ("ok7", b"again")])
def test_a_write_that_fails_leaves_nothing(spark, tmp_path, bad):
    target = tmp_path / "out"
    target.mkdir()
    (target / "kept").write_text("kept")
    rows = spark.createDataFrame([(f"ok{k}", b"x") for k in range(20)] + [bad], "name string, content binary")
    with pytest.raises(Exception):  # noqa: B017, PT011  Spark wraps it
        packages.publish(rows.repartition(5), str(target))
    assert os.listdir(target) == ["kept"]


def test_moves_that_fail_are_undone(tmp_path):
    writer = packages.FileWriter({"path": str(tmp_path)}, packages.StructType.fromDDL("name string, content binary"), True)
    (tmp_path / "a").write_text("old")
    (tmp_path / "dir").write_text("a file where a folder is needed")
    said = writer.write(iter([("a", b"new"), ("b", b"new"), ("dir/c", b"new")]))
    with pytest.raises(Exception):  # noqa: B017, PT011
        writer.commit([said, None])
    assert {n: (tmp_path / n).read_text() for n in os.listdir(tmp_path)} == {"a": "old", "dir": "a file where a folder is needed"}


def test_books_texts_archives_and_glossaries_as_files(spark, tmp_path):
    chapters = spark.createDataFrame([("one", 0, "A", ["x", "y"]), ("one", 1, "B", []), ("two", 0, "C", ["z"])], "book_id string, chapter_index int, title string, paragraphs array<string>")
    files.save_texts(chapters, str(tmp_path))
    files.save_packages(chapters, str(tmp_path))
    assert (tmp_path / "one.txt").read_text() == "A\n\nx\n\ny\n\nB"
    loaded = files.books(spark, str(tmp_path), heading_patterns=("^[A-C]$",)).collect()
    assert {(os.path.basename(r["book_id"]), r["title"], tuple(r["paragraphs"])) for r in loaded} == {(f"{b}.{k}", t, p) for b, t, p in (("one", "A", ("x", "y")), ("one", "B", ()), ("two", "C", ("z",))) for k in ("txt", "epub")}
    filled = files.books(spark, str(tmp_path), heading_patterns=("^[A-C]$",), drop_zero=True)
    assert filled.count() == 4 and {r["title"] for r in filled.collect()} == {"A", "C"}
    assert files.books(spark, str(tmp_path / "one.epub")).count() == 2
    with pytest.raises(ValueError, match="unknown kind"):
        files.books(spark, str(tmp_path / "one.pdf"))
    rows = spark.createDataFrame([("runs/one", '{"source": "s", "completed": {}}')], "archive string, content string")
    files.save_json(rows, "archive", str(tmp_path))
    assert archives.read(spark, str(tmp_path / "runs")).first()["source"] == "s"
    assert epub.load(spark, str(tmp_path / "two.epub")).first()["paragraphs"] == ["z"]
