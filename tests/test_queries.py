"""Every query with SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pytest

from quire import queries
from quire.operators import books

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(values, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = df.collect()
    assert got
    if name in queries.ORACLE:
        want = duck.execute(queries.ORACLE[name])
        assert rows(got, df.columns) == rows(want.fetchall(), [d[0] for d in want.description])


def test_chapters_cover_documents_without_headings(spark, duck):
    found = queries.QUERIES["chapter_segmentation"](spark, SF).collect()
    filled = {r[0] for r in duck.execute("SELECT doc_id FROM documents WHERE trim(text, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) <> ''").fetchall()}
    assert {r["doc_id"] for r in found} == filled
    headed = {r[0] for r in duck.execute(f"SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(trim(line)) <= 90 AND regexp_matches(trim(line), '{queries.LATIN}')").fetchall()}
    packed = [r for r in found if r["doc_id"] not in headed]
    assert packed and all(r["title"] == f"第 {r['chapter_index'] + 1} 节" for r in packed)
    assert any(r["chapter_index"] > 0 for r in packed)


def test_organised_keeps_chapters_of_any_depth_and_of_parent_cycles(spark):
    chain = [("deep", i, i - 1 if i > 1 else None, min(i, 6), f"EP.{i}") for i in range(1, 10)]
    ring = [("ring", 1, None, 1, "a"), ("ring", 2, 4, 2, "b"), ("ring", 3, 2, 2, "c"), ("ring", 4, 3, 2, "d"), ("ring", 5, 3, 2, "e"), ("ring", 6, 6, 2, "f"), ("ring", 7, 99, 2, "g")]
    df = spark.createDataFrame(chain + ring, "book string, chapter_index long, parent_index long, heading_level int, title string")
    found = books.organised(df, "book", "第 x 章", by_number=False).orderBy("book", "new_index").collect()
    assert [(r["new_index"], r["chapter_index"]) for r in found if r["book"] == "deep"] == [(i, i) for i in range(1, 10)]
    got = [(r["new_index"], r["chapter_index"], r["new_title"]) for r in found if r["book"] == "ring"]
    assert got == [(1, 1, "a"), (2, 2, "第 2 章 b"), (3, 3, "第 1 章 c"), (4, 4, "第 1 章 d"), (5, 5, "第 2 章 e"), (6, 6, "第 3 章 f"), (7, 7, "第 4 章 g")]


def test_whole_lines_reach_the_archive_and_title_operators(spark, duck):
    import hashlib

    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    want = {i: hashlib.sha256("\n".join(x + "*" * (n % 3 > 0) for n, x in enumerate(t.split("\n"))).encode()).hexdigest() for i, t in texts.items()}
    assert {r["doc_id"]: r["sha"] for r in queries.QUERIES["assembled_books"](spark, SF).collect()} == want
    titles = queries.QUERIES["distinct_titles"](spark, SF).collect()
    assert all(r["title"] == texts[r["position"]].split("\n")[0].strip() for r in titles)
    assert any(len(r["title"]) > 5 for r in titles)
