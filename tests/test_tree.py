"""Orders of forests against a walk of the tree."""

import random

import pytest

from quire.operators import tree


def walked(rows):
    """(node, place, seq) of (node, parent, number) by recursion without recursion."""
    up = {n: p for n, p, _ in rows}
    number = {n: k for n, _, k in rows}
    for start in sorted(up):
        seen, node = [], start
        while node in up and node not in seen:
            seen.append(node)
            node = up[node]
        if node in up and min(seen[seen.index(node) :]) == start:
            up[start] = None
    below = {}
    for n, p in up.items():
        below.setdefault(p if p in up else None, []).append(n)
    seq = {}
    for group in below.values():
        numbered = all(number[g] is not None for g in group)
        group.sort(key=lambda n, numbered=numbered: (number[n] if numbered else 0, n))
        seq |= {n: k for k, n in enumerate(group, 1)}
    out, left = [], below.get(None, [])[::-1]
    while left:
        node = left.pop()
        out.append((node, len(out) + 1, seq[node]))
        left += below.get(node, [])[::-1]
    return sorted(out)


def forests():
    rng = random.Random(4)
    books = {
        "wide": [(k, 1 if k > 1 else None, rng.randint(0, 9)) for k in range(1, 200)],
        "flat": [(k * 7, None, None) for k in range(150)],
        "rings": [(1, 1, 5), (2, 3, 1), (3, 4, None), (4, 2, 2), (5, 4, 3), (6, 5, 3), (7, 99, 4), (8, 1, 0), (9, 10, 1), (10, 9, 1)],
        "one": [(5, None, None)],
    }
    for k in range(3):
        nodes = rng.sample(range(-300, 300), 80)
        books[f"random{k}"] = [(n, rng.choice([None, *nodes]), rng.choice([None, 1, 2, 3]) if k else rng.randint(0, 3)) for n in nodes]
    return books


@pytest.mark.parametrize("partitions", ["4", "37"])
def test_places_are_those_of_a_walk(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        books = forests()
        df = spark.createDataFrame([(b, *r) for b, rows in books.items() for r in rows], "book string, node long, parent long, number long")
        got = {}
        for r in tree.preorder(df, "book", "node", "parent", "number").collect():
            got.setdefault(r["book"], []).append((r["node"], r["place"], r["seq"]))
        assert {b: sorted(rows) for b, rows in got.items()} == {b: walked(rows) for b, rows in books.items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_chain_of_ten_thousand_levels(spark):
    chain = spark.range(10_000).selectExpr("'deep' AS book", "9999 - id AS node", "IF(id = 0, NULL, 10000 - id) AS parent")
    found = tree.preorder(chain, "book", "node", "parent")
    assert found.where("place = 10000 - node AND seq = 1").count() == 10_000


def test_empty_forest(spark):
    assert tree.preorder(spark.createDataFrame([], "book string, node long, parent long"), "book", "node", "parent").collect() == []


def test_running_sums_go_on_over_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        rows = spark.range(3000).selectExpr("IF(id < 2500, NULL, id % 3) AS g", "id", "id % 11 AS v").repartition(5)
        got = sorted((r["g"], r["id"], r["seq"], r["before"]) if r["g"] is not None else (-1, r["id"], r["seq"], r["before"]) for r in tree.running(rows, ["g"], ["id"], "v").collect())
        want, held = [], {}
        for i in range(3000):
            g = -1 if i < 2500 else i % 3
            n, s = held.get(g, (0, 0))
            want.append((g, i, n + 1, s))
            held[g] = (n + 1, s + i % 11)
        assert got == sorted(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
