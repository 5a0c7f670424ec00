"""Centres of sizes against plain sorting, and sizes of trees of chapters."""

import random
import statistics

from quire.operators import books


def plain(sizes):
    sizes = sorted(s for s in sizes if s > 0)
    k = int(len(sizes) * 0.1)
    mean, median = statistics.fmean(sizes[k : len(sizes) - k]), statistics.median(sizes)
    return len(sizes), median if not median * 0.5 <= mean <= median * 2 else mean


def test_centres_are_those_of_sorted_sizes(spark):
    rng = random.Random(2)
    sizes = {"one": [7], "two": [3, 8], "ties": [5] * 40 + [9] * 3, "zeros": [0, 0, 4], "skewed": [1] * 50 + [10**9] * 49}
    sizes |= {f"r{k}": [rng.randint(0, 10 ** rng.randint(1, 6)) for _ in range(rng.randint(1, 60))] + [1] for k in range(20)}
    df = spark.createDataFrame([(b, s) for b, ss in sizes.items() for s in ss], "book string, chars long")
    got = {r["book"]: (r["content_count"], r["centre"]) for r in books.centre(df, "book").collect()}
    assert {b: (n, round(c, 6)) for b, (n, c) in got.items()} == {b: (plain(ss)[0], round(plain(ss)[1], 6)) for b, ss in sizes.items()}
    assert books.centre(df.limit(0), "book").collect() == []


def test_a_tree_of_chapters_has_rounded_minutes(spark):
    df = spark.createDataFrame([("a", 1, 200), ("a", 2, 601), ("b", 1, 1000)], "volume string, chapter int, chars long")
    got = {(r["level"], r["volume"], r["chapter"]): (r["chars"], r["minutes"]) for r in books.char_tree(df, "volume", "chapter").collect()}
    assert got == {(0, "a", 1): (200, 0), (0, "a", 2): (601, 2), (0, "b", 1): (1000, 2), (1, "a", None): (801, 2), (1, "b", None): (1000, 2), (2, None, None): (1801, 5)}
