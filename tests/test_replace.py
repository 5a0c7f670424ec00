"""Replacement by one automaton against the alternation of all terms."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.functions import replace
from quire.operators import terms


def by_pattern(text, pairs):
    table = {}
    for source, target in pairs:
        if source:
            table.setdefault(source, target)
    if not table:
        return text, {}
    counts = {}

    def put(m):
        counts[m[0]] = counts.get(m[0], 0) + 1
        return table[m[0]]

    return re.sub("|".join(map(re.escape, sorted(table, key=lambda s: (-len(s), s)))), put, text), counts


WORDS = st.text("abc漢👍.|", max_size=5)


@settings(max_examples=1500, deadline=None)
@given(st.text("abc漢👍.| ", max_size=40), st.lists(st.tuples(WORDS, WORDS), max_size=8))
def test_the_longest_term_at_the_leftmost_place_is_replaced(text, pairs):
    assert replace.Replacer(pairs).counted(text) == by_pattern(text, pairs)


def test_fifty_thousand_terms_cost_a_reading_of_the_text():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("가나다라마바사아자차카타파하") for _ in range(rng.randint(2, 6)))
    pairs = [(word(), str(k)) for k in range(50_000)]
    text = " ".join(word() for _ in range(40_000))
    replacer = replace.Replacer(pairs)
    began = time.perf_counter()
    got = replacer.counted(text)
    took = time.perf_counter() - began
    short = text[:400]
    assert replacer.counted(short) == by_pattern(short, pairs)
    assert sum(got[1].values()) > 1000 and took < 5


def test_columns_and_counts(spark):
    pairs = [("ab", "X"), ("abc", "YY"), ("b", ""), ("ab", "never")]
    rows = spark.createDataFrame([(1, "abcab b", ["ab", None]), (2, None, None), (3, "", [])], "k int, text string, list array<string>")
    got = rows.select("k", replace.one_pass(rows.text, pairs).alias("t"), replace.one_pass_each(rows.list, pairs).alias("l")).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, "YYX ", ["X", None]), (2, None, None), (3, "", [])]
    assert sorted(map(tuple, replace.replacements(rows, "k", pairs).collect())) == [(1, "ab", "X", 1), (1, "abc", "YY", 1), (1, "b", "", 1)]
    assert replace.replacements(rows, "k", []).count() == 0
    assert rows.select(replace.one_pass(rows.text, [("", "x")]).alias("t")).first()["t"] == "abcab b"


def test_a_glossary_beyond_its_bound_is_refused(monkeypatch):
    monkeypatch.setattr(replace, "GLOSSARY_CHARS", 10)
    with pytest.raises(ValueError, match="12 characters"):
        replace.Replacer([("abcdef", "ghijkl")])


def test_short_names_count_outside_of_full_names_alone(spark):
    texts = spark.createDataFrame([("최범진은 왔다",), ("범진아 와라",), ("김철수가 봤다",), (None,), ("a.b의",)], "text string")
    asked = spark.createDataFrame([("최범진", "범진"), ("김철수", "철수"), ("a.b", "b"), ("김철수", "")], "person string, ko string")
    found = terms.said_outside(asked.where("ko <> ''"), texts)
    assert [tuple(r) for r in found.collect()] == [("최범진", "범진")]
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    assert terms.said_outside(asked.limit(0), texts).collect() == []
