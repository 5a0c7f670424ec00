"""Attempts of a stream are counted over restarts, waits are timers, and finished chunks leave no state."""

import os
import time

import pytest

from quire.plans.complete import LEDGER
from quire.streaming import retries

WORK = "chunk_id string, prompt string, other int"


def service(log, good_from=99):
    class Fake:
        def complete(self, prompt):
            with open(log, "a") as f:
                f.write(prompt + "\n")
            with open(log) as f:
                n = f.read().splitlines().count(prompt)
            if prompt.startswith("bad") or n < good_from and prompt.startswith("late"):
                raise RuntimeError("no")
            return prompt.upper()

    return Fake


def calls(log):
    return sorted(open(log).read().split("\n")[:-1]) if os.path.exists(log) else []


def until(check, query, seconds=60):
    end = time.monotonic() + seconds
    while not check() and time.monotonic() < end:
        if query.exception() is not None:
            raise query.exception()
        time.sleep(0.2)
    assert check()


def passed(query):
    """The batch that was under way is committed."""
    seen = query.lastProgress["batchId"] if query.lastProgress else -1
    until(lambda: query.lastProgress and query.lastProgress["batchId"] > seen, query)


@pytest.fixture
def stream(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    work, ledger, log = (str(tmp_path / x) for x in ("work", "ledger", "log"))
    spark.createDataFrame([], WORK).write.parquet(work)

    def start(**options):
        entries = retries.attempted(spark.readStream.schema(WORK).parquet(work), service(log, 2), **options)
        return retries.kept(spark, entries, ledger, str(tmp_path / "checkpoint"), "300 milliseconds")

    yield work, ledger, log, start
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_three_attempts_a_chunk_over_two_restarts(spark, stream):
    work, ledger, log, start = stream

    def read():
        return {r["chunk_id"]: (r["reply"], r["error"], r["attempts"]) for r in spark.read.schema(LEDGER).parquet(ledger).collect()}

    rows = [("a", "bad a", 1), ("b", "fine", 2), ("b", "fine", 3), ("c", "late", 4), (None, "lost", 5), ("d", None, 6)]
    spark.createDataFrame(rows, WORK).coalesce(1).write.mode("append").parquet(work)

    query = start(most=3, delay=8)
    until(lambda: len(calls(log)) >= 4, query)
    passed(query)
    query.stop()
    assert calls(log).count("bad a") < 3 and "a" not in read()

    query = start(most=3, delay=8)
    until(lambda: "c" in read(), query)
    passed(query)
    query.stop()
    assert "a" not in read()

    query = start(most=3, delay=8)
    until(lambda: "a" in read(), query)
    spark.createDataFrame([("e", "more", 7)], WORK).coalesce(1).write.mode("append").parquet(work)
    until(lambda: "e" in read(), query)
    until(lambda: query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0, query)
    query.stop()
    assert read() == {"a": (None, "RuntimeError: no", 3), "b": ("FINE", None, 1), "c": ("LATE", None, 2), "d": ("", None, 1), "e": ("MORE", None, 1)}
    assert calls(log) == ["", "bad a", "bad a", "bad a", "fine", "late", "late", "more"]


def test_what_the_ledger_has_is_not_asked_again(spark):
    work = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "chunk_id string, prompt string")
    ledger = spark.createDataFrame([("a", "r", None, 1, 5), ("b", None, "e", 3, 5)], LEDGER)
    assert sorted(r["chunk_id"] for r in retries.waiting(work, ledger).collect()) == ["b", "c"]
    assert retries.waiting(work.where("false"), ledger).count() == 0
