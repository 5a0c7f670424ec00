"""Work for an external completion service as a stream that remembers attempts over restarts, an extension of `plans.complete`.

Every chunk is a key with state of its own: the prompt and the attempts that failed.  It is
asked for when it arrives and, after a failure, again when its timer rings, twice as late each
time; a finished or given-up chunk leaves one ledger entry and no state.  State and timers are
in the stream's checkpoint, so a run that is stopped or broken off goes on counting where it
was, and a wait never holds a task.

Defined cases: rows without a chunk_id are left out; a null prompt is an empty one; a chunk that
arrives again while it waits is the same chunk, after it is done it is asked for anew (leave out
what the ledger has, as `waiting` does); of several prompts for one chunk that arrive together
the smallest is asked; further columns are ignored.  What a broken-off batch had asked is asked
again, since its entries were not kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quire.operators.archive import latest, pending
from quire.plans.complete import LEDGER, Completer

#: The state store that keyed state with timers needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Attempts(StatefulProcessor):
    """One chunk: its prompt, how often it has failed, and a timer until it is asked for again."""

    def __init__(self, factory: Callable[[], Completer], most: int, delay: float) -> None:
        self.factory, self.most, self.delay = factory, most, delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.service = handle, None
        self.waiting = handle.getValueState("waiting", "prompt string, failed int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        prompts = [p for part in rows for p in part["prompt"].fillna("")]
        if not self.waiting.exists():
            yield from self._asked(key[0], min(prompts), 0, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        prompt, failed = self.waiting.get()
        yield from self._asked(key[0], prompt, failed, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        self.service = None

    def _asked(self, chunk: str, prompt: str, failed: int, now: int) -> Iterator[pd.DataFrame]:
        self.service = self.service or self.factory()
        reply = error = None
        try:
            reply = self.service.complete(prompt)
            if reply is None:
                raise ValueError("empty reply")
        except Exception as e:  # noqa: BLE001  a service fails in its own ways
            error = f"{type(e).__name__}: {e}"
            if failed + 1 < self.most:
                self.waiting.update((prompt, failed + 1))
                self.handle.registerTimer(now + int(self.delay * 1000 * 2**failed))
                return
        self.waiting.clear()
        yield pd.DataFrame({"chunk_id": [chunk], "reply": [reply], "error": [error], "attempts": pd.array([failed + 1], "int32"), "seq": [now]})


def _ticks(spark: SparkSession) -> DataFrame:
    """No rows, but a batch a second: timers are looked at in batches, and without new data there are none."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load().where("value < 0")
    return clock.select(F.lit(None).cast("string").alias("chunk_id"), F.lit(None).cast("string").alias("prompt"))


def attempted(work: DataFrame, factory: Callable[[], Completer], most: int = 3, delay: float = 3.0) -> DataFrame:
    """A ledger entry for every chunk of a stream (chunk_id, prompt) when it is done or has failed `most` times; `seq` is the time in ms."""
    keyed = work.where("chunk_id IS NOT NULL").select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("prompt").cast("string").alias("prompt"))
    return keyed.unionByName(_ticks(work.sparkSession)).groupBy("chunk_id").transformWithStateInPandas(Attempts(factory, most, delay), LEDGER, "Append", "ProcessingTime")


def waiting(work: DataFrame, ledger: DataFrame) -> DataFrame:
    """The (chunk_id, prompt) of a stream or table for which a ledger has no reply."""
    return pending(work, latest(ledger, "chunk_id").where(F.col("error").isNull()), "chunk_id")


def kept(spark: SparkSession, entries: DataFrame, folder: str, checkpoint: str, every: str = "1 second") -> StreamingQuery:
    """Start the stream of `attempted`, whose entries are appended to the ledger in `folder`; stop it and start it again as often as needed."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return entries.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
