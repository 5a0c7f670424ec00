"""Greedy packs across rows in which no file is one task.

Where a pack that opens at a row ends follows from running sums alone: it is the number of rows
whose end lies within `most` of the row's start, found by merging starts and ends in one sort.
That gives every row a pointer to the next pack's first row; the packs that are there are those
that can be reached from the first row, by pointer doubling in log2(packs) rounds of a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.tree import running
from quire.sources.files import stored


def packs(rows: DataFrame, file: str, order: str, size: str, most: int) -> DataFrame:
    """(file, order, batch) of rows: greedy packs of a file in `order`, each row of at least one; a row over `most` is a pack of its own.

    A null file is a file; null sizes count as one; repeated rows count each; an empty table gives none.
    """
    sized = rows.select(F.struct(F.col(file).alias("f")).alias("f"), F.col(order).alias("o"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(1)), F.lit(1)).alias("n"))
    numbered = stored(running(sized, ["f"], ["o", "n"], "n").withColumnRenamed("seq", "k").withColumnRenamed("before", "start"), "numbered")

    ends = numbered.select("f", (F.col("start") + F.col("n")).alias("at"), "k", F.lit(1).alias("ends"))
    asks = numbered.select("f", (F.col("start") + most).alias("at"), "k", F.lit(0).alias("ends"))
    merged = running(ends.unionByName(asks).withColumn("asks", 1 - F.col("ends")), ["f"], ["at", "asks", "k"], "ends")
    jump = stored(merged.where("asks = 1").select("f", "k", (F.greatest("before", "k") + 1).alias("to")), "next")

    opened = numbered.where("k = 1").select("f", "k")
    while not jump.isEmpty():
        # the first 2**i packs are known, and `jump` goes 2**i packs on; behind the last row there is nothing
        opened = stored(opened.unionByName(opened.join(jump, ["f", "k"]).select("f", F.col("to").alias("k"))), "opened")
        jump = stored(jump.join(jump.select("f", F.col("k").alias("to"), F.col("to").alias("next")), ["f", "to"]).select("f", "k", F.col("next").alias("to")), "next")

    marked = numbered.join(opened.withColumn("opens", F.lit(1)), ["f", "k"], "left").withColumn("opens", F.coalesce("opens", F.lit(0)))
    done = running(marked, ["f"], ["k"], "opens")
    return done.select(F.col("f.f").alias(file), F.col("o").alias(order), (F.col("before") + F.col("opens") - 1).cast("int").alias("batch"))
