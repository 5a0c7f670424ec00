"""Order of forests in which no book, level or group of siblings is one task.

Everything is pointer doubling: after k rounds a row knows its 2**k-th ancestor and what lies
between, so a forest of depth d takes log2(d) rounds of a join, whatever its width.  Sums over
siblings in order come from ranges of a sort: each range adds up its own rows, and where a group
of siblings goes on over several ranges, the ranges before it are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.files import stored


def running(rows: DataFrame, by: list[str], order: list[str], value: str | None = None) -> DataFrame:
    """Rows with `seq`, their number from 1 in their group, and `before`, the sum of `value` (0 without one) over those ahead of them.

    `order` must tell the rows of a group apart.
    """
    names = rows.columns
    sized = rows.withColumn("_v", F.col(value).cast("long") if value else F.lit(0).cast("long"))
    ranged = stored(sized.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    ahead = Window.partitionBy("_range", *by).orderBy(*order)
    inside = ranged.withColumn("_n", F.row_number().over(ahead)).withColumn("_s", F.sum("_v").over(ahead.rowsBetween(Window.unboundedPreceding, -1)))
    totals = ranged.groupBy("_range", *by).agg(F.count("*").alias("_rows"), F.sum("_v").alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = totals.select("_range", *by, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_r0"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_s0"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ["_range", *by]]
    both = inside.alias("a").join(starts.alias("b"), same)
    return both.select(*(f"a.{c}" for c in names), (F.col("_n") + F.col("_r0")).alias("seq"), (F.coalesce("_s", F.lit(0)) + F.col("_s0")).alias("before"))


def _sizes(nodes: DataFrame, book: str, longest: int) -> DataFrame:
    """(book, node, anc, low, size) of nodes (book, node, up): the nodes below each, itself included; anc is left where the way up does not end, low then the smallest node on it."""
    state = nodes.select(book, "node", F.col("up").alias("anc"), F.col("node").alias("low"), F.lit(1).cast("long").alias("size"))
    hops = 1
    while hops < 2 * longest and not state.where("anc IS NOT NULL").isEmpty():
        # who stands `hops` below brings all that are less than `hops` below it
        more = state.where("anc IS NOT NULL").groupBy(book, F.col("anc").alias("node")).agg(F.sum("size").alias("more"))
        above = state.select(book, F.col("node").alias("anc"), F.col("anc").alias("next"), F.col("low").alias("low2"))
        both = state.join(above, [book, "anc"], "left").join(more, [book, "node"], "left")
        state = stored(both.select(book, "node", F.col("next").alias("anc"), F.least("low", "low2").alias("low"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), "sizes")
        hops *= 2
    return state


def preorder(rows: DataFrame, book: str, node: str, parent: str, number: str | None = None) -> DataFrame:
    """(book, node, place, seq) of a forest: places from 1 in the order of the tree, parents first, and numbers among siblings.

    Siblings go by `number` if all of them have one, then by node.  Nodes whose parent is null or
    not there are roots; the smallest node of a cycle of parents counts as one.  A node occurs
    once in its book.
    """
    base = rows.select(book, F.col(node).alias("node"), F.col(parent).alias("up"), (F.col(number) if number else F.lit(None)).cast("long").alias("number"))
    there = base.select(book, F.col("node").alias("up"), F.lit(True).alias("_there"))
    linked = stored(base.join(there, [book, "up"], "left").withColumn("up", F.when(F.col("_there"), F.col("up"))).drop("_there").select(book, "node", "up", "number"), "linked")
    longest = linked.groupBy(book).count().agg(F.max("count")).first()[0] or 0

    state = _sizes(linked, book, longest)
    rings = state.where("anc IS NOT NULL").select(book, F.col("anc").alias("node")).distinct()  # 2**k steps on, all are on their cycle
    heads = state.join(rings, [book, "node"]).where("node = low").select(book, "node", F.lit(True).alias("_head"))
    if not rings.isEmpty():
        linked = stored(linked.join(heads, [book, "node"], "left").withColumn("up", F.when(F.col("_head").isNull(), F.col("up"))).drop("_head").select(book, "node", "up", "number"), "linked")
        state = _sizes(linked, book, longest)

    sized = linked.join(state.select(book, "node", "size"), [book, "node"])
    listed = sized.groupBy(book, "up").agg(F.bool_and(F.col("number").isNotNull()).alias("_all"))
    same = F.col(f"a.{book}").eqNullSafe(F.col(f"b.{book}")) & F.col("a.up").eqNullSafe(F.col("b.up"))
    keyed = sized.alias("a").join(listed.alias("b"), same).select("a.*", F.when(F.col("_all"), F.col("number")).otherwise(F.lit(0).cast("long")).alias("key"))
    ordered = stored(running(keyed, [book, "up"], ["key", "node"], "size"), "siblings")

    # a place is the way from the root: at every step one, and all that stands below the siblings ahead
    way = ordered.select(book, "node", F.col("up").alias("anc"), (F.col("before") + 1).alias("place"))
    while not way.where("anc IS NOT NULL").isEmpty():
        above = way.select(book, F.col("node").alias("anc"), F.col("anc").alias("next"), F.col("place").alias("more"))
        both = way.join(above, [book, "anc"], "left")
        way = stored(both.select(book, "node", F.col("next").alias("anc"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place")), "places")
    return way.select(book, "node", "place").join(ordered.select(book, "node", "seq"), [book, "node"])
