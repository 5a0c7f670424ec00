"""Plumbing shared by the operators of this subpackage: scratch tables, joins with hot keys and graph components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH: set[tuple[object, str]] = set()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only where none is named and the master is local (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it again.

    This cuts the lineage: a lost executor costs the running stage, not everything
    before it, and no task has the only copy of a row.  The folder goes when Python ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _SCRATCH.add((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_KEPT: list[DataFrame] = []


def kept(df: DataFrame) -> DataFrame:
    """Keep a table on the executors' disks until `release`; lost blocks are made again from its plan."""
    _KEPT.append(df.persist(StorageLevel.DISK_ONLY))
    return _KEPT[-1]


def release() -> None:
    """Give back the tables from `kept`; for callers that have written the results that read them."""
    while _KEPT:
        _KEPT.pop().unpersist()


def dropped(df: DataFrame) -> None:
    """Delete the files of a table from `written` that nothing reads any more."""
    for spark, path in list(_SCRATCH):
        if any(path in file for file in df.inputFiles()[:1]):
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    _SCRATCH.discard((spark, path))


@atexit.register
def _remove_all() -> None:
    for spark, path in list(_SCRATCH):
        if getattr(spark.sparkContext, "_jsc", None) is not None:
            _remove(spark, path)


#: Rows of one key that a join leaves together, and the most keys that can be dealt (which bounds what is broadcast).
HOT_ROWS, HOT_KEYS = 1_000, 20_000


def dealt_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner", rows: int = HOT_ROWS) -> DataFrame:
    """Join `many` with `one`, which has a row a key, so that no key of `many` lands in one task.

    Keys with more than `rows` rows, of which there are at most total / rows, are dealt over as
    many cells as they have `rows` rows, and their row of `one` is repeated for each cell.  The
    list of such keys is broadcast; `rows` grows with the table where it would exceed HOT_KEYS.
    """
    counts = written(many.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > rows), "hot")
    n, total = counts.agg(F.count("*"), F.sum("_n")).first()
    if not n:
        return many.join(one, key, how)
    limit = max(rows, (total or 0) // HOT_KEYS)
    cells = F.broadcast(counts.where(F.col("_n") > limit).select(key, F.ceil(F.col("_n") / limit).cast("int").alias("_cells")))
    names = [*many.columns, *(c for c in one.columns if c != key)]
    # by the row's content, so that a task that is run again deals alike
    left = many.join(cells, key, "left").withColumn("_cell", F.coalesce(F.pmod(F.xxhash64(*many.columns), F.col("_cells")).cast("int"), F.lit(0)))
    right = one.join(cells, key, "left").withColumn("_cell", F.explode(F.sequence(F.lit(0), F.coalesce("_cells", F.lit(1)) - 1)))
    return left.drop("_cells").join(right.drop("_cells"), [key, "_cell"], how).select(*names)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest with the components of the given edges: (node, smallest node), roots left out."""
    if not len(a):
        return a, b
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while not np.array_equal(up := root[root], root):
            root = up
        if np.array_equal(before, root):
            break
        left = root[x] != root[y]
        x, y = x[left], y[left]
        if not len(x):
            break
    child = root != np.arange(len(nodes))
    return nodes[child], nodes[root[child]]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (node, component) per node that has an edge.

    Alternating large-star and small-star steps (Kiveris et al., "Connected Components in
    MapReduce and Beyond"): every step hangs neighbours on the smallest one, so hubs are
    reduced by a partial minimum and joined, never gathered.  Each round is a written table.
    """
    spark = edges.sparkSession
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = written(edges.where("a <> b").select(high.alias("u"), low.alias("v")).distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = dealt_join(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        after = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        dropped(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
