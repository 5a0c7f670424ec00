"""Embedding near-duplicates with a forest of random-projection trees.

Equal vectors form one class.  Every tree splits the classes recursively: a level has a few
random directions, a node takes one of them and a threshold near its middle, where fewest of its
members are near it, and vectors within the spill margin of the threshold go down both sides.
Trees grow in rounds: the first is fitted on a bounded sample of all classes, and while leaves
hold more than `SLACK` times `leaf` classes, each of these is split on by a subtree that is
fitted on a bounded sample of its own members, with directions of its own.  A leaf that no
direction splits stays as it is.  So leaves stay small however many vectors there are, and only
ids travel until the leaves are final.

Vectors that meet in a leaf of any tree are compared in double precision; a pair that meets in
several leaves is counted in the first of them only.  Links of classes give components.

The margin is `SPILL` times the distance that a pair at the link threshold has on a random
direction, so it does not shrink with the data: what lies within link distance of itself stays
together and a leaf can be as large as such a cluster.  Leaves beyond `BLOCK` classes are dealt as pairs of
blocks over many tasks; no pair is left out.

Defined cases: vectors that are null, empty, zero, or have null or non-finite components link
with nothing (n_links 0, component_id their own vec_id); vectors of different length do not
link; equal vectors link with each other; repeated vec_ids are rows of their own; rows with a
null vec_id are linked and counted like others and name no component, theirs is null if no other
is in it.  Labels and further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import textbytes as tb
from quire.llm.common import components, dealt_join, dropped, forest, written

#: Classes on which the first round of a tree and each later subtree are fitted; every vector is indexed.
FIT_SAMPLE, REFIT_SAMPLE = 16_384, 2_048
TREES = 4
LEAF, SLACK = 128, 3
#: Share of the link distance within which a vector goes down both sides; directions of a level, and places of a threshold.
SPILL, CHOICES, PLACES = 0.3, 4, (0.5, 0.4, 0.6, 0.3, 0.7)
#: Levels of a round, and directions that may pass without a split before it gives up.
LEVELS, PASSES = 12, 4
BLOCK = 2048
#: Leaves of more than BLOCK classes, by the bound on their number, up to which their list is broadcast.
BROADCAST_LEAVES = 100_000


def _matrix(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.float64) for x in column.to_pylist()]


def vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, digest and the vector as doubles in bytes; digest and vector are null where nothing can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, values = [], []
            for x in batch.column("embedding"):
                v = None
                if x.is_valid and len(x.values) and not x.values.null_count:
                    v = x.values.cast(pa.float64()).to_numpy() + 0.0
                    v = v if np.isfinite(v).all() and v.any() else None
                values.append(None if v is None else v.tobytes())
                digests.append(None if v is None else hashlib.blake2b(v.tobytes(), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(digests, pa.binary()), pa.array(values, pa.binary())], ["vec_id", "digest", "vec"])

    kind = embeddings.schema["vec_id"].dataType.simpleString()
    return embeddings.select("vec_id", F.col("embedding").cast("array<double>")).mapInArrow(run, f"vec_id {kind}, digest binary, vec binary")


@dataclass
class Tree:
    """Thresholds and directions of the nodes of a (sub)tree: NaN marks a leaf, infinity a level that does not split the node."""

    seed: int
    depth: int
    margin: float
    thresholds: np.ndarray
    chosen: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, total: int, margin: float, leaf: int, seed: int) -> Tree:
        """For `total` rows of which unit vectors `sample` are some."""
        depth = min(LEVELS, int(np.ceil(np.log2(max(1, total) / leaf))) + PASSES) if total > leaf else 0
        out = cls(seed, depth, margin, np.full(1 << depth, np.nan), np.zeros(1 << depth, np.int64))
        projected = sample @ out.directions(sample.shape[1])
        members = {1: np.arange(len(sample))}
        for level in range(depth):
            after = {}
            for node, rows in members.items():
                if len(rows) * total <= leaf * len(sample) or len(rows) < 8:
                    continue
                p = projected[rows, level * CHOICES : (level + 1) * CHOICES]
                wide = np.flatnonzero(p.std(0) >= 3 * margin)
                if not len(wide):
                    out.thresholds[node] = np.inf
                    after[2 * node] = rows
                    continue
                cuts = np.quantile(p[:, wide], PLACES, axis=0)
                near = (np.abs(p[:, None, wide] - cuts) <= margin).mean(0) + 0.1 * np.abs(np.array(PLACES) - 0.5)[:, None]
                place, k = np.unravel_index(near.argmin(), near.shape)
                cut, p = float(cuts[place, k]), p[:, wide[k]]
                out.thresholds[node], out.chosen[node] = cut, wide[k]
                after[2 * node] = rows[p <= cut + margin]
                after[2 * node + 1] = rows[p >= cut - margin]
            members = after
        return out

    def directions(self, width: int) -> np.ndarray:
        x = np.random.default_rng(self.seed & 0xFFFFFFFF).normal(size=(width, max(1, self.depth * CHOICES)))
        return x / np.linalg.norm(x, axis=0)

    @property
    def splits(self) -> bool:
        return bool(np.isfinite(self.thresholds).any())

    def pack(self) -> bytes:
        return np.array([self.seed, self.depth], np.int64).tobytes() + np.array([self.margin]).tobytes() + self.thresholds.tobytes() + self.chosen.tobytes()

    @classmethod
    def unpack(cls, raw: bytes) -> Tree:
        seed, depth = np.frombuffer(raw, np.int64, 2).tolist()
        return cls(seed, depth, float(np.frombuffer(raw, np.float64, 1, 16)[0]), np.frombuffer(raw, np.float64, 1 << depth, 24), np.frombuffer(raw, np.int64, 1 << depth, 24 + (8 << depth)))

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs, a row in one leaf at least; leaves are named by a hash of seed and node."""
        projected = x @ self.directions(x.shape[1])
        rows, nodes = np.arange(len(x)), np.ones(len(x), np.int64)
        rows_out, nodes_out = [], []
        for level in range(self.depth):
            cut = self.thresholds[nodes]
            done = np.isnan(cut)
            rows_out.append(rows[done])
            nodes_out.append(nodes[done])
            rows, nodes, cut = rows[~done], nodes[~done], cut[~done]
            p = projected[rows, level * CHOICES + self.chosen[nodes]]
            left, right = p <= cut + self.margin, p >= cut - self.margin
            rows, nodes = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * nodes[left], 2 * nodes[right] + 1])
        rows, nodes = np.concatenate([*rows_out, rows]), np.concatenate([*nodes_out, nodes])
        salt = tb.mix(np.array([self.seed], np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        return rows, tb.mix(nodes.astype(np.uint64) ^ salt).view(np.int64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _compare(unit: np.ndarray, side: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of rows (i < j) of one leaf; of a cell of two blocks, pairs across alone."""
    a, b = [], []
    left = np.flatnonzero(side <= 0)
    right = np.flatnonzero(side == 1) if (side == 1).any() else left
    same = right is left
    for k in range(0, len(left), 512):
        rows = left[k : k + 512]
        cols = right[k:] if same else right
        i, j = np.nonzero(unit[rows] @ unit[cols].T >= cosine)
        i, j = rows[i], cols[j]
        if same:
            i, j = i[i < j], j[i < j]
        a.append(i)
        b.append(j)
    return (np.concatenate(a), np.concatenate(b)) if a else (left, left)


def _first_meeting(leaves: pa.ListArray, a: np.ndarray, b: np.ndarray, here: int) -> np.ndarray:
    """Whether `here` is the smallest leaf that both rows of a pair are in, given the leaves of every row."""
    row = np.repeat(np.arange(len(leaves)), leaves.value_lengths().to_numpy())
    values = leaves.flatten().to_numpy()
    smaller = values < here
    names, at = np.unique(values[smaller], return_inverse=True)
    words = max(1, -(-len(names) // 64))
    member = np.zeros((len(leaves), words), np.uint64)  # a bit for each smaller leaf
    np.bitwise_or.at(member, (row[smaller], at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
    out = np.zeros(len(a), bool)
    for k in range(0, len(a), 1 << 17):
        out[k : k + (1 << 17)] = ~(member[a[k : k + (1 << 17)]] & member[b[k : k + (1 << 17)]]).any(1)
    return out


def placed(classes: DataFrame, width: int, cosine: float, trees: int, leaf: int, fit_sample: int, refit_sample: int) -> DataFrame:
    """(id, leaf): every class in a leaf at least of every tree, from classes (id, vec) of one width."""
    total = classes.count()
    margin = SPILL * np.sqrt(2 - 2 * cosine) / np.sqrt(max(1, width))
    chosen = classes.orderBy(F.xxhash64("id"), "id").limit(fit_sample).select("vec").toArrow()["vec"]
    sample = _unit(np.stack(_matrix(chosen)))
    shared = classes.sparkSession.sparkContext.broadcast([Tree.fit(sample, total, margin, leaf, -1 - t) for t in range(trees)])  # thresholds, 2 ** LEVELS a tree

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, x = batch.column("id").to_numpy(), _unit(np.stack(_matrix(batch.column("vec"))))
                for tree in shared.value:
                    rows, names = tree.leaves(x)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(names), pa.array(np.ones(len(rows), bool))], ["id", "leaf", "open"])

    now = written(classes.select("id", "vec").mapInArrow(grow, "id long, leaf long, open boolean"), "leaves")
    while True:
        large = written(now.where("open").groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > SLACK * leaf), "large")
        if large.isEmpty():
            return now.select("id", "leaf")
        after = written(_split(classes, now, large, margin, leaf, refit_sample), "leaves")
        dropped(now)
        now = after


def _split(classes: DataFrame, now: DataFrame, large: DataFrame, margin: float, leaf: int, refit_sample: int) -> DataFrame:
    """The leaves after a round: members of large ones in the leaves of a subtree of their own, or closed where nothing splits them."""
    inside = now.where("open").join(large, "leaf")
    share = F.pmod(F.xxhash64("id", "leaf"), F.lit(1 << 30)) < F.lit(float(refit_sample)) / F.col("n") * F.lit(float(1 << 30))
    vectors_ = classes.select("id", "vec")

    def fit(table: pa.Table) -> pa.Table:
        name, n = table["leaf"][0].as_py(), table["n"][0].as_py()
        tree = Tree.fit(_unit(np.stack(_matrix(table["vec"]))), n, margin, leaf, name)
        return pa.table({"leaf": pa.array([name], pa.int64()), "tree": pa.array([tree.pack() if tree.splits else b""], pa.binary())})

    # about refit_sample rows a leaf
    fitted = written(inside.where(share).join(vectors_, "id").groupBy("leaf").applyInArrow(fit, "leaf long, tree binary"), "trees")
    # a task gets a subtree and then members; large leaves are dealt over cells, each with the subtree
    cells = F.ceil(F.col("n") / BLOCK).cast("long")
    first = fitted.join(large, "leaf").select("leaf", "tree", F.explode(F.sequence(F.lit(0).cast("long"), cells - 1)).alias("k"))
    first = first.select(F.xxhash64("leaf", "k").alias("cell"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), "leaf", F.col("tree").alias("body"))
    then = inside.join(vectors_, "id").select(F.xxhash64("leaf", F.pmod(F.xxhash64("id"), cells)).alias("cell"), F.lit(1).alias("kind"), "id", "leaf", F.col("vec").alias("body"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, tree = None, None
        for batch in batches:
            here = batch.column("cell").to_numpy()
            begins = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]])) if batch.num_rows else []
            for i, j in zip(begins, [*begins[1:], batch.num_rows], strict=True):
                part = batch.slice(int(i), int(j - i))
                if here[i] != cell:
                    cell, tree = here[i], None
                if part.column("kind")[0].as_py() == 0:
                    raw = part.column("body")[0].as_py()
                    tree = Tree.unpack(raw) if raw else None
                    part = part.slice(1)
                if not part.num_rows:
                    continue
                ids = part.column("id").to_numpy()
                if tree is None:
                    rows, names = np.arange(len(ids)), part.column("leaf").to_numpy()
                else:
                    rows, names = tree.leaves(_unit(np.stack(_matrix(part.column("body")))))
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(names), pa.array(np.full(len(rows), tree is not None))], ["id", "leaf", "open"])

    moved = first.unionByName(then).repartition("cell").sortWithinPartitions("cell", "kind").mapInArrow(route, "id long, leaf long, open boolean")
    return now.join(large.select("leaf", F.lit(True).alias("open")), ["leaf", "open"], "left_anti").select("id", "leaf", "open").unionByName(moved)


def links(classes: DataFrame, cosine: float = 0.95, trees: int = TREES, leaf: int = LEAF, fit_sample: int = FIT_SAMPLE, refit_sample: int = REFIT_SAMPLE) -> DataFrame:
    """From classes (id, n, vec): rows (a, b, n) where b null gives linked vectors counted for class a, n null a link that joins a and b."""
    spark = classes.sparkSession
    sizes = [r["d"] for r in classes.select((F.octet_length("vec") / 8).cast("int").alias("d")).distinct().collect()]  # the lengths of vectors
    out = None
    for width in sorted(sizes):
        of_width = classes.where(F.octet_length("vec") == width * 8)
        found = _met(of_width, placed(of_width, width, cosine, trees, leaf, fit_sample, refit_sample), cosine)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "a long, b long, n long")


def _met(classes: DataFrame, leaves: DataFrame, cosine: float) -> DataFrame:
    members = classes.select("id", "n", "vec").join(leaves.groupBy("id").agg(F.sort_array(F.collect_list("leaf")).alias("leaves")), "id")
    sizes = leaves.groupBy("leaf").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK).select("leaf", F.ceil(F.col("m") / BLOCK).cast("long").alias("blocks"))
    sized = leaves.join(F.broadcast(sizes) if leaves.count() <= BLOCK * BROADCAST_LEAVES else sizes, "leaf", "left")
    own = F.pmod(F.xxhash64("id"), "blocks")
    cell = lambda q: F.struct(F.xxhash64("leaf", F.least(own, q), F.greatest(own, q)).alias("cell"), F.when(own == q, -1).otherwise((own > q).cast("int")).alias("side"))
    blocks = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), cell)
    dealt = sized.where("blocks IS NULL").select("id", "leaf", F.col("leaf").alias("cell"), F.lit(-1).alias("side")).unionByName(
        sized.where("blocks IS NOT NULL").select("id", "leaf", F.explode(blocks).alias("c")).select("id", "leaf", "c.cell", "c.side")
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(group: pa.Table) -> pa.RecordBatch | None:
            group = group.combine_chunks()
            ids, n = group["id"].to_numpy(), group["n"].to_numpy()
            if len(ids) < 2:
                return None
            unit = _unit(np.stack(_matrix(group["vec"])))
            a, b = _compare(unit, group["side"].to_numpy(), cosine)
            if not len(a):
                return None
            once = _first_meeting(group["leaves"].combine_chunks(), a, b, int(group["leaf"][0].as_py()))
            counted = np.bincount(a[once], n[b[once]], len(ids)) + np.bincount(b[once], n[a[once]], len(ids))
            child, root = forest(ids[a], ids[b])
            with_links = np.flatnonzero(counted)
            none = [None]
            return pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([ids[with_links], child])),
                pa.array(none * len(with_links) + root.tolist(), pa.int64()),
                pa.array(counted[with_links].astype(np.int64).tolist() + none * len(child), pa.int64()),
            ], ["a", "b", "n"])

        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            piece = pa.Table.from_batches([batch])
            rest = piece if rest is None else pa.concat_tables([rest, piece])
            cell = rest["cell"].to_numpy()
            begins = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            for i, j in zip(begins[:-1], begins[1:], strict=True):
                if (out := linked(rest.slice(i, j - i))) is not None:
                    yield out
            rest = rest.slice(begins[-1])
        if rest is not None and (out := linked(rest)) is not None:
            yield out

    return dealt.join(members, "id").repartition("cell").sortWithinPartitions("cell").mapInArrow(meet, "a long, b long, n long")


def near_duplicates(embeddings: DataFrame, cosine: float = 0.95, **options) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding)."""
    rows = written(vectors(embeddings), "vectors")
    classes = written(
        rows.where(F.col("digest").isNotNull()).groupBy("digest")
        .agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("vec").alias("vec")).withColumn("id", F.monotonically_increasing_id()),
        "classes",
    )
    found = written(links(classes.select("id", "n", "vec"), cosine, **options), "links")
    counted = found.where("n is not null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("linked"))
    label = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "id")
    linked = written(classes.select("id", "digest", "least", "n").join(counted, "id", "left").join(label, "id", "left").withColumn("n_links", F.col("n") - 1 + F.coalesce("linked", F.lit(0))), "classes")
    bound = linked.where("component IS NOT NULL")
    named = dealt_join(bound, bound.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("digest", "n_links", "component_id")
    named = named.unionByName(linked.where("component IS NULL").select("digest", "n_links", F.col("least").alias("component_id")))
    able = dealt_join(rows.where("digest IS NOT NULL").select("vec_id", "digest"), written(named, "classes"), "digest").select("vec_id", "n_links", "component_id")
    out = able.unionByName(rows.where("digest IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op8_embedding(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
