"""SimHash near-duplicates by the generalised pigeonhole principle.

`fingerprints` makes one 64-bit majority fingerprint per document, `linked` finds the
connected classes of fingerprints that differ in at most `distance` bits.

If the 64 bits are cut into parts and part i gets a threshold t_i with
sum(t_i + 1) = distance + 1, then two fingerprints within `distance` differ in at most
t_i bits on some part i.  Correlated bits share a part, so that the parts filter
independently, and the thresholds come from a dynamic program over estimated costs
(rows probed plus candidates compared).  For t_i > 0 a part is probed through its
wildcard keys: the part with every choice of t_i bits blanked.  The sample behind the
estimates steers cost alone; every fingerprint is probed and every candidate verified.

Buckets are counted over all rows and large ones dealt as pairs of blocks; fingerprints and
components with many rows are dealt over cells (`common.dealt_join`).

Defined cases: a null or wordless text has the fingerprint zero and links like any other;
repeated rows and equal texts share a fingerprint; rows that share a doc_id are fingerprinted,
linked and kept or dropped one by one; rows with a null doc_id get a fingerprint, take part in
linking, never name a component unless it has no other id (then null), and are never dropped;
very long texts are hashed whole.  Columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import textbytes as tb
from quire.llm.common import components, dealt_join, forest, written

BITS = 64
#: Fingerprints that estimate the costs of a plan; results do not depend on them.
PLAN_SAMPLE = 4096
#: Members of a bucket that one task compares; larger buckets are dealt as pairs of blocks.
BLOCK = 4096
#: Large buckets, by the bound on their number, up to which their list is broadcast.
HOT_BUCKETS = 100_000


def _texts_to_fingerprints(data: np.ndarray, offsets: np.ndarray, width: int, seed: int) -> np.ndarray:
    n = len(offsets) - 1
    out = np.zeros(n, np.uint64)
    data = tb.LOWER[data]
    gap = tb.SPACE[data]
    start, end, doc = tb.words(gap, offsets)
    if not len(start):
        return out
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]  # one separator after each word
    data = data.copy()
    data[gap] = 0x20
    place = np.cumsum(keep)
    text = data[keep].tobytes()
    start, end = place[start] - 1, place[end - 1]
    first = tb.per_document(doc, n)
    count = np.diff(first)
    whole = np.flatnonzero(doc[: len(doc) - width + 1] == doc[width - 1 :]) if len(doc) >= width else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < width))
    s = np.concatenate([start[whole], start[first[short]]])
    e = np.concatenate([end[whole + width - 1], end[first[short + 1] - 1]])
    of = np.concatenate([doc[whole], short])
    order = np.argsort(of, kind="stable")
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[a:b], seed) for a, b in zip(s[order].tolist(), e[order].tolist(), strict=True)), np.uint64, len(s))
    of = of[order]
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    begins = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    ones = np.add.reduceat(bits, begins, axis=0, dtype=np.int32)
    total = np.diff(np.append(begins, len(of)))
    major = np.packbits((ones * 2 > total[:, None]).astype(np.uint8), axis=1, bitorder="little")
    out[of[begins]] = major.view(np.uint64).ravel()
    return out


def fingerprints(documents: DataFrame, width: int = 4, seed: int = 42, carry: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """doc_id and its fingerprint (a long with the same 64 bits): majority bits of the XXH64 of word shingles; further columns on demand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.flat(batch.column("text"))
            parts = [_texts_to_fingerprints(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width, seed) for i, j in tb.groups(offsets)]
            values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64)), *(batch.column(c) for c in carry)], ["doc_id", "fp", *carry])
        tb.trim()

    kinds = [f"{c} {documents.schema[c].dataType.simpleString()}" for c in ("doc_id", *carry)]
    return documents.select("doc_id", "text", *carry).mapInArrow(run, ", ".join([kinds[0], "fp long", *kinds[1:]]))


@dataclass(frozen=True)
class Plan:
    """Parts as bit masks with their thresholds, and the masks under which keys are taken."""

    parts: tuple[tuple[int, int], ...]
    cost: float

    def masks(self) -> list[int]:
        out = []
        for mask, threshold in self.parts:
            if threshold >= 0:
                bits = [b for b in range(BITS) if mask >> b & 1]
                out += [mask & ~sum(1 << b for b in blank) for blank in itertools.combinations(bits, threshold)]
        return out


def _parts(correlation: np.ndarray, count: int) -> list[list[int]]:
    """Bits dealt into `count` parts of nearly equal size, each grown around its most correlated bits."""
    free, parts = set(range(BITS)), []
    for k in range(count):
        size = len(free) // (count - k)
        best = max(free, key=lambda b: max((correlation[b, c] for c in free if c != b), default=0.0))
        part = [best]
        free.discard(best)
        while len(part) < size:
            nxt = max(sorted(free), key=lambda b: sum(correlation[b, c] for c in part))
            part.append(nxt)
            free.discard(nxt)
        parts.append(sorted(part))
    return parts


def plan(sample: np.ndarray, total: int, distance: int) -> Plan:
    """Cheapest partition and thresholds for `total` fingerprints, from the pair distances in a sample."""
    sample = sample[:2048]
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float) if len(sample) else np.zeros((1, BITS))
    centred = bits - bits.mean(0)
    scale = np.sqrt((centred**2).sum(0))
    scale[scale == 0] = 1
    correlation = np.abs((centred.T @ centred) / np.outer(scale, scale))
    other = sample[:, None] ^ sample[None, :512]
    best = None
    for count in range(2, distance + 2):
        parts = _parts(correlation, count)
        masks = [sum(1 << b for b in part) for part in parts]
        costs: list[list[float]] = []
        for part, mask in zip(parts, masks, strict=True):
            apart = np.bitwise_count(other & np.uint64(mask))
            row = [0.0]
            for t in range(distance + 1):
                even = sum(math.comb(len(part), i) for i in range(t + 1)) / 2 ** len(part)
                seen = float((apart <= t).mean()) if apart.size else 0.0
                keys = math.comb(len(part), t) if t <= len(part) else math.inf
                # a probed row costs about as much as a hundred comparisons
                row.append(100.0 * total * keys + total * total / 2 * max(even, seen - 1 / max(1, len(sample))) * (1 + t))
            costs.append(row)
        table: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for row in costs:
            after: dict[int, tuple[float, tuple[int, ...]]] = {}
            for spent, (cost, chosen) in table.items():
                for t in range(-1, distance - spent + 1):
                    new = (cost + row[t + 1], (*chosen, t))
                    at = spent + t + 1
                    if at <= distance + 1 and (at not in after or new < after[at]):
                        after[at] = new
            table = after
        cost, chosen = table[distance + 1]
        if best is None or cost < best.cost:
            best = Plan(tuple(zip(masks, chosen, strict=True)), cost)
    return best


def _pairs_within(keys: np.ndarray, values: np.ndarray, distance: int, dense: int = 96) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect whatever is linked inside each run of equal keys; not all links of a large run."""
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(begins, len(keys)))
    a, b = [], []
    run = np.repeat(np.arange(len(begins)), sizes)
    small = sizes <= dense
    at = np.flatnonzero(small[run] & (sizes[run] > 1))
    ends = (begins + sizes)[run]
    step = 1
    while len(at):
        at = at[at + step < ends[at]]
        near = at[np.bitwise_count(values[at] ^ values[at + step]) <= distance]
        a.append(values[near])
        b.append(values[near + step])
        step += 1
    for k in np.flatnonzero(~small):
        left = np.unique(values[begins[k] : begins[k] + sizes[k]])
        while len(left):
            frontier, left = left[:1], left[1:]
            while len(frontier) and len(left):
                block = frontier[:64]
                frontier = frontier[64:]
                close = np.bitwise_count(block[:, None] ^ left[None, :]) <= distance
                hit = close.any(0)
                if hit.any():
                    a.append(block[close[:, hit].argmax(0)])
                    b.append(left[hit])
                    frontier = np.concatenate([frontier, left[hit]])
                    left = left[~hit]
    if not a:
        return values[:0], values[:0]
    return np.concatenate(a), np.concatenate(b)


def linked(classes: DataFrame, distance: int = 4) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp` that join exactly what links of at most `distance` bits join."""
    total = classes.count()
    sample = classes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(PLAN_SAMPLE).toArrow()["fp"].to_numpy().view(np.uint64)
    masks = plan(sample, total, distance).masks()
    salts = [np.uint64(int(x)) for x in tb.mix(np.arange(1, len(masks) + 1, dtype=np.uint64))]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for salt, mask in zip(salts, masks, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(tb.mix((fp & np.uint64(mask)) ^ salt).view(np.int64)), pa.array(fp.view(np.int64))], ["key", "fp"])

    probes = classes.select("fp").mapInArrow(probe, "key long, fp long")
    # every bucket is counted: one of more than BLOCK rows is dealt as pairs of blocks, any two rows of it meet in one cell
    large = written(probes.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "buckets")
    if not large.isEmpty():
        blocks = large.select("key", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks"))  # at most len(masks) * total / BLOCK rows
        sized = probes.join(F.broadcast(blocks) if len(masks) * total <= BLOCK * HOT_BUCKETS else blocks, "key", "left")
        own = F.pmod(F.xxhash64("fp"), "blocks")
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda q: F.xxhash64("key", F.least(own, q), F.greatest(own, q)))
        plain = sized.where("blocks IS NULL").select("key", "fp")
        probes = plain.unionByName(sized.where("blocks IS NOT NULL").select(F.explode(pairs).alias("key"), "fp"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(k: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            x, y = forest(*_pairs_within(k, v, distance)) if len(k) else (v, v)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
            values = np.concatenate([values, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if cut > 50_000:
                yield out(keys[:cut], values[:cut])
                keys, values = keys[cut:], values[cut:]
        yield out(keys, values)
        tb.trim()

    return probes.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long").distinct()


def near_duplicates(documents: DataFrame, distance: int = 4, width: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links between fingerprints."""
    prints = written(fingerprints(documents, width, seed), "fingerprints")
    return _named(prints, distance).select("doc_id", "fp", "component_id")


def _named(prints: DataFrame, distance: int) -> DataFrame:
    """Rows (fp, doc_id and others) with the component_id of their fingerprint."""
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    label = components(linked(classes, distance)).withColumnRenamed("node", "fp")
    # a class without links names itself; the others take the least id of their component
    joined = classes.join(label, "fp", "left")
    bound = written(joined.where("component IS NOT NULL"), "classes")
    least = bound.groupBy("component").agg(F.min("least").alias("component_id"))
    named = dealt_join(bound, least, "component").select("fp", "component_id").unionByName(joined.where("component IS NULL").select("fp", F.col("least").alias("component_id")))
    return dealt_join(prints, written(named, "classes"), "fp")


def deduplicated(documents: DataFrame, distance: int = 4, width: int = 4) -> DataFrame:
    """The rows that do not go: of every group those with its smallest doc_id stay.

    A row goes where its own fingerprint is in a group with a smaller doc_id, whatever other rows
    share its doc_id.  Rows without an id stay, and so do repeated rows with the smallest id.
    """
    hashed = documents.select("doc_id", "text", F.xxhash64("text").alias("_h"))
    prints = written(fingerprints(hashed, width, carry=["_h"]), "fingerprints")
    found = _named(prints.where("doc_id IS NOT NULL"), distance)
    gone = written(found.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("_id"), "_h").distinct(), "copies")
    # rows of one id and equal hash have equal texts but for a collision of 64 bits under one id
    same = (F.col("d.doc_id") == F.col("g._id")) & (F.xxhash64("d.text") == F.col("g._h"))
    return documents.alias("d").join(gone.alias("g"), same, "left_anti")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
