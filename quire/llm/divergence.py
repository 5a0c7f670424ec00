"""How far the words of a source are from those of the other sources of its language.

Terms are counted in the tasks that read the documents and added up by (language, source, term).
The terms that a language keeps are sorted by their UTF-8 bytes and numbered, and each
language's dictionary is cut into chunks of consecutive numbers.  A task takes a chunk: a sorted
array of terms, in which searchsorted gives the numbers, and a bincount that gives the dense
counts of all sources of the language.  Since numbers keep the order of the bytes, ties are
broken by number.  A chunk gives its part of every sum between two sources, and its own first
`ranks` terms of every source, of which the first are taken in the end: what is shuffled after
the chunks is a row for two sources, and at most `ranks` terms a source, from each.

Everything is whole numbers: p = 1 + floor(10^9 (count + 1) / (N + V)), by long division in three
steps of a thousand, and the divergence of p from q is the sum of floor((p - q)^2 / q).

Chunks are bounded by cells (terms times sources).  What remains in one task is one language's
list of sources, which the result holds squared.

Defined cases: null texts, languages and sources are empty strings, and an empty string is a
language or source like any other; empty and very long texts are read whole; sources without
terms count as sources; a language without kept terms has pairs of value 0 and no terms;
repeated rows are documents of their own; the table may be empty; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import written
from quire.llm.textbytes import LOWER, flat, groups, table, words

#: Documents that a term needs, and terms that are listed for a source.
LEAST_DOCUMENTS, RANKS = 3, 200
SCALE = 1_000_000_000
#: Cells (terms times sources) of a chunk, and bytes of text counted at once.
CELLS, COUNTED_BYTES = 1 << 20, 1 << 23
#: Bytes between terms: all of ASCII but its letters.
GAP = table(bytes(b for b in range(128) if not chr(b).isalpha()))

_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])
_FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.binary()), ("value", pa.int64())])
_KIND = "lang string, source string, part string, item binary, value long"


def _tokens(column: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The document of every term of the texts, and the terms themselves as a dictionary."""
    data, offsets = flat(column)
    data = LOWER[data]
    gap = GAP[data]
    start, end, document = words(gap, offsets)
    bounds = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=bounds[1:])
    found = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[~gap]))])
    return document, found.dictionary_encode()


def counted(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of every term, as bytes, and the documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = flat(batch.column(2))
            for low, high in groups(offsets, COUNTED_BYTES):
                part = batch.slice(low, high - low)
                document, terms = _tokens(part.column(2))
                if not len(document):
                    continue
                group = pa.StructArray.from_arrays([part.column(0), part.column(1)], ["lang", "source"])
                keys: dict[tuple[str, str], int] = {}
                of = np.array([keys.setdefault((g["lang"], g["source"]), len(keys)) for g in group.to_pylist()])
                size = len(terms.dictionary)
                pairs, times = np.unique(document * size + terms.indices.to_numpy(), return_counts=True)
                cells, cell = np.unique(of[pairs // size] * size + pairs % size, return_inverse=True)
                lang, source = (pa.array([k[i] for k in keys]).take(pa.array(cells // size)) for i in (0, 1))
                term = pc.cast(terms.dictionary.take(pa.array(cells % size)), pa.binary())
                n, docs = np.bincount(cell, times).astype(np.int64), np.bincount(cell)
                yield pa.RecordBatch.from_arrays([lang, source, term, pa.array(n), pa.array(docs)], schema=_COUNTED)

    parts = _read(documents).mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _read(documents: DataFrame) -> DataFrame:
    return documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def dictionary(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, uses, id): kept terms with their counts by source; ids are dense from 0 in a language and in the order of the bytes.

    Ranges of a sort over all tasks are numbered by themselves; where a range begins in the
    language comes from the sizes of the ranges, a row a range and language.
    """
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("uses")).where(F.col("docs") >= least)
    ranged = kept.select("lang", "term", "uses").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    numbered = written(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.spark_partition_id()), "dictionary")
    ranges = numbered.groupBy("lang", "range").agg(F.min("at").alias("low"), F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.select("lang", "range", (before - F.col("low")).alias("shift"))
    return numbered.join(starts, ["lang", "range"]).select("lang", "term", "uses", (F.col("at") + F.col("shift")).alias("id"))


def _shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total), exact for totals below 9 * 10^15."""
    rest, out = counts + 1, np.zeros_like(counts)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def _chunk(lang: str, terms: np.ndarray, sources: list[str], counts: np.ndarray, kept: int, totals: np.ndarray, ranks: int) -> Iterator[pa.RecordBatch]:
    """What a chunk gives: sums between sources and its first terms; `counts` has a row a source."""
    own = _shares(counts, totals[:, None] + kept)
    all_sources = _shares(counts.sum(0), totals.sum() + kept)
    names = pa.array(sources)
    items = pc.cast(names, pa.binary())
    for k, p in enumerate(own):
        value = ((p - own) * (p - own) // own).sum(1)  # 0 without terms
        other = np.flatnonzero(np.arange(len(sources)) != k)
        yield _rows(lang, sources[k], "pair", items.take(pa.array(other)), value[other])
        over = np.flatnonzero((counts[k] > 0) & (p > all_sources))
        value = (p[over] - all_sources[over]) ** 2 // all_sources[over]
        first = np.lexsort((over, -value))[:ranks]
        yield _rows(lang, sources[k], "term", pa.array(terms[over[first]].tolist(), pa.binary()), value[first])


def _rows(lang: str, source: str, part: str, item: pa.Array, value: np.ndarray) -> pa.RecordBatch:
    same = [pa.array([x]).take(pa.array(np.zeros(len(item), np.int64))) for x in (lang, source, part)]
    return pa.RecordBatch.from_arrays([*same, item, pa.array(value.astype(np.int64))], schema=_FOUND)


def divergences(documents: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = RANKS, cells: int = CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank) of every source: all others of its language by divergence, and its own first terms."""
    counts = written(counted(documents), "counted")
    kept = written(dictionary(counts, least), "kept")
    used = kept.select("lang", F.explode("uses").alias("u")).groupBy("lang", "u.source").agg(F.sum("u.n").alias("total"))
    groups_ = _read(documents).select("lang", "source").distinct().join(used, ["lang", "source"], "left").na.fill(0, ["total"])
    sizes = groups_.groupBy("lang").agg(F.count("*").alias("n_sources")).join(kept.groupBy("lang").agg(F.count("*").alias("kept")), "lang", "left").na.fill(0, ["kept"])
    sizes = written(sizes.withColumn("width", F.greatest(F.lit(1), F.lit(cells) / F.col("n_sources")).cast("long")), "sizes")
    at = lambda c: F.floor(c / F.col("width")).cast("long")
    chunked = kept.join(sizes, "lang").select("lang", at(F.col("id")).alias("chunk"), "term", F.explode("uses").alias("u")).select("lang", "chunk", "term", "u.source", "u.n")
    # every language has a chunk, if an empty one
    last = at(F.greatest(F.col("kept") - 1, F.lit(0)))
    lists = groups_.join(sizes, "lang").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"), "source", "total", "kept")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return _FOUND.empty_table()
        named = sorted(zip(right["source"].to_pylist(), right["total"].to_pylist(), strict=True))
        place = {source: k for k, (source, _) in enumerate(named)}
        found = np.array(left["term"].to_pylist(), object)
        terms = np.array(sorted(set(found.tolist())), object)
        ids = np.searchsorted(terms, found) if len(terms) else np.zeros(0, np.int64)
        rows = np.array([place[s] for s in left["source"].to_pylist()], np.int64)
        counts = np.bincount(rows * len(terms) + ids, left["n"].to_numpy(), len(named) * len(terms)).astype(np.int64)
        totals = np.array([total for _, total in named], np.int64)
        parts = _chunk(right["lang"][0].as_py(), terms, [s for s, _ in named], counts.reshape(len(named), len(terms)), right["kept"][0].as_py(), totals, ranks)
        return pa.Table.from_batches(parts, _FOUND)

    found = chunked.groupBy("lang", "chunk").cogroup(lists.groupBy("lang", "chunk")).applyInArrow(run, _KIND)
    # a term stands in one chunk: its sum is its value
    values = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = values.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= ranks))
    return ranked.select("lang", "source", "part", F.col("item").cast("string").alias("item"), "value", F.col("rank").cast("int").alias("rank"))


def op12_divergence(spark, sf_dir: str) -> DataFrame:
    return divergences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
