"""Substring removal by repeated-phrase automata.

Words in windows of `width` words that also start earlier are removed.

1. Recurring windows are found by digests (`quire.llm.windows`) and joined to passages, each
   with the place of an earlier occurrence.
2. The passages are confirmed on the text: their words are read from that occurrence.  Distinct
   passages are the phrases.
3. Phrases are dealt to shards of about `SHARD_WORDS` words, and each shard is compiled into an
   Aho-Corasick automaton, over an alphabet with one character per distinct word.
4. Documents are streamed whole through the automata, which locate every occurrence.  A document
   skips the shards none of whose phrases recurs in it by the digests; those would find nothing.
   A shard that many documents need is repeated over cells of `CELL_DOCS` of them.
5. An occurrence that starts later than the phrase's own place is removed, so nothing is removed
   on the word of a digest.

Defined cases: null, empty and blank texts have no words; documents of fewer than `width` words
lose nothing; windows never cross documents; very long texts are read whole.  doc_id orders
documents, a null one comes first.  Rows with one doc_id and different texts are documents of
their own, and equal rows count as one, as in `quire.llm.suffix`.  Other columns are kept by
`deduplicated` whatever their names, and ignored otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import textbytes as tb
from quire.llm import windows as win
from quire.llm.common import dealt_join, written

WIDTH = 20
#: Words of the phrases of one automaton, words of a first document whose phrases share a shard, and documents that one task streams.
SHARD_WORDS, STRETCH, CELL_DOCS = 1 << 19, 1 << 16, 20_000
#: Shards up to which their table is broadcast.
BROADCAST_SHARDS = 1_000_000


def passages(repeats: DataFrame, width: int) -> DataFrame:
    """doc and its recurring passages (doc0, low0, size in words): runs of windows that repeat a run elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for doc, group in zip(batch.column("doc").to_pylist(), batch.column("rows"), strict=True):
                rows = group.values
                (low, more, _), (low0, _, _) = win._unpack(rows.field("at").to_numpy()), win._unpack(rows.field("at0").to_numpy())
                doc0 = rows.field("doc0").to_numpy()
                order = np.lexsort((low, low - low0, doc0))
                low, more, low0, doc0 = low[order], more[order], low0[order], doc0[order]
                apart = (doc0[1:] != doc0[:-1]) | (low[1:] - low0[1:] != low[:-1] - low0[:-1])
                new = np.flatnonzero(np.concatenate([[True], apart | (low[1:] > low[:-1] + more[:-1] + 1)]))
                end = np.maximum.reduceat(low + more + width, new)
                for column, value in zip(out, (np.full(len(new), doc), doc0[new], low0[new], end - low[new]), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *c]).astype(np.int64)) for c in out], ["doc", "doc0", "low0", "size"])
        tb.trim()

    grouped = repeats.groupBy("doc").agg(F.collect_list(F.struct("at", "doc0", "at0")).alias("rows"))
    return grouped.mapInArrow(run, "doc long, doc0 long, low0 long, size long")


def worded(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """The words, joined by one space, of distinct passages (doc0, low0, size)."""
    lists = wanted.distinct().groupBy(F.col("doc0").alias("doc")).agg(F.collect_list(F.struct("low0", "size")).alias("cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, cuts = batch.column("doc").to_pylist(), batch.column("cuts").to_pylist()
            for i, j, raw in win.unpacked(batch):
                out = []
                for k in range(i, j):
                    words = raw[k - i].split()
                    out += [(doc[k], c["low0"], c["size"], b" ".join(words[c["low0"] : c["low0"] + c["size"]])) for c in cuts[k]]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 4, kinds, strict=True)], ["doc0", "low0", "size", "phrase"])
        tb.trim()

    return texts.join(lists, "doc").select("doc", "z", "cuts").mapInArrow(run, "doc0 long, low0 long, size long, phrase binary")


class Alphabet:
    """Characters for words: one each, or two from disjoint ranges where words are too many; the first is for unknown words."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def ids(self, words: list[bytes]) -> list[int]:
        known = self.known
        return [known.setdefault(w, len(known) + 1) for w in words]

    def look_up(self, words: list[bytes]) -> list[int]:
        known = self.known
        return [known.get(w, 0) for w in words]

    @property
    def letters(self) -> int:
        return 1 if len(self.known) < 1_000_000 else 2

    def spell(self, ids: list[int]) -> str:
        x = np.array(ids, np.uint32)
        if self.letters == 1:
            return (x + 1 + 0x800 * (x >= 0xD7FF)).astype("<u4").tobytes().decode("utf-32-le")
        return np.stack([0x20000 + (x >> 14), 0x1000 + (x & 16383)], 1).astype("<u4").tobytes().decode("utf-32-le")


class Locator:
    """An automaton of phrases, each with the smallest place (document, word) that it is given with."""

    def __init__(self, phrases: list[tuple[int, int, bytes]]) -> None:
        places: dict[bytes, tuple[int, int]] = {}
        for doc0, low0, phrase in phrases:
            places[phrase] = min(places.get(phrase, (doc0, low0)), (doc0, low0))
        self.alphabet = Alphabet()
        keys = [(self.alphabet.ids(p.split(b" ")), place) for p, place in places.items()]
        self.automaton = ahocorasick.Automaton()
        for key, place in keys:
            self.automaton.add_word(self.alphabet.spell(key), (len(key), place))
        self.automaton.make_automaton()

    def later(self, doc: int, words: list[bytes]) -> list[tuple[int, int]]:
        """Sorted disjoint runs of words in occurrences that start later than the phrase's place."""
        letters = self.alphabet.letters
        runs: list[list[int]] = []
        for at, (size, place) in self.automaton.iter(self.alphabet.spell(self.alphabet.look_up(words))):
            end = (at + 1) // letters
            if (doc, end - size) > place:
                low = end - size  # ends come in order, beginnings may not
                while runs and runs[-1][1] >= low:
                    low = min(low, runs.pop()[0])
                runs.append([low, end])
        return [(a, b) for a, b in runs]


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell and kind, phrases (kind 0) before compressed documents (kind 1): the runs (doc, low, high) found."""
    open_ = zstandard.ZstdDecompressor()
    cell, phrases, locator = None, [], None
    for batch in batches:
        out: list[tuple[int, int, int]] = []
        for here, kind, doc, low, body in zip(*(batch.column(c).to_pylist() for c in ("cell", "kind", "doc", "low", "body")), strict=True):
            if here != cell:
                cell, phrases, locator = here, [], None
            if kind == 0:
                phrases.append((doc, low, body))
                continue
            if locator is None:
                locator = Locator(phrases)
                phrases = []
            out += [(doc, a, b) for a, b in locator.later(doc, open_.decompress(body).split())]
        columns = list(zip(*out, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc", "low", "high"])
    del phrases, locator
    tb.trim()


def occurrences(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc, runs): the words to remove from each document of `wanted` (doc, doc0, low0, size), located by automata."""
    place = ["doc0", "low0", "size"]
    total = wanted.select(*place).distinct().agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // SHARD_WORDS))
    shard = F.pmod(F.xxhash64("doc0", F.floor(F.col("low0") / STRETCH)), F.lit(shards))
    routes = wanted.select("doc", shard.alias("shard")).distinct()
    cells = routes.groupBy("shard").agg(F.ceil(F.count("*") / CELL_DOCS).cast("long").alias("cells"))
    phrases = worded(wanted.select(*place), texts).withColumn("shard", shard)
    if shards <= BROADCAST_SHARDS:
        cells = F.broadcast(cells)
        routed, phrases = routes.join(cells, "shard"), phrases.join(cells, "shard")
    else:
        cells = written(cells, "shards")
        routed, phrases = dealt_join(routes, cells, "shard"), dealt_join(phrases, cells, "shard")
    own = routed.select("doc", F.xxhash64("shard", F.pmod(F.xxhash64("doc"), "cells")).alias("cell"))
    copies = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1), lambda k: F.xxhash64("shard", k)))
    first = phrases.select(copies.alias("cell"), F.lit(0).alias("kind"), F.col("doc0").alias("doc"), F.col("low0").alias("low"), F.col("phrase").alias("body"))
    then = texts.join(own, "doc").select("cell", F.lit(1).alias("kind"), "doc", F.lit(0).cast("long").alias("low"), F.col("z").alias("body"))
    runs = first.unionByName(then).repartition("cell").sortWithinPartitions("cell", "kind").mapInArrow(streamed, "doc long, low long, high long")
    return runs.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("low", "high"))).alias("runs"))


def located(documents: DataFrame, width: int = WIDTH, gram: int | None = None, step: int | None = None, carry: bool = False) -> DataFrame:
    """doc_id, doc, z and the sorted runs (low, high) of words to remove, null for none; `rest` on demand."""
    gram, step = gram or max(1, width // 5), step or max(1, width // 6)
    rows = win.identified(documents)
    texts = win.packed(rows, carry)
    wanted = written(passages(win.repeated(rows, texts, win.word_units, width, gram, step), width), "passages")
    return texts.join(occurrences(wanted, texts), "doc", "left").select("doc_id", "doc", "z", "runs", *(["rest"] if carry else []))


def _applied(found: DataFrame, make, columns: str, kinds: list[pa.DataType]) -> DataFrame:
    """Apply make(words, removed mask, text) to every document."""
    carried = [c for c in found.columns if c == "rest"]
    names = ["doc_id", *carried, *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            lists = batch.column("runs").to_pylist()
            for i, _, raw in win.unpacked(batch):
                for k, text in enumerate(raw):
                    words = text.split()
                    mask = np.zeros(len(words), bool)
                    for r in lists[i + k] or ():
                        mask[r["low"] : r["high"]] = True
                    for column, value in zip(out, make(words, mask, text), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(c) for c in carried), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names)
            del out, lists
        tb.trim()

    schema = T.StructType([found.schema[c] for c in ("doc_id", *carried)])
    for c in columns.split(", "):
        schema = schema.add(*c.split())
    return found.mapInArrow(run, schema)


def _kept(words: list[bytes], mask: np.ndarray) -> bytes:
    return b" ".join([w for w, gone in zip(words, mask.tolist(), strict=True) if not gone] if mask.any() else words)


def cut(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """(document, n_removed): the documents as structs, repeated passages cut out of their texts.

    A text that loses nothing stays as it is; of any other the words that stay are joined by one space.
    """

    def make(words: list[bytes], mask: np.ndarray, text: bytes) -> tuple[str, int]:
        return (_kept(words, mask) if mask.any() else text).decode("utf-8", "replace"), int(mask.sum())

    found = _applied(located(documents, width, carry=True), make, "kept string, n_removed long", [pa.string(), pa.int64()])
    own = {"doc_id": F.col("doc_id"), "text": F.col("kept")}
    return found.select(F.struct(*(own.get(c, F.col(f"rest.`{c}`")).alias(c) for c in documents.columns)).alias("document"), "n_removed")


def deduplicated(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents of `cut`, and n_removed; for tables without a column of that name."""
    return cut(documents, width).select("document.*", "n_removed")


def op7_phrases(spark, sf_dir: str) -> DataFrame:
    found = located(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return _applied(
        found, lambda w, m, text: (len(w), int(m.sum()), hashlib.sha256(_kept(w, m)).hexdigest()),
        "n_words long, n_removed long, kept_sha256 string", [pa.int64(), pa.int64(), pa.string()],
    )
