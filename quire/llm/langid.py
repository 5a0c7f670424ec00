"""Language identification with bit-sliced Bloom filters of n-grams.

One Bloom filter per learned language, stored side by side: slot s of the table is a mask
with one bit per language, so a single lookup (the AND of a few slots) answers which
languages contain an n-gram.  A document's n-grams give one popcount per language; the
counts are corrected for the filters' false positives and the largest decides.

A language's filter holds the byte n-grams (lower-cased letters, other ASCII as blanks)
found in at least `min_share` of its training documents and at least half as often as in
the language where they are most frequent.  Since shares add up to the n-grams of a mean
document, this bounds every filter whatever the corpus size.  Training documents are chosen by
a hash of the id, about `max_train_docs` in all in equal parts a language, but `least` of each
at least (documented bound); prediction reads every text whole.  A slot has a plane of 64 bits
for every 64 languages.

Defined cases: a null text, or one without a letter, is `und` with score 0; a text whose
n-grams are all unknown gets the most frequent training language with score 0; without any
training row every text with a letter is `und`.  Ties go to the more frequent language, then
to the smaller name.  Repeated rows are predicted one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import textbytes as tb
from quire.llm.labelled import fold

GRAMS = (3, 4)
PROBES = 3
UNKNOWN = "und"

_LETTER = tb.table(bytes([*range(65, 91), *range(97, 123)]))
#: Letters lower-cased, bytes of other alphabets kept, all else blank.
_FOLD = np.where(_LETTER | (np.arange(256) >= 128), tb.LOWER, np.uint8(32)).astype(np.uint8)


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: hashes of all n-grams that lie inside one document, and the document of each."""
    n = len(data)
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    folded = _FOLD[data].astype(np.uint64)
    for width in GRAMS:
        if n < width:
            continue
        packed = folded[: n - width + 1].copy()
        for k in range(1, width):
            packed = (packed << np.uint64(8)) | folded[k : n - width + 1 + k]
        inside = doc[: n - width + 1] == doc[width - 1 :]
        yield packed[inside] | np.uint64(width << 56), doc[: n - width + 1][inside]


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any alphabet."""
    begins = offsets[:-1]
    full = np.diff(offsets) > 0
    out, high = np.zeros(len(begins), bool), np.zeros(len(begins), bool)
    if full.any():
        out[full] = np.logical_or.reduceat(_LETTER[data], begins[full])
        high[full] = np.logical_or.reduceat(data >= 128, begins[full])
    for i in np.flatnonzero(high & ~out):
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


@dataclass
class Filters:
    """Learned languages in order of preference, planes of slot masks (64 languages each) and each language's false-positive rate."""

    languages: list[str]
    planes: list[np.ndarray]
    false_rate: np.ndarray

    @classmethod
    def build(cls, languages: list[str], packed: np.ndarray, masks: np.ndarray, bits_per_gram: int = 16) -> Filters:
        """From n-grams and their masks, one column of 64 languages each."""
        size = 1 << max(10, int(np.ceil(np.log2(max(1, len(packed)) * bits_per_gram))))
        planes, fill = [], []
        for k in range(0, len(languages), 64):
            count = min(64, len(languages) - k)
            slots = np.zeros(size, f"uint{next(w for w in (8, 16, 32, 64) if count <= w)}")
            for at in cls._places(packed, size):
                np.bitwise_or.at(slots, at, masks[:, k // 64].astype(slots.dtype))
            planes.append(slots)
            fill += [(slots >> slots.dtype.type(b) & slots.dtype.type(1)).mean() for b in range(count)]
        return cls(languages, planes, np.array(fill) ** PROBES)

    @staticmethod
    def _places(packed: np.ndarray, size: int) -> Iterator[np.ndarray]:
        h = tb.mix(packed)
        for k in range(PROBES):
            yield ((h >> np.uint64(k * 21)) & np.uint64(size - 1)).astype(np.int64) if size <= 1 << 21 else (tb.mix(h + np.uint64(k)) & np.uint64(size - 1)).astype(np.int64)

    def lookup(self, packed: np.ndarray) -> list[np.ndarray]:
        """For each plane the languages that contain each n-gram."""
        found: list[np.ndarray] = []
        size = len(self.planes[0]) if self.planes else 1
        for at in self._places(packed, size):
            found = [p[at] & f for p, f in zip(self.planes, found, strict=True)] if found else [p[at] for p in self.planes]
        return found

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language of each text (-1: none) and its score."""
        n, width = len(offsets) - 1, len(self.languages)
        hits, total = np.zeros((n, width)), np.zeros(n)
        for packed, doc in grams(data, offsets):
            if not len(packed):
                continue
            found = self.lookup(packed)
            begins = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            total[doc[begins]] += np.diff(np.append(begins, len(doc)))
            for k in range(width):
                plane = found[k // 64]
                bit = (plane >> plane.dtype.type(k % 64) & plane.dtype.type(1)).astype(np.uint8)
                hits[doc[begins], k] += np.add.reduceat(bit, begins, dtype=np.int64)
        if not width:
            return np.full(n, -1), np.zeros(n)
        true = np.maximum(0.0, (hits - total[:, None] * self.false_rate) / np.maximum(1e-9, 1 - self.false_rate))
        best = true.argmax(1)
        whole = true.sum(1)
        score = np.divide(true[np.arange(n), best], whole, out=np.zeros(n), where=whole > 0)
        letters = has_letter(data, offsets)
        return np.where(letters, best, -1), np.where(letters, score, 0.0)


def learn(documents: DataFrame, eligible: Column, max_train_docs: int = 20_000, min_share: float = 0.02, least: int = 200) -> Filters:
    """Filters from about `max_train_docs` of the eligible rows of (doc_id, text, lang).

    Each language gives an equal part of them, but `least` rows at least and all if it has no
    more, so that a rare one is learned too.
    """
    rows = documents.where(eligible & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not sizes:
        return Filters.build([], np.zeros(0, np.uint64), np.zeros((0, 0), np.uint64))
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))
    each = max(least, max_train_docs // len(languages))
    within = F.element_at(F.lit([min(1 << 53, (each << 53) // sizes[x]) for x in languages]), F.array_position(F.lit(languages), F.col("lang")).cast("int"))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 53)) < within)
    sizes = {x: 0 for x in languages} | {r["lang"]: r["n"] for r in chosen.groupBy("lang").agg(F.count("*").alias("n")).collect()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.flat(batch.column("text"))
            lang = np.array([languages.index(x) if x in sizes else -1 for x in batch.column("lang").to_pylist()], np.int64)
            for i, j in tb.groups(offsets):
                of, key = [], []
                for packed, doc in grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                    new = np.unique(tb.mix(packed) ^ tb.mix(doc.astype(np.uint64)), return_index=True)[1]
                    key.append(packed[new])
                    of.append(lang[i:j][doc[new]])
                if not key:
                    continue
                key, of = np.concatenate(key), np.concatenate(of)
                order = np.lexsort((of, key))
                key, of = key[order], of[order]
                begins = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])]))
                n = np.diff(np.append(begins, len(key)))
                yield pa.RecordBatch.from_arrays([pa.array(of[begins].astype(np.int32)), pa.array(key[begins].view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counted = chosen.select("text", "lang").mapInArrow(count, "lang int, gram long, n long").where("lang >= 0").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    size = F.element_at(F.lit([float(max(1, sizes[x])) for x in languages]).cast("array<double>"), F.col("lang") + 1)
    shares = counted.withColumn("share", F.col("n") / size).where(F.col("share") >= min_share).groupBy("gram").agg(F.collect_list(F.struct("lang", "share")).alias("s"))
    own = "filter(s, x -> x.share * 2 >= array_max(transform(s, y -> y.share)))"
    planes = ", ".join(f"aggregate(filter({own}, x -> x.lang div 64 = {k}), 0L, (m, x) -> m | shiftleft(1L, x.lang % 64))" for k in range((len(languages) + 63) // 64))
    kept = shares.select("gram", F.expr(f"array({planes})").alias("masks")).toArrow()  # bounded: each text of the sample has few n-grams, and one counts from min_share on
    masks = np.asarray(kept["masks"].combine_chunks().flatten()).view(np.uint64) if kept.num_rows else np.zeros(0, np.uint64)
    return Filters.build(languages, kept["gram"].to_numpy().view(np.uint64), masks.reshape(-1, (len(languages) + 63) // 64))


def identify(documents: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred and score of every row of (doc_id, text)."""
    shared = documents.sparkSession.sparkContext.broadcast(filters)  # bounded by min_share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        names = np.array([*known.languages, UNKNOWN], object)
        for batch in batches:
            data, offsets = tb.flat(batch.column("text"))
            best, score = [np.zeros(0, np.int64)], [np.zeros(0)]
            for i, j in tb.groups(offsets):
                b, s = known.predict(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                best.append(b)
                score.append(s)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[np.concatenate(best)], pa.string()), pa.array(np.concatenate(score))], ["doc_id", "lang_pred", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def op2_langid(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    filters = learn(documents, fold(4) != 2)
    found = identify(documents, filters)
    return found.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
