"""Quality by Bradley-Terry ranking of documents.

Every document has a few measured features and the shares of its words in buckets of hashed
words; a linear strength is learned from preference
pairs (a document labelled 1 is preferred to one labelled 0) by logistic loss on feature
differences, and strengths become decisions at a quantile: the share of label 0 among the
training documents.  The strength at that quantile maps to 0.3, so score >= 0.3 keeps the
documents above it.  Each preferred document meets `rivals` others, so pairs grow with the
sample and never with its square.  The sample has at most `most` labelled documents
(documented bound); every text is measured whole.

Defined cases: null and empty texts have all features zero and still score; without two
classes of labels the score is the share of label 1 (0.5 without labels); repeated rows are
scored one by one; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import textbytes as tb
from quire.llm.labelled import fold, sample
from quire.llm.toxicity import sigmoid

_CLASSES = {
    "upper": tb.table(bytes(range(65, 91))),
    "lower": tb.table(bytes(range(97, 123))),
    "digit": tb.table(bytes(range(48, 58))),
    "space": tb.SPACE,
    "line": tb.table(b"\n"),
    "stop": tb.table(b".!?"),
    "comma": tb.table(b",;:"),
    "shout": tb.table(b"!"),
    "mark": tb.table(b"#$%&*+=<>@^_`{|}~\\/[]()"),
    "bar": tb.table(b"|"),
    "high": np.arange(256) >= 128,
}
NAMES = (*(f"share_{k}" for k in _CLASSES), "log_bytes", "log_words", "word_bytes", "long_words", "short_words", "distinct_words", "repeated_next", "log_line_words", "single_marks", "capital_words", "shouted_words")
#: Further features: shares of the words of a text in so many buckets of hashed words.
BUCKETS = 64
COLUMNS = (*NAMES, *(f"words_{k}" for k in range(BUCKETS)))


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of COLUMNS per document, in bounded units; zeros for an empty text."""
    n = len(offsets) - 1
    out = np.zeros((n, len(COLUMNS)))
    size = np.diff(offsets)
    full = np.flatnonzero(size > 0)
    if not len(full):
        return out
    begins = offsets[full]
    for k, member in enumerate(_CLASSES.values()):
        out[full, k] = np.add.reduceat(member[data], begins, dtype=np.int64) / size[full]
    lines = out[:, 4] * size + 1
    at = len(_CLASSES)
    out[full, at] = np.log1p(size[full]) / 10
    start, end, doc = tb.words(tb.SPACE[data], offsets)
    if len(start):
        first = tb.per_document(doc, n)
        count = np.diff(first)
        has = np.flatnonzero(count > 0)
        total = lambda x: np.add.reduceat(x, first[has], dtype=float)
        length = end - start
        term = tb.mix(tb.ranged(tb.prefix(tb.LOWER[data]), start, end))
        same = np.zeros(len(term), bool)
        same[1:] = (term[1:] == term[:-1]) & (doc[1:] == doc[:-1])
        order = np.lexsort((term, doc))
        new = np.ones(len(term), bool)
        new[1:] = (term[order][1:] != term[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        words = count[has].astype(float)
        upper = _CLASSES["upper"][data]
        last_mark = _CLASSES["mark"][data[end - 1]] | _CLASSES["shout"][data[end - 1]]
        columns = (
            np.log1p(words) / 10, total(length) / words / 10, total(length > 12) / words, total(length < 3) / words,
            total(new) / words, total(same) / words, np.log1p(words / lines[has]) / 10, total(last_mark) / words,
            total(upper[start]) / words, total(upper[start] & upper[np.minimum(start + 1, end - 1)] & (length > 1)) / words,
        )
        for k, x in enumerate(columns):
            out[has, at + 1 + k] = x
        held = np.bincount(doc * BUCKETS + (term % np.uint64(BUCKETS)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS)
        out[has, len(NAMES) :] = held[has] / words[:, None]
    return out


@dataclass
class Ranking:
    """Standardisation, weights, and the map from strengths to scores."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float
    constant: float | None = None

    def strength(self, x: np.ndarray) -> np.ndarray:
        return _expand((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return sigmoid(self.slope * (self.strength(x) - self.threshold) + np.log(0.3 / 0.7))


def _expand(z: np.ndarray) -> np.ndarray:
    """Standardised features, and the magnitudes of measured ones, so that both too little and too much can count."""
    z = np.clip(z, -6, 6)
    return np.concatenate([z, np.abs(z[:, : len(NAMES)])], 1)


def fit(x: np.ndarray, y: np.ndarray, *, rivals: int = 4, rounds: int = 300, rate: float = 0.05, decay: float = 1e-4, word_decay: float = 0.03, seed: int = 11) -> Ranking:
    """Learn from feature rows and labels 0/1; words count where they tell much, which their decay sees to."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    width = x.shape[1]
    if not len(good) or not len(bad):
        return Ranking(np.zeros(width), np.ones(width), np.zeros(width + len(NAMES)), 0.0, 1.0, float(y.mean()) if len(y) else 0.5)
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1
    z = _expand((x - mean) / scale)
    rng = np.random.default_rng(seed)
    difference = z[np.repeat(good, rivals)] - z[rng.choice(bad, len(good) * rivals)]
    w, m, s = np.zeros(z.shape[1]), np.zeros(z.shape[1]), np.zeros(z.shape[1])
    decays = np.full(z.shape[1], decay)
    decays[len(NAMES) : width] = word_decay
    for step in range(1, rounds + 1):
        g = -(difference.T @ sigmoid(-(difference @ w))) / len(difference) + decays * w
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g**2
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    strength = z @ w
    threshold = float(np.quantile(strength, len(bad) / len(y)))
    gap = float(np.median(strength[good]) - np.median(strength[bad]))
    return Ranking(mean, scale, w, threshold, 6.0 / max(abs(gap), 1e-6))


def learn(documents: DataFrame, labels: DataFrame, most: int = 20_000, **options) -> Ranking:
    """Fit on at most `most` labelled documents outside the held-out fold."""
    rows = sample(documents, labels, "quality", fold(5) != 0, most)
    found = measured(rows, "y double", lambda batch: [batch.column("y").cast(pa.float64())]).toArrow()
    x = np.stack([found[name].to_numpy() for name in COLUMNS], 1) if found.num_rows else np.zeros((0, len(COLUMNS)))
    return fit(x, found["y"].to_numpy(), **options)


def measured(rows: DataFrame, carried: str, carry) -> DataFrame:
    """The features of every row after the columns that `carry` takes from a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.flat(batch.column("text"))
            x = np.concatenate([np.zeros((0, len(COLUMNS))), *(features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in tb.groups(offsets))])
            kept = carry(batch)
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x[:, k]) for k in range(len(COLUMNS)))], [*(c.split()[0] for c in carried.split(", ")), *COLUMNS])

    return rows.mapInArrow(run, ", ".join([carried, *(f"{n} double" for n in COLUMNS)]))


def score(documents: DataFrame, ranking: Ranking) -> DataFrame:
    """doc_id and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.flat(batch.column("text"))
            out = [np.zeros(0), *(ranking.score(features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) for i, j in tb.groups(offsets))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(out))], ["doc_id", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op5_quality(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ranking = learn(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score(documents, ranking)
    return found.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
