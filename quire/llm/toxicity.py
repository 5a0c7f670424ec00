"""Toxicity by a factorization machine over hashed terms.

A document is the set of its lower-cased words, hashed to 64 bits; the model keeps the
`terms` most telling ones.  The score is sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>), so a
pair of terms can weigh more than both alone (Rendle, "Factorization Machines").
Training uses at most `most` labelled documents (documented bound) and runs full-batch Adam
on the driver over their chosen terms; scoring streams every text whole.

Defined cases: a null or empty text scores with the bias alone; without two classes of labels
the score is the share of label 1 (0.5 without any label); repeated rows are scored one by
one; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import textbytes as tb
from quire.llm.common import written
from quire.llm.labelled import fold, sample

#: ASCII that separates terms: all but digits and letters.
_GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def term_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, term hash) pairs, sorted by document."""
    data = tb.LOWER[data]
    start, end, doc = tb.words(_GAP[data], offsets)
    term = tb.mix(tb.ranged(tb.prefix(data), start, end))
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
    return doc[new], term[new]


@dataclass
class Machine:
    """Sorted term hashes with linear weights, factors and a bias."""

    terms: np.ndarray
    linear: np.ndarray
    factors: np.ndarray
    bias: float

    def logits(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, self.bias)
        if not len(self.terms) or not len(term):
            return out
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        known = self.terms[at] == term
        at, doc = at[known], doc[known]
        if not len(at):
            return out
        begins = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        rows = self.factors[at]
        sums = np.add.reduceat(rows, begins, axis=0)
        squares = np.add.reduceat((rows**2).sum(1), begins)
        out[doc[begins]] += np.add.reduceat(self.linear[at], begins) + 0.5 * ((sums**2).sum(1) - squares)
        return out


#: (document, term) pairs whose factors are held at once while fitting.
PIECE = 200_000


def _runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values begins, and its value."""
    begins = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)
    return begins, sorted_[begins]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit(doc: np.ndarray, term: np.ndarray, y: np.ndarray, *, terms: int = 4096, rank: int = 8, rounds: int = 120, rate: float = 0.05, linear_decay: float = 2e-5, factor_decay: float = 2e-5, seed: int = 7) -> Machine:
    """Fit to documents 0..len(y)-1 given as sorted distinct (document, term) pairs."""
    n, ones = len(y), float(y.sum())
    rate_of_one = ones / n if n else 0.5
    base = float(np.log((ones + 0.5) / (n - ones + 0.5))) if n else 0.0
    empty = Machine(np.zeros(0, np.uint64), np.zeros(0), np.zeros((0, rank)), float(np.log(max(rate_of_one, 1e-6) / max(1 - rate_of_one, 1e-6))))
    if ones in (0, n) or not len(term):
        return empty
    names, index, seen = np.unique(term, return_inverse=True, return_counts=True)
    with_one = np.bincount(index, y[doc], len(names))
    # how far a term's share of label 1 is from chance, in standard deviations; a smaller part by frequency keeps terms that matter only in pairs
    z = np.abs(with_one - seen * rate_of_one) / np.sqrt(seen * rate_of_one * (1 - rate_of_one) + 1e-9)
    z[seen < 3] = 0
    telling = np.argsort(-z, kind="stable")[: terms - terms // 4]
    telling = telling[z[telling] > 2.5]
    rest = np.argsort(-seen, kind="stable")
    chosen = np.unique(np.concatenate([telling, rest[seen[rest] >= 5][: terms // 4]]))
    if not len(chosen):
        return empty
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    kept = place[index] >= 0
    at, of = place[index][kept], doc[kept]
    # documents in pieces of bounded size, so that a round holds the factors of one piece at a time;
    # each piece by document for the scores, and by term for the gradients
    first = np.searchsorted(of, np.arange(n + 1))
    pieces, low = [], 0
    while low < n:
        high = min(n, max(low + 1, int(np.searchsorted(first, first[low] + PIECE, "right")) - 1))
        t, d = at[first[low] : first[high]].astype(np.int32), (of[first[low] : first[high]] - low).astype(np.int32)
        order = np.argsort(t, kind="stable")
        pieces.append((low, high, t, *_runs(d), d[order], *_runs(t[order])))
        low = high
    rng = np.random.default_rng(seed)
    w, v, b = np.zeros(len(chosen)), rng.normal(0, 0.01, (len(chosen), rank)), base
    moments = [[np.zeros_like(np.asarray(p, float)), np.zeros_like(np.asarray(p, float))] for p in (w, v, b)]
    for step in range(1, rounds + 1):
        gradient_w, gradient_v, gradient_b = linear_decay * w, factor_decay * v, 0.0
        own = 0.5 * (v**2).sum(1)
        for low, high, t, begins, docs, by_term, starts, present in pieces:
            logit, sums = np.full(high - low, b), np.zeros((high - low, rank))
            if len(t):
                sums[docs] = np.add.reduceat(v[t], begins, axis=0)
                logit[docs] += np.add.reduceat((w - own)[t], begins) + 0.5 * (sums[docs] ** 2).sum(1)
            error = (sigmoid(logit) - y[low:high]) / n
            gradient_b += error.sum()
            if len(t):
                # a term's factors are pulled by the sums of its documents without its own share
                total = np.add.reduceat(error[by_term], starts)
                gradient_w[present] += total
                gradient_v[present] += np.add.reduceat((error[:, None] * sums)[by_term], starts, axis=0) - total[:, None] * v[present]
        gradients = (gradient_w, gradient_v, gradient_b)
        new = []
        for p, g, m in zip((w, v, b), gradients, moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g**2
            new.append(p - rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8))
        w, v, b = new[0], new[1], float(new[2])
    return Machine(names[chosen], w, v, b)


def learn(documents: DataFrame, labels: DataFrame, most: int = 20_000, terms: int = 4096, **options) -> Machine:
    """Fit on at most `most` labelled documents outside the held-out fold.

    Terms are counted in Spark; the driver gets, for each document of the sample, those of its
    terms that can be among the `terms` chosen: at most twice as many, however long the texts.
    """
    rows = sample(documents, labels, "toxic", fold(5) != 0, most)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.flat(batch.column("text"))
            y = batch.column("y")
            for i, j in tb.groups(offsets):
                doc, term = term_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ends = tb.per_document(doc, j - i).astype(np.int32)
                yield pa.RecordBatch.from_arrays([y.slice(i, j - i).cast(pa.float64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(term.view(np.int64)))], ["y", "terms"])

    table = written(rows.select("text", "y").mapInArrow(cut, "y double, terms array<long>"), "terms")
    n, ones = table.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    share = ones / n if n else 0.0
    counts = table.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("seen"), F.sum("y").alias("ones")).where("seen >= 3")
    apart = F.abs(F.col("ones") - F.col("seen") * share) / F.sqrt(F.col("seen") * share * (1 - share) + 1e-9)
    best = counts.orderBy(apart.desc(), "term").limit(terms).unionByName(counts.orderBy(F.desc("seen"), "term").limit(terms))
    chosen = np.unique(best.select("term").toArrow()["term"].to_numpy())

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("terms")
            doc = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
            term = np.asarray(lists.flatten())
            kept = np.isin(term, chosen)
            ends = tb.per_document(doc[kept], batch.num_rows).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.ListArray.from_arrays(pa.array(ends), pa.array(term[kept]))], ["y", "terms"])

    found = table.mapInArrow(choose, "y double, terms array<long>").toArrow().combine_chunks()
    y = found["y"].to_numpy()
    lists = found["terms"].combine_chunks() if isinstance(found["terms"], pa.ChunkedArray) else found["terms"]
    doc = np.repeat(np.arange(len(y)), np.asarray(lists.value_lengths())) if len(y) else np.zeros(0, np.int64)
    term = np.asarray(lists.flatten()).view(np.uint64) if len(y) else np.zeros(0, np.uint64)
    return fit(doc, term, y, terms=terms, **options)


def _scores(model: Machine, column: pa.Array) -> np.ndarray:
    data, offsets = tb.flat(column)
    out = [np.zeros(0)]
    for i, j in tb.groups(offsets):
        doc, term = term_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        out.append(sigmoid(model.logits(doc, term, j - i)))
    return np.concatenate(out)


def score(documents: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(machine)  # bounded by `terms`

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(shared.value, batch.column("text")))], ["doc_id", "score"])
        tb.trim()

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def accepted(documents: DataFrame, machine: Machine, threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, that score below the threshold; all of them where the machine learned nothing."""
    if not len(machine.terms):
        return documents
    shared = documents.sparkSession.sparkContext.broadcast(machine)  # bounded by `terms`

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(shared.value, pc.struct_field(batch.column("document"), "text")) < threshold))
        tb.trim()

    whole = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("document"))  # names may hold dots
    kept = whole.mapInArrow(run, whole.schema)
    return kept.select(*(F.col(f"document.`{c}`").alias(c) for c in documents.columns))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    machine = learn(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score(documents, machine)
    return found.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
