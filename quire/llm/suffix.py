"""Substring removal by a depth-limited radix sort of byte suffixes.

Every byte that lies in a `width`-byte string which also starts earlier (in a document with a
smaller doc_id, or earlier in the same one) is removed; see `quire.llm.windows` for the
passes, which order suffixes only as deep as `width` bytes and end with the bytes themselves.

Defined cases: null and empty texts have no bytes; documents shorter than `width` lose
nothing; strings never cross documents; very long texts are read whole.  doc_id orders
documents, a null one comes first.  Rows with one doc_id and different texts are documents of
their own, in the order of a hash of their texts; equal rows count as one document, and each
gets its result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import textbytes as tb
from quire.llm import windows as win

WIDTH, GRAM, STEP = 100, 24, 10


def removed_spans(documents: DataFrame, width: int = WIDTH, gram: int | None = None, step: int | None = None) -> DataFrame:
    """doc_id, the packed text `z`, and the sorted disjoint byte spans to remove."""
    gram, step = gram or max(1, width * 24 // 100), step or max(1, width // 10)
    rows = win.identified(documents)
    texts = win.packed(rows)
    found = win.repeated(rows, texts, win.byte_units, width, gram, step, literal=True).groupBy("doc").agg(F.collect_list("at").alias("ats"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans = []
            for at in batch.column("ats"):
                low, more, _ = win._unpack(np.sort(at.values.to_numpy())) if at.is_valid else (np.zeros(0, np.int64),) * 3
                end = np.maximum.accumulate(low + more + width) if len(low) else low
                new = np.flatnonzero(np.concatenate([[True], low[1:] > end[:-1]])) if len(low) else low
                stops = end[np.append(new[1:], len(low)) - 1] if len(low) else low
                spans.append([{"start": a, "end": b} for a, b in zip(low[new].tolist(), stops.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("z"), pa.array(spans, span)], ["doc_id", "z", "spans"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return texts.join(found, "doc", "left").select("doc_id", "z", "ats").mapInArrow(run, f"doc_id {kind}, z binary, spans array<struct<start:bigint,end:bigint>>")


def cut(text: bytes, spans: list[dict]) -> tuple[bytes, int, int]:
    """The bytes that stay, how many go, and in how many runs."""
    kept, at, gone, runs = [], 0, 0, 0
    for s in spans:
        start, end = min(s["start"], len(text)), min(s["end"], len(text))
        if end > start:
            kept.append(text[at:start])
            at, gone, runs = end, gone + end - start, runs + 1
    kept.append(text[at:])
    return b"".join(kept), gone, runs


def _with_kept(spans: DataFrame, make, columns: str, kinds: list[pa.DataType]) -> DataFrame:
    names = ["doc_id", *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            cuts = batch.column("spans").to_pylist()
            for i, _, texts in win.unpacked(batch):
                for k, text in enumerate(texts):
                    for column, value in zip(out, make(text, *cut(text, cuts[i + k])), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names)
        tb.trim()

    kind = spans.schema["doc_id"].dataType.simpleString()
    return spans.mapInArrow(run, f"doc_id {kind}, {columns}")


def deduplicated(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and the bytes that stay (binary, since a cut can fall inside a character)."""
    return _with_kept(removed_spans(documents, width), lambda text, kept, gone, runs: (kept,), "kept binary", [pa.binary()])


def op1_suffix(spark, sf_dir: str) -> DataFrame:
    spans = removed_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return _with_kept(
        spans, lambda text, kept, gone, runs: (len(text), gone, runs, hashlib.sha256(kept).hexdigest()),
        "n_bytes long, n_removed long, n_spans long, kept_sha256 string", [pa.int64(), pa.int64(), pa.int64(), pa.string()],
    )
