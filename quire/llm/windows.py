"""Repeated windows of a corpus, found by most-significant-digit passes over its suffixes.

A window is the first `width` units (bytes or words) of a suffix of one document.  The task is
to find every window whose content also starts earlier (smaller document, or same document and
smaller position).  Suffixes are ordered no deeper than `width`, pass by pass; a pass extends
the digits of the one before, and a group that has shrunk to one member is left alone:

1. Depth `gram`, over sampled suffixes: those at the gram of smallest hash in some window
   (leftmost on ties).  Equal windows sample the same place, and neighbouring windows mostly
   share it, so one suffix stands for a run of windows.
2. Depth `width - step + 1`, over the last suffix of every block of `step` windows around a
   place that was not alone: what all windows of the block have in common.
3. Depth `width`, over every suffix that is left.  Bytes are dealt and sorted by themselves, so
   that equal groups are exactly the repeated windows; words by two independent digests, and
   `quire.llm.phrases` confirms them on the text.

In the first two passes the digits are 64-bit digests: they only tell what is surely alone.  A
row there also has two independent 64-bit digests of everything its windows cover.  Rows equal
in both are equal windows one by one: all but the first are settled at once, and rows that
repeat within a task are settled before the shuffle, so copies cost a row a task and not a row
a copy.

A digit that many different rows of a task share is surely not alone: its first row goes to the
digit's group and vouches for it, the others are dealt by their whole content, so that a common
line is no group of one task.

State between passes is a table in the shared folder.  Texts are dealt by document once,
compressed, and kept on disk for the passes; lost blocks are made again from the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import textbytes as tb
from quire.llm.common import kept, written

#: Order of rows without an id: before all others.
NO_ID = -(1 << 63)
#: Rows among which a task settles repetitions before they are shuffled.
LOCAL_ROWS = 1 << 20
#: Bytes of texts that are unpacked at once.
UNPACKED = 4 << 20

#: Rows with a window's bytes that a task holds.
LOCAL_WINDOWS = 1 << 18
#: Different rows of a digit in a task from which on they are dealt by their content.
HOT_VARIANTS = 64

#: (bytes, offsets) of a group of documents -> two unit codes, and the offsets of each document's units
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def byte_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tb.BYTE_CODES[0][data], tb.BYTE_CODES[1][data], offsets


def word_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start, end, doc = tb.words(tb.SPACE[data], offsets)
    size = (end - start).astype(np.uint64)
    code, other = (tb.mix(tb.ranged(tb.prefix_of(lane[data]), start, end) + size) for lane in tb.BYTE_CODES)
    return code, other, tb.per_document(doc, len(offsets) - 1)


def _pack(low: np.ndarray, more: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """First window, windows after it, and units from there to the gram in one integer."""
    return (low << 24) | (more << 12) | lead


def _unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 24, (at >> 12) & 4095, at & 4095


def _digest(sums: np.ndarray, start: np.ndarray, end: np.ndarray, salt: np.ndarray) -> np.ndarray:
    return tb.mix(tb.ranged(sums, start, end) ^ tb.mix(salt.astype(np.uint64) + np.uint64(0x51ED270B)))


def sampled(codes: np.ndarray, others: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Pass 1 rows of a group of documents: key, sub, sub2, document index, at (positions from the document's start)."""
    n = len(codes)
    none = np.zeros(0, np.int64)
    nothing = (*(none.view(np.uint64),) * 3, none, none)
    if n < width:
        return nothing
    sums = tb.prefix_of(codes)
    every = np.arange(n - gram + 1)
    grams = tb.mix((sums[gram:] - sums[:-gram]) * tb.powers(n + 1, inverse=True)[: n - gram + 1])
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | every.astype(np.uint64)
    span, reach = 1, width - gram + 1
    while span * 2 <= reach:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    m = n - width + 1
    place = (np.minimum(least[:m], least[reach - span : reach - span + m]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    edge = np.zeros(m + 1, np.int32)
    fits = np.flatnonzero(np.diff(offsets) >= width)
    np.add.at(edge, offsets[fits], 1)
    np.add.at(edge, offsets[fits + 1] - width + 1, -1)
    window = np.flatnonzero(np.cumsum(edge)[:m] > 0)
    if not len(window):
        return nothing
    at = place[window]
    begins = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    low, high, mark = window[begins], window[np.append(begins[1:], len(window)) - 1], at[begins]
    doc = np.searchsorted(offsets, low, "right") - 1
    shape = (high - low) << 12 | (mark - low)
    return grams[mark], _digest(sums, low, high + width, shape), _digest(tb.prefix_of(others), low, high + width, shape), doc, _pack(low - offsets[doc], high - low, mark - low)


def blocks(sums: np.ndarray, others: np.ndarray, size: int, at: np.ndarray, width: int, gram: int, step: int) -> tuple[np.ndarray, ...]:
    """Pass 2 rows of one document for the pass 1 rows `at`: key, sub, sub2, at."""
    low, more, lead = _unpack(at)
    ok = low + more + width <= size
    low, more, lead = low[ok], more[ok], lead[ok]
    mark = low + lead
    out: list[list[np.ndarray]] = [[], [], [], []]
    for b in range((width - gram) // step + 1):
        least, most = np.maximum(b * step, lead - more), np.minimum(b * step + step - 1, lead)
        has = least <= most
        g, lo, hi = mark[has], mark[has] - most[has], mark[has] - least[has]
        core_from, core_to = g - b * step, g - min((b + 1) * step - 1, width - gram) + width
        shape = (hi - lo) << 12 | (g - lo)
        out[0].append(_digest(sums, core_from, core_to, np.full(len(g), b + 1)))
        out[1].append(_digest(sums, lo, hi + width, shape))
        out[2].append(_digest(others, lo, hi + width, shape))
        out[3].append(_pack(lo, hi - lo, g - lo))
    return tuple(np.concatenate(x) for x in out)


def singles(sums: np.ndarray, others: np.ndarray, size: int, at: np.ndarray, width: int, gram: int, step: int) -> tuple[np.ndarray, ...]:
    """Pass 3 rows of one document for the pass 2 rows `at`: two digests of every window, nothing, at."""
    low, more, _ = _unpack(at)
    ok = low + more + width <= size
    low, more = low[ok], more[ok]
    window = np.repeat(low, more + 1) + np.arange((more + 1).sum()) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1)
    window = np.unique(window)
    salt = np.full(len(window), 7)
    key = _digest(sums, window, window + width, salt)
    return key, _digest(others, window, window + width, salt), np.zeros_like(key), _pack(window, 0 * window, 0 * window)


_ROW = "key long, sub long, sub2 long, doc long, at long, doc0 long, at0 long"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]
_SETTLED = "doc long, at long, doc0 long, at0 long, open boolean"
#: In place of at0 of a row without doc0: its digit is surely not alone.
_VOUCHED = -1


def _settle_locally(key, sub, sub2, doc, at, windows: np.ndarray | None = None, hot: int = HOT_VARIANTS) -> Iterator[pa.RecordBatch]:
    """Rows for the shuffle; a row with doc0 is settled already and passes through.  `windows` has the bytes of each, a row each."""
    order = np.lexsort((at, doc, sub2, sub, key))
    key, sub, sub2, doc, at = key[order], sub[order], sub2[order], doc[order], at[order]
    other_key = np.ones(len(key), bool)
    other_key[1:] = key[1:] != key[:-1]
    first = other_key.copy()
    first[1:] |= (sub[1:] != sub[:-1]) | (sub2[1:] != sub2[:-1])
    if windows is not None:
        windows = windows[order]
        first[1:] |= (windows[1:] != windows[:-1]).any(1)
    leader = np.flatnonzero(first)[np.cumsum(first) - 1]
    again = ~first & ((doc != doc[leader]) | (at != at[leader]))
    keep = first | again
    spread = np.where(again, tb.mix(doc.view(np.uint64) + at.view(np.uint64)), key)
    vouched = np.zeros(len(key), bool)
    if windows is None and len(key):
        group = np.cumsum(other_key) - 1
        vouched = first & (np.bincount(group, first)[group] > hot)
        dealt = vouched & ~other_key
        spread[dealt] = tb.mix(key[dealt] ^ tb.mix(sub[dealt] ^ np.uint64(0x2545F4914F6CDD1D)))
    known = again | vouched
    at0 = np.where(again, at[leader], _VOUCHED)
    for k in range(0, len(key), 1 << 16):
        rows = np.flatnonzero(keep[k : k + (1 << 16)]) + k
        mine = [pa.array(doc[rows]), pa.array(at[rows]), pa.array(doc[leader[rows]], mask=~again[rows]), pa.array(at0[rows], mask=~known[rows])]
        if windows is None:
            yield pa.RecordBatch.from_arrays([pa.array(spread[rows].view(np.int64)), pa.array(sub[rows].view(np.int64)), pa.array(sub2[rows].view(np.int64)), *mine], _NAMES)
            continue
        # a row that is settled needs no window
        size = np.where(again[rows], 0, windows.shape[1])
        bytes_ = windows[rows[~again[rows]]].tobytes()
        begins = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        cut = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(begins.tobytes()), pa.py_buffer(bytes_)])
        yield pa.RecordBatch.from_arrays([pa.array(spread[rows].view(np.int64)), cut, *mine], ["key", "window", *_NAMES[3:]])
    del order, key, sub, sub2, doc, at, first, leader, again, keep, spread, windows, vouched, known, at0
    tb.trim()


def _changes(batch: pa.RecordBatch, columns: list[str], before: list | None) -> np.ndarray:
    """Where a row differs from the one before in any of the columns; `before` is the last row of the batch before."""
    out = np.zeros(batch.num_rows, bool)
    out[0] = before is None or before != [batch.column(c)[0].as_py() for c in columns]
    for c in columns:
        column = batch.column(c)
        if pa.types.is_binary(column.type):
            data, offsets = tb.flat(column)
            rows = data.reshape(batch.num_rows, -1)  # windows of one width
            out[1:] |= (rows[1:] != rows[:-1]).any(1)
        else:
            values = column.to_numpy()
            out[1:] |= values[1:] != values[:-1]
    return out


def _settle(rows: DataFrame, last: bool) -> DataFrame:
    """Repetitions with the row they repeat, and (unless it is the last pass) rows whose digit has other rows as open."""
    whole = ["window"] if "window" in rows.columns else ["key", "sub", "sub2"]
    return rows.repartition("key").sortWithinPartitions(*whole, "doc", "at").mapInArrow(lambda batches: settled(batches, whole, last), _SETTLED)


def settled(batches: Iterator[pa.RecordBatch], whole: list[str], last: bool) -> Iterator[pa.RecordBatch]:
    """The rows of one task, sorted by the columns `whole` and place; the state is one row, however many share a digit."""
    digit = content = None  # of the last row
    doc0 = at0 = 0  # first row with this content
    waiting = False  # whether the digit has one content so far, which is not reported
    for batch in batches:
        if not batch.num_rows:
            continue
        done = batch.filter(batch.column("doc0").is_valid())
        if done.num_rows:
            yield pa.RecordBatch.from_arrays([*(done.column(c) for c in ("doc", "at", "doc0", "at0")), pa.array(np.zeros(done.num_rows, bool))], ["doc", "at", "doc0", "at0", "open"])
        batch = batch.filter(batch.column("doc0").is_null())
        n = batch.num_rows
        if not n:
            continue
        doc, at = batch.column("doc").to_numpy(), batch.column("at").to_numpy()
        new = _changes(batch, whole, content)
        leader = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        lead_doc, lead_at = (np.where(of >= 0, x[leader[of]] if len(leader) else x0, x0) for x, x0 in ((doc, doc0), (at, at0)))
        again = ~new & ((doc != lead_doc) | (at != lead_at))
        parts = [(doc[again], at[again], lead_doc[again], lead_at[again], np.zeros(again.sum(), bool))]
        if not last:
            new_digit = _changes(batch, ["key"], digit)
            carried = not new_digit[0]
            group = np.cumsum(new_digit) - 1 + carried  # 0: the digit carried over, if any
            contents = np.bincount(group, new)
            contents[0] += carried
            many = (contents > 1) | (np.bincount(group, batch.column("at0").is_valid().to_numpy(zero_copy_only=False)) > 0)
            if carried:
                if waiting and many[0]:
                    parts.append((np.array([doc0]), np.array([at0]), np.array([0]), np.array([0]), np.ones(1, bool)))
                many[0] |= not waiting
            is_open = new & many[group]
            parts.append((doc[is_open], at[is_open], 0 * doc[is_open], 0 * doc[is_open], np.ones(is_open.sum(), bool)))
            waiting = not many[group[-1]]
            digit = [batch.column("key")[n - 1].as_py()]
        content = [batch.column(c)[n - 1].as_py() for c in whole]
        doc0, at0 = int(lead_doc[-1]), int(lead_at[-1])
        x = [np.concatenate(c) for c in zip(*parts, strict=True)]
        if len(x[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in x], ["doc", "at", "doc0", "at0", "open"])
    tb.trim()


def identified(documents: DataFrame) -> DataFrame:
    """doc_id, text, `doc` (a number that orders documents) and `rest` (a struct of all other columns).

    `doc` is the id.  Where rows of one id have different texts, these are different documents:
    `doc` is then their place in the order of id and hash of the text, from a written table.
    """
    others = [F.col(f"`{c}`") for c in documents.columns if c not in ("doc_id", "text")]
    rest = F.struct(*others) if others else F.struct(F.lit(None).cast("int").alias("none"))
    rows = documents.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), rest.alias("rest"))
    texts = rows.select("doc", F.xxhash64("text").alias("_h"))
    if texts.groupBy("doc").agg(F.min("_h").alias("low"), F.max("_h").alias("high")).where("low <> high").isEmpty():
        return rows
    ranged = texts.distinct().repartitionByRange("doc", "_h").sortWithinPartitions("doc", "_h")
    places = written(ranged.withColumn("place", F.monotonically_increasing_id()), "places")
    # a shuffle of the texts, only where ids repeat
    return rows.withColumn("_h", F.xxhash64("text")).join(places, ["doc", "_h"]).select("doc_id", "text", F.col("place").alias("doc"), "rest")


def packed(identified_: DataFrame, carry: bool = False) -> DataFrame:
    """Compressed texts of `identified` rows dealt by document, kept on disk for the passes; with the other columns as `rest` on demand."""
    carried = ["rest"] if carry else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data, offsets = tb.flat(batch.column("text"))
            view = memoryview(np.ascontiguousarray(data))
            z = [press.compress(view[offsets[i] : offsets[i + 1]]) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("doc"), pa.array(z, pa.binary()), *(batch.column(c) for c in carried)], ["doc_id", "doc", "z", *carried])
        tb.trim()

    rows = identified_.select("doc_id", "text", "doc", *carried)
    kinds = {c: rows.schema[c].dataType for c in rows.columns}
    schema = T.StructType([T.StructField("doc_id", kinds["doc_id"]), T.StructField("doc", T.LongType()), T.StructField("z", T.BinaryType()), *(T.StructField(c, kinds[c]) for c in carried)])
    n = int(identified_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept(rows.mapInArrow(run, schema).repartition(n, "doc"))


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes]]]:
    """Row ranges of a batch with their texts, about UNPACKED bytes at a time."""
    open_ = zstandard.ZstdDecompressor()
    start, texts, size = 0, [], 0
    for i, z in enumerate(batch.column("z")):
        texts.append(open_.decompress(z.as_py()))
        size += len(texts[-1])
        if size >= UNPACKED:
            yield start, i + 1, texts
            start, texts, size = i + 1, [], 0
    if texts:
        yield start, batch.num_rows, texts


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def repeated(identified_: DataFrame, texts: DataFrame, units: Units, width: int, gram: int, step: int, literal: bool = False) -> DataFrame:
    """Rows (doc, at, doc0, at0): windows at `at` of doc repeat those at `at0` of doc0, which start earlier.

    With `literal`, for which units must be bytes, the last pass sorts the windows themselves.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            data, offsets = tb.flat(batch.column("text"))
            doc = batch.column("doc").to_numpy()
            for i, j in tb.groups(offsets):
                *digests, index, at = sampled(*units(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), width, gram)
                found.append((*digests, doc[i:j][index], at))
                held += len(at)
                if held >= LOCAL_ROWS:
                    yield from _settle_locally(*(np.concatenate(x) for x in zip(*found, strict=True)))
                    found, held = [], 0
        if held:
            yield from _settle_locally(*(np.concatenate(x) for x in zip(*found, strict=True)))

    def deeper(make, with_bytes: bool):
        most = LOCAL_WINDOWS if with_bytes else LOCAL_ROWS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, held = [], 0
            for batch in batches:
                doc = batch.column("doc").to_numpy()
                lists = batch.column("ats")
                for i, _, raw in unpacked(batch):
                    data, offsets = joined(raw)
                    for p, q in tb.groups(offsets):
                        codes, others, own = units(data[offsets[p] : offsets[q]], offsets[p : q + 1] - offsets[p])
                        for k in range(p, q):
                            a, b = own[k - p], own[k - p + 1]
                            at = np.sort(lists[i + k].values.to_numpy())
                            *digests, at = make(tb.prefix_of(codes[a:b]), tb.prefix_of(others[a:b]), b - a, at, width, gram, step)
                            # a very long document brings its rows in parts
                            for c in range(0, len(at), most):
                                part = [x[c : c + most] for x in (*digests, at)]
                                windows = [data[offsets[k] :][(part[-1] >> 24)[:, None] + np.arange(width)]] if with_bytes else []
                                found.append((*part[:3], np.full(len(part[-1]), doc[i + k]), part[-1], *windows))
                                held += len(part[-1])
                                if held >= most:
                                    yield from _settle_locally(*(np.concatenate(x) for x in zip(*found, strict=True)))
                                    found, held = [], 0
            if held:
                yield from _settle_locally(*(np.concatenate(x) for x in zip(*found, strict=True)))

        return run

    settled = [written(_settle(identified_.select("text", "doc").mapInArrow(first, _ROW), last=False), "windows")]
    for make, last in ((blocks, False), (singles, True)):
        wanted = settled[-1].where("open").groupBy("doc").agg(F.collect_set("at").alias("ats"))
        with_bytes = last and literal
        schema = _ROW.replace("sub long, sub2 long", "window binary") if with_bytes else _ROW
        rows = texts.join(wanted, "doc").select("doc", "z", "ats").mapInArrow(deeper(make, with_bytes), schema)
        settled.append(written(_settle(rows, last), "windows"))
    out = settled[0].unionByName(settled[1]).unionByName(settled[2])
    return out.where("not open").select("doc", "at", "doc0", "at0")
