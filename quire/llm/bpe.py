"""BPE encoding and decoding through a table of distinct words.

Texts are dealt into blocks of bounded size.  A block's distinct words (the tokenizer's own pre-split pieces)
become rows (word, block, rank); grouping by word gives the distinct-word table, where each
word is encoded once in the whole corpus.  Its ids go back to the blocks that have the word,
where they are joined by the word's position in every text.  Decoding joins token ids with the
id-to-piece table of the vocabulary (a fixed number of rows) and concatenates the pieces.

The vocabulary file is a parameter; its content is broadcast, so executors need no path.

Defined cases: null and empty texts have no tokens and decode to the empty text; a special
token's string inside a text becomes that token, as the tokenizers library has it; repeated
rows, rows that share an id and rows without one are encoded one by one; a very long text is in
one block whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import textbytes as tb
from quire.llm.windows import unpacked

#: The pre-split pattern of byte-level BPE (fixed value of the vocabulary's format).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words that a task holds before it passes them on.
HELD_WORDS = 1 << 16
#: About the bytes of texts that one task holds together; smaller blocks send a common word to more of them.
BLOCK_BYTES = 20 << 20
#: Blocks up to which each has a name that spreads them evenly.
NAMED_BLOCKS = 10_000


def vocabulary(path: str) -> str:
    """Content of a byte-level BPE tokenizer file without normalizer; anything else is refused."""
    with open(path, encoding="utf-8") as file:
        content = file.read()
    parts = json.loads(content)
    if parts["model"]["type"] != "BPE" or parts["normalizer"] or parts["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
        raise ValueError("not a plain byte-level BPE vocabulary")
    return content


class Splitter:
    """Cuts a text into the words that BPE treats one by one."""

    def __init__(self, special: list[str]) -> None:
        self.find = regex.compile(PIECES).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def __call__(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self.find(text)
        return [w for k, part in enumerate(self.special.split(text)) for w in ([part] if k % 2 else self.find(part))]


def special_strings(content: str) -> list[str]:
    return [t["content"] for t in json.loads(content)["added_tokens"]]


def piece_table(content: str) -> list[bytes]:
    """The bytes of every token id, empty for unused ids."""
    parts = json.loads(content)
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(visible))}
    ids = {v: k for k, v in parts["model"]["vocab"].items()} | {t["id"]: t["content"] for t in parts["added_tokens"]}
    return [bytes(byte_of[c] for c in ids[k]) if k in ids else b"" for k in range(max(ids, default=-1) + 1)]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices starts[i]..starts[i]+sizes[i] for every i, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Decoder:
    """Joins token ids with their pieces."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def __call__(self, ids: np.ndarray) -> bytes:
        return self.data[ragged(self.starts[ids], self.sizes[ids])].tobytes()


def _labels(spark, n: int, count: int) -> list[int]:
    """For each of `count` blocks a number, so that Spark's hash partitioning deals the blocks over n partitions in turn."""
    label, each = F.col("id").cast("int"), -(-count // n)
    rows = spark.range(40 * n * each).groupBy(F.pmod(F.hash(label), F.lit(n)).alias("p")).agg(F.slice(F.sort_array(F.collect_list(label)), 1, each).alias("labels")).collect()
    found = {r["p"]: r["labels"] for r in rows}
    return [(found.get(k % n, [])[k // n :] or [-1 - k])[0] for k in range(count)]


def _with_places(keyed: DataFrame, count: int, total: int) -> DataFrame:
    """Rows (doc_id, text, _key) with the `_place` of their block: by the key, but texts over an eighth of a mean block each to the block with the least of such.

    There are at most 8 * count of these, whatever the table.
    """
    by_key = F.pmod(F.col("_key"), F.lit(count))
    size = F.octet_length("text")
    long = keyed.where(size > max(1, total // (8 * count))).groupBy("_key").agg(F.sum(size).alias("size")).collect()
    loads, places = [(0, k) for k in range(count)], []
    for r in sorted(long, key=lambda r: (-r["size"], r["_key"])):
        load, k = heapq.heappop(loads)
        places.append((r["_key"], k))
        heapq.heappush(loads, (load + r["size"], k))
    if not places:
        return keyed.withColumn("_place", by_key)
    own = keyed.sparkSession.createDataFrame(places, "_key long, _own long")
    return keyed.join(F.broadcast(own), "_key", "left").withColumn("_place", F.coalesce("_own", by_key))


def _blocks(documents: DataFrame, block_bytes: int) -> DataFrame:
    """doc_id, block and compressed text, dealt by block; blocks have about `block_bytes`, half as much again at the most, or less where shuffle partitions are more."""
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = n * max(1, round(int(total) / (block_bytes * n)))  # as many in every partition
    # rows that share an id, or have none, are dealt by their text
    key = F.xxhash64("doc_id", "text")
    placed = _with_places(documents.select("doc_id", "text", key.alias("_key")), count, int(total))
    # few blocks are spread evenly by name, many by chance
    block = F.element_at(F.lit(_labels(documents.sparkSession, n, count)), F.col("_place").cast("int") + 1) if count <= NAMED_BLOCKS else F.col("_place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tb.trim()  # what earlier stages left to this worker
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data, offsets = tb.flat(batch.column("text"))
            view = memoryview(np.ascontiguousarray(data))
            z = [press.compress(view[offsets[i] : offsets[i + 1]]) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("block"), pa.array(z, pa.binary())], ["doc_id", "block", "z"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    keyed = placed.select("doc_id", "text", block.cast("int").alias("block"))
    return keyed.mapInArrow(run, f"doc_id {kind}, block int, z binary").repartition(n, "block")


def _words(blocks: DataFrame, special) -> DataFrame:
    """word and its place: block, and rank among the block's sorted words, in one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held = Splitter(special), {}
        for batch in batches:
            block = batch.column("block").to_pylist()
            for i, _, texts in unpacked(batch):
                for k, text in enumerate(texts):
                    held.setdefault(block[i + k], set()).update(split(text.decode("utf-8", "replace")))
        for b in list(held):
            words = sorted(held.pop(b))
            for k in range(0, len(words), 1 << 15):
                some = words[k : k + (1 << 15)]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array((b << 32) + np.arange(k, k + len(some)))], ["word", "place"])
            del words
            tb.trim()

    return blocks.mapInArrow(run, "word string, place long")


def _encoded(words: DataFrame, content) -> DataFrame:
    """Each distinct word encoded once; what each block gets of a batch of words: ranks, counts and ids, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would keep memory of their own
        tokenizer, press = Tokenizer.from_str(content.value), zstandard.ZstdCompressor(level=3)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        places, ids = [], []

        def packed() -> pa.RecordBatch:
            at = np.concatenate([np.asarray(p.values) for p in places])
            of = np.repeat(np.arange(sum(len(p) for p in places)), np.concatenate([np.asarray(p.value_lengths()) for p in places]))
            block, rank = at >> 32, at & 0xFFFFFFFF
            sizes = np.array([len(x) for x in ids], np.int64)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            starts = np.cumsum(sizes) - sizes
            order = np.lexsort((rank, block))
            block, rank, of = block[order], rank[order], of[order]
            begins = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else block
            blobs = []
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(block)], strict=True):
                w = of[a:b]
                step = np.diff(rank[a:b], prepend=0).astype("<u4")
                blobs.append(press.compress(np.uint32(b - a).tobytes() + step.tobytes() + sizes[w].astype("<u4").tobytes() + flat[ragged(starts[w], sizes[w])].astype("<u4").tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(block[begins].astype(np.int32)), pa.array(blobs, pa.binary())], ["block", "blob"])

        held = 0
        for batch in batches:
            lists = batch.column("places")
            words = batch.column("word").to_pylist()
            for k in range(0, len(words), 2048):
                ids += [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch(words[k : k + 2048], add_special_tokens=False)]
            places.append(pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(lists.value_lengths())]) if len(lists) else pa.array([0], pa.int32()), lists.flatten()))
            held += batch.num_rows
            if held >= HELD_WORDS:
                yield packed()
                places, ids, held = [], [], 0
        if held:
            yield packed()
        places, ids = [], []
        del tokenizer
        tb.trim()

    # dealt before it is grouped: a word has one row per block already, so nothing can be combined earlier
    table = words.repartition("word").groupBy("word").agg(F.collect_list("place").alias("places"))
    return table.mapInArrow(run, "block int, blob binary")


def _assembled(documents: DataFrame, path: str, make, columns: str, kinds: list[pa.DataType], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Apply make(ids, decoder) to the token ids of every document."""
    spark = documents.sparkSession
    text = vocabulary(path)
    special, content, pieces = special_strings(text), spark.sparkContext.broadcast(text), spark.sparkContext.broadcast(piece_table(text))  # one vocabulary file
    names = ["doc_id", *(c.split()[0] for c in columns.split(", "))]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        split, decoder, open_ = Splitter(special), Decoder(pieces.value), zstandard.ZstdDecompressor()
        known: dict[str, int] = {}
        docs = []
        for z in left.column("z"):
            text = open_.decompress(z.as_py()).decode("utf-8", "replace")
            docs.append(np.array([known.setdefault(w, len(known)) for w in split(text)], np.int32))
        order = np.array(sorted(range(len(known)), key=list(known).__getitem__), np.int64)
        rank = np.empty(len(known), np.int64)
        rank[order] = np.arange(len(known))
        ranks, sizes, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for blob in right.column("blob"):
            raw = open_.decompress(blob.as_py())
            n = int(np.frombuffer(raw, "<u4", 1)[0])
            ranks.append(np.cumsum(np.frombuffer(raw, "<u4", n, 4).astype(np.int64)))
            sizes.append(np.frombuffer(raw, "<u4", n, 4 + 4 * n).astype(np.int64))
            flat.append(np.frombuffer(raw, "<u4", -1, 4 + 8 * n))
        ranks, sizes, flat = np.concatenate(ranks), np.concatenate(sizes), np.concatenate(flat)
        if not np.array_equal(np.sort(ranks), np.arange(len(known))):
            raise RuntimeError("the distinct-word table and the block's words differ")
        size_of, start_of = np.empty(len(known), np.int64), np.empty(len(known), np.int64)
        size_of[ranks], start_of[ranks] = sizes, np.cumsum(sizes) - sizes
        out: list[list] = [[] for _ in kinds]
        for words in docs:
            at = rank[words]
            for column, value in zip(out, make(flat[ragged(start_of[at], size_of[at])], decoder), strict=True):
                column.append(value)
        del docs, known, ranks, sizes, flat
        tb.trim()
        return pa.table([left.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names)

    blocks = _blocks(documents, block_bytes)
    kind = documents.schema["doc_id"].dataType.simpleString()
    back = _encoded(_words(blocks, special), content)
    return blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(run, f"doc_id {kind}, {columns}")


def encoded(documents: DataFrame, path: str) -> DataFrame:
    """doc_id and the token ids of every text."""
    return _assembled(documents, path, lambda ids, decoder: (ids.astype(np.int32),), "ids array<int>", [pa.list_(pa.int32())])


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of every row of (doc_id, ids); null ids give the empty text."""
    content = tokens.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(piece_table(content.value))
        for batch in batches:
            texts = [decoder(np.array(ids or [], np.int64)).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def digests(documents: DataFrame, path: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them."""
    return _assembled(
        documents, path, lambda ids, decoder: (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoder(ids).decode("utf-8", "replace").encode()).hexdigest()),
        "n_tokens long, ids_sha256 string, decoded_sha256 string", [pa.int64(), pa.string(), pa.string()],
    )


def tokens(documents: DataFrame, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids, and the digest of the text decoded from the ids; smaller blocks take less memory in a task and more room in the shuffle."""
    return _assembled(
        documents, path, lambda ids, decoder: (len(ids), ids.astype(np.int32), hashlib.sha256(decoder(ids).decode("utf-8", "replace").encode()).hexdigest()),
        "n_tokens long, ids array<int>, decoded_sha256 string", [pa.int64(), pa.list_(pa.int32()), pa.string()], block_bytes,
    )


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
