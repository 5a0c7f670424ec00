"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations alone.

An item is cut into windows of `width` words (an item of fewer words is one window), and a
document is contaminated where a whole window occurs in it.  Containment of the whole window
needs every one of its shingles (of three words, or as many as a shorter window has), so a
prefix of one shingle is enough to find candidates: the shingles of a window are ordered by
rarity, counted over all documents, and documents are joined by the rarest.  Its place in the
window gives the only place where the window can start; starts before the document or ends
after it are dropped (positional and length bounds), and the rest is compared word by word with
the document.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z.  Windows and their
shingles are broadcast, `BLOCK_WINDOWS` windows at a time; more windows take further scans.
Candidates go to their documents by broadcast while there are at most `BROADCAST_CANDIDATES`,
which is counted; beyond that the texts are shuffled.

Defined cases: null and wordless texts have no words and no hits; items without words have no
windows; windows of items without an id still hit but name no item; rows that share a doc_id
are told apart by a hash of their text, and equal rows get equal results; equal windows of
several items count for each of them; very long texts are read whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import written

WIDTH = 10
#: Words of a shingle.
SHINGLE = 3
#: Windows that are broadcast at a time, with eight shingles each at the most; and candidates.
BLOCK_WINDOWS, BROADCAST_CANDIDATES = 100_000, 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z to lower case; texts of ASCII alone take the fast function, which does the same for them."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    """The words of a text; an empty array for a null."""
    return F.coalesce(F.array_remove(F.split(lowered(text), _GAPS), ""), F.array().cast("array<string>"))


def windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct windows (as arrays of words) with the ids of their items as strings."""
    split = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where("size(w) > 0")
    begins = split.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - width + 1))).alias("at"))
    return begins.select("item", F.expr(f"slice(w, at, {width})").alias("window")).groupBy("window").agg(F.collect_set("item").alias("items"))


def _shingled(documents: DataFrame, *columns: str) -> DataFrame:
    """The columns, n_words, and for each word its place `at` and the word with those after it (a, b, c; null beyond the end)."""
    split = documents.select(*columns, words(F.col("text")).alias("w"))
    zipped = F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b"), F.slice("w", F.lit(3), F.size("w")).alias("c"))
    return split.select(*columns, F.size("w").alias("n_words"), F.posexplode(zipped).alias("at", "s")).select(*columns, "n_words", "at", "s.a", "s.b", "s.c")


def _token(size: int) -> Column:
    """Hash of the first `size` words of a row of `_shingled`; equal hashes are compared word by word in the end."""
    return F.xxhash64(*("a", "b", "c")[:size])


def _own(table: DataFrame, size: int) -> DataFrame:
    """(window, items, size, offset, token): the shingles of `size` words of the windows that are cut into such."""
    of_size = table.where(F.least("size", F.lit(SHINGLE)) == size)
    offsets = of_size.select("window", "items", "size", F.explode(F.sequence(F.lit(0), F.col("size") - size)).alias("offset"))
    return offsets.withColumn("token", F.xxhash64(*(F.get("window", F.col("offset") + k) for k in range(size))))


def _ranked(documents: DataFrame, table: DataFrame, size: int) -> DataFrame:
    """(token, offset, size, window, items): the windows by their shingle that is rarest in the documents, with its place."""
    tokens = _own(table, size)
    seen = _shingled(documents).select(_token(size).alias("token")).join(F.broadcast(tokens.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("n"))
    best = tokens.join(F.broadcast(seen), "token", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("rarest"), F.first("items").alias("items"), F.first("size").alias("size"))
    return best.where("rarest.n > 0").select("rarest.token", "rarest.offset", "size", "window", "items")


def candidates(documents: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, h, found): for the documents with the rarest shingle of a window, by id and hash of the text, the distinct (start, size, window, items)."""
    table = written(windows(items, width).withColumn("size", F.size("window")), "windows")
    sizes = sorted(r["k"] for r in table.select(F.least("size", F.lit(SHINGLE)).alias("k")).distinct().collect())  # three at the most
    blocks = max(1, -(-table.count() // BLOCK_WINDOWS))
    key = documents.select("doc_id", "text", F.xxhash64("text").alias("h"))
    found = key.select("doc_id", "h", F.struct(F.lit(0).alias("start"), F.lit(0).alias("size"), F.array().cast("array<string>").alias("window"), F.array().cast("array<string>").alias("items")).alias("f")).limit(0)
    for b in range(blocks):
        for size in sizes:
            block = table.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b)
            ranked = F.broadcast(written(_ranked(documents, block, size), "ranked"))
            placed = _shingled(key, "doc_id", "h").select("doc_id", "h", "n_words", "at", _token(size).alias("token")).join(ranked, "token")
            placed = placed.where("at >= offset AND at - offset + size <= n_words")
            found = found.unionByName(placed.select("doc_id", "h", F.struct((F.col("at") - F.col("offset")).alias("start"), "size", "window", "items").alias("f")))
    return written(found.groupBy("doc_id", "h").agg(F.collect_set("f").alias("found")), "candidates")


def _joined(documents: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """doc_id, text, `rest` (a struct of all other columns) and the candidates `found` of every document."""
    others = [F.col(f"`{c}`") for c in documents.columns if c not in ("doc_id", "text")]
    rest = (F.struct(*others) if others else F.lit(None)).alias("rest")
    found = candidates(documents, items, width)
    count = found.agg(F.coalesce(F.sum(F.size("found")), F.lit(0))).first()[0]
    d, c = documents.select("doc_id", "text", F.xxhash64("text").alias("h"), rest).alias("d"), found.alias("c")
    same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.h") == F.col("c.h"))
    return d.join(F.broadcast(c) if count <= BROADCAST_CANDIDATES else c, same, "left").select("d.doc_id", "d.text", "d.rest", "c.found")


def decontaminated(documents: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text, `rest` (a struct of all other columns), n_words, n_hit and the items found, for every document."""
    hits = _compared(_joined(documents, items, width))
    return hits.select(
        "doc_id", "text", "rest", "n_words",
        F.expr("aggregate(hits, named_struct('end', 0L, 'n', 0L), (a, f) -> named_struct('end', greatest(a.end, CAST(f.start + f.size AS BIGINT)), 'n', a.n + greatest(0L, f.start + f.size - greatest(a.end, CAST(f.start AS BIGINT)))), a -> a.n)").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda f: f["items"])))).alias("items"),
    )


def _compared(both: DataFrame) -> DataFrame:
    """The candidates that hold, by start, and the number of words.

    The words are the variable of a lambda, so they are split once a document even where the
    optimizer copies the expression; documents without candidates are only counted.
    """
    held = F.transform(
        F.array(words(F.col("text"))),
        lambda w: F.struct(
            F.size(w).alias("n"),
            F.array_sort(
                F.transform(
                    F.filter("found", lambda f: F.slice(w, f["start"] + 1, f["size"]) == f["window"]),
                    lambda f: F.struct(f["start"].alias("start"), f["size"].alias("size"), f["items"].alias("items")),
                )
            ).alias("hits"),
        ),
    )
    count = F.size(words(F.col("text")))
    none = F.expr("CAST(array() AS array<struct<start:int,size:int,items:array<string>>>)")
    got = F.when(F.col("found").isNull(), F.struct(count.alias("n"), none.alias("hits"))).otherwise(F.element_at(held, 1))
    return both.select("doc_id", "text", "rest", got.alias("got")).select("doc_id", "text", "rest", F.col("got.n").cast("long").alias("n_words"), F.col("got.hits").alias("hits"))


def cleaned(documents: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents without those that hold a window of an item."""
    found = _compared(_joined(documents, items, width)).where("size(hits) = 0")
    return found.select(*(F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`") for c in documents.columns))


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = decontaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
