"""I-Match fingerprints of documents, in DataFrame operations alone.

The lexicon is a band of inverse document frequencies: terms that at least `LOW` and at most
`HIGH` of the documents hold.  Frequent terms say little of a text and rare ones change with
every slip.  A text's kept terms are sorted, and its fingerprint has a digest of them all and
digests of the kept terms in each of many random parts of the lexicon: the parts of level k hold
one in 2**(k+1) of its terms, `PARTS` parts together, so that long and short texts both have
levels whose parts hold about one term.  A part's digest tells whether two texts agree on the
whole part; the share of equal digests, from the first level on whose parts are not crowded,
is the likeness of two fingerprints.

A text holds few terms of the band on average, so at most (distinct terms a text) / `LOW` terms
can be in it, however many documents there are: the lexicon is one row of buckets that every
task has whole.  Texts are shuffled once, to put each beside the next: ranges of documents in
descending doc_id, cut at keys that are counted first, with a copy of the first row of the
next range at the end of each.

Defined cases: null texts are empty; a text without kept terms has the digest of all its terms
for its only one, and a text without terms that of the text, so that such fingerprints are equal
for equal texts; documents without an id come last; unlike texts of one id come in the order of
a hash; equal rows follow each other, so that all but the last have their like as the next
document; a single row is its own next; the table may be empty; texts are read whole, however
long; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quire.llm.common import HOT_KEYS, HOT_ROWS, written

#: Band of the lexicon, as shares of the documents.
LOW, HIGH = 1 / 1000, 1 / 20
LEVELS, PARTS = 12, 16
#: Parts of a level of which texts may hold terms before it counts as crowded.
CROWDED = PARTS * 3 // 4
#: Terms of a text with which a level is crowded for certain: its parts have the digest of the whole level.
FULL = PARTS * 2
#: Rows and bytes of a range, and ranges at the most: their first keys travel with the tasks, 128 to a group.
RANGE_ROWS, RANGE_BYTES, RANGES, GROUP = 4000, 1 << 24, 16_384, 128
#: What stands for a part without terms among the digests of 16 bits.
NONE = 0

_GAPS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def terms(text: Column) -> Column:
    """Hashes of the distinct terms: runs of letters and of characters beyond ASCII, in lower case."""
    return F.array_distinct(F.transform(F.array_remove(F.split(F.lower(text), _GAPS), ""), lambda t: F.xxhash64(t)))


def lexicon(documents: DataFrame, low: float = LOW, high: float = HIGH) -> tuple[DataFrame, int]:
    """The band as one row of buckets of hashes, and the number of buckets; equal rows are documents of their own."""
    # distinct words rather than `terms`, and explode_outer: generated code, and no filter that splits the text again
    words = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), _GAPS))
    held = documents.select(F.explode_outer(words).alias("word")).where("word <> ''").select(F.xxhash64("word").alias("term"))
    n = documents.count()
    band = written(held.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n").between(low * n, high * n)).select("term"), "band")
    size = 1 << max(0, band.count() - 1).bit_length()
    filled = band.groupBy(F.pmod("term", F.lit(size)).alias("id")).agg(F.collect_list("term").alias("terms"))
    every = documents.sparkSession.range(size).join(filled, "id", "left").select("id", F.coalesce("terms", F.array().cast("array<bigint>")).alias("terms"))
    row = every.agg(F.array_sort(F.collect_list(F.struct("id", "terms"))).alias("b")).select(F.transform("b", lambda x: x["terms"]).alias("lexicon"))
    return written(row, "lexicon"), size


def _digest(of: Column) -> Column:
    return (F.pmod(F.xxhash64(of), F.lit(0xFFFF)) + 1).cast("int")


def digests(text: Column, buckets: Column, size: int) -> Column:
    """The fingerprint of a text that is not null, as numbers: the digest of all kept terms, then those of the parts, level by level."""

    def inside(t: Column) -> Column:
        return F.array_contains(F.element_at(buckets, (F.pmod(t, F.lit(size)) + 1).cast("int")), t)

    def part(of: Column, p: Column) -> Column:
        found = F.filter(of, lambda t: t.bitwiseAND(F.lit(PARTS - 1)) == p)
        return _let(found, lambda f: F.when(F.size(f) == 0, F.lit(NONE)).otherwise(_digest(f)))

    def parts(of: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.lit(PARTS - 1))
        same = F.array_repeat(F.when(F.size(of) == 0, F.lit(NONE)).otherwise(_digest(of)), PARTS)
        return F.when(F.size(of).between(1, FULL), F.transform(numbers, lambda p: part(of, p))).otherwise(same)

    def levels(left: Column, k: int = 0) -> Column:
        # terms are hashes: the lowest bits give the part, and the next ones set aside half of what is left to each level
        if k == LEVELS - 1:
            return parts(left)
        bit = lambda t: t.bitwiseAND(F.lit(PARTS << k)) != 0
        return F.concat(_let(F.filter(left, bit), parts), _let(F.filter(left, lambda t: ~bit(t)), lambda rest: levels(rest, k + 1)))

    def marked(kept: Column) -> Column:
        return F.struct(F.xxhash64(kept).alias("all"), levels(kept).alias("parts"))

    def of_terms(found: Column) -> Column:
        whole = F.when(F.size(found) == 0, F.xxhash64(text)).otherwise(F.xxhash64(F.sort_array(found)))
        kept = F.sort_array(F.filter(found, inside))
        return _let(kept, lambda k: _let(F.when(F.size(k) == 0, F.array(whole)).otherwise(k), marked))

    return _let(terms(text), of_terms)


def written_out(mark: Column) -> Column:
    """Digests as text: 16 hexadecimal digits for all kept terms, and four for every part that has some, `-` for others."""
    digits = lambda c, n: F.lpad(F.lower(F.hex(c)), n, "0")
    parts = F.transform(mark["parts"], lambda d: F.when(d == NONE, F.lit("-")).otherwise(digits(d, 4)))
    return F.concat_ws(" ", digits(mark["all"], 16), F.array_join(parts, ""))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1, of two digests: the share of equal ones among the parts of which either text holds terms, without crowded levels."""

    def share(equal: Column) -> Column:
        told = lambda part: F.filter(part, lambda e: e.isNotNull())
        held = F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: told(F.slice(equal, k * PARTS + 1, PARTS)))
        first = lambda h: F.coalesce(F.array_min(F.filter(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: F.size(F.get(h, k)) <= CROWDED)), F.lit(LEVELS - 1))
        ones = _let(held, lambda h: F.flatten(F.slice(h, first(h) + 1, LEVELS)))
        return _let(ones, lambda t: F.when(F.size(t) == 0, F.lit(0.0)).otherwise(F.size(F.filter(t, lambda e: e)) / F.size(t)))

    same = F.zip_with(a["parts"], b["parts"], lambda x, y: F.when((x != NONE) | (y != NONE), x == y))
    return F.when((a["all"] == b["all"]) & (a["parts"] == b["parts"]), F.lit(1.0)).otherwise(_let(same, share))


def _key() -> Column:
    """Order of the documents: descending doc_id, those without one last, then by a hash of the text."""
    return F.struct(F.col("doc_id").isNull().cast("int").alias("none"), F.bitwise_not("doc_id").alias("id"), F.xxhash64("text").alias("h"))


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", _key())


def _ranges(keys: DataFrame) -> DataFrame:
    """One row with the first keys of ranges of about as many rows and bytes, in order."""
    n, total = keys.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    ranges = min(RANGES, max(1, -(-n // RANGE_ROWS), -(-total // RANGE_BYTES)))
    first = keys.repartitionByRange(ranges, "key").groupBy(F.spark_partition_id()).agg(F.min("key").alias("key"))
    return written(first.agg(F.array_sort(F.collect_list("key")).alias("firsts")), "ranges")


def _range(bounds: Column, key: Column) -> Column:
    """The range of a key, from the ranges' first keys in groups of `GROUP`."""
    passed = lambda group: F.size(F.filter(group, lambda b: b <= key))
    group = lambda bs: F.size(F.filter(bs, lambda g: F.get(g, F.lit(0)) <= key))
    return _let(bounds, lambda bs: _let(group(bs), lambda g: (g - 1) * GROUP + passed(F.get(bs, g - 1)) - 1))


def with_next(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables: (doc_id, text, next, range, key, last), texts beside the next, and (doc_id, text, copies), rows repeated too often for that.

    `last` rows repeat the first row of the next range.  Of rows repeated more than HOT_ROWS times
    one stays in the first table; the others have their like as the next and are only counted.
    """
    rows = _keyed(documents)
    keys = written(rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")), "keys")
    firsts = _ranges(keys)
    limit = max(HOT_ROWS, keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // HOT_KEYS)
    hot = written(keys.where(F.col("n") > limit).select("key", "n"), "hot")  # HOT_KEYS rows at the most
    gathered = rows.join(F.broadcast(hot), "key").groupBy("key", "n").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))

    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size("firsts") - 1) / GROUP).cast("int")), lambda g: F.slice("firsts", g * GROUP + 1, F.lit(GROUP)))
    bounds = firsts.select(F.when(F.size("firsts") > 0, groups).alias("bounds"))
    plain = rows.join(F.broadcast(hot.select("key")), "key", "left_anti").unionByName(gathered.select("key", "doc_id", "text"))
    ranged = plain.select("doc_id", "text", "key", bounds.scalar().alias("bounds")).select("doc_id", "text", "key", _range(F.col("bounds"), F.col("key")).alias("range"), F.lit(False).alias("last"))
    starts = firsts.select(F.size("firsts").alias("m"), F.posexplode("firsts").alias("r", "key"))  # a row a range
    edges = rows.join(F.broadcast(starts), "key").groupBy("key", "r", "m").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    edges = edges.select("doc_id", "text", "key", F.pmod(F.col("r") - 1, "m").alias("range"), F.lit(True).alias("last"))
    beside = ranged.unionByName(edges).withColumn("next", F.lead("text").over(_order()))
    return beside, gathered.select("doc_id", "text", (F.col("n") - 1).alias("copies"))


def _order() -> WindowSpec:
    # the row of the next range stands behind all others, although in the last range its key is the first of all
    return Window.partitionBy("range").orderBy("last", "key")


def _as_often(rows: DataFrame, limit: int = HOT_ROWS) -> DataFrame:
    """Every row as often as `copies` says, dealt in parts of `limit`."""
    cells = rows.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / limit).cast("long"))))
    dealt = cells.repartition("marks", "cell")
    return dealt.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(limit).cast("long"), F.col("copies") - F.col("cell") * limit)))).drop("cell", "copy", "copies")


def fingerprinted(documents: DataFrame) -> DataFrame:
    """doc_id, text and fingerprint of every document."""
    row, size = lexicon(documents)
    given = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), row.scalar().alias("lexicon"))
    return given.select("doc_id", "text", digests(F.col("text"), F.col("lexicon"), size).alias("mark")).select("doc_id", "text", written_out(F.col("mark")).alias("fingerprint"))


def op13_imatch(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    row, size = lexicon(documents)
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next", F.lit(1), cut))

    def marked(rows: DataFrame, *others: str) -> DataFrame:
        both = rows.select("doc_id", n.cast("long").alias("n_chars"), F.array("text", F.coalesce(edited, F.lit(""))).alias("texts"), *others, row.scalar().alias("lexicon"))
        marks = F.transform("texts", lambda t: digests(t, F.col("lexicon"), size))
        return both.select("doc_id", "n_chars", F.sha2(F.get("texts", F.lit(1)), 256).alias("edited_sha256"), marks.alias("marks"), *others)

    mine, theirs = F.get("marks", F.lit(0)), F.get("marks", F.lit(1))
    beside, repeated = with_next(documents)
    told = marked(beside, "range", "key", "last").withColumn("following", F.lead(mine).over(_order())).where("NOT last")
    again = _as_often(marked(repeated.withColumn("next", F.col("text")), "copies").withColumn("following", mine))
    rows = told.drop("range", "key", "last").unionByName(again)
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", written_out(mine).alias("fingerprint"), written_out(theirs).alias("edited_fingerprint"),
        likeness(mine, theirs).alias("near_edited"), likeness(mine, F.col("following")).alias("near_next"),
    )
