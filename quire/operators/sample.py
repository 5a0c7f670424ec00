"""Representative chapters of a book: buckets in reading order, the longest of each, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import strip


def _valid(rows: DataFrame, book: str, least: int) -> DataFrame:
    """Chapters of at least `least` characters, or all where a book has none, with position and number."""
    of_book = Window.partitionBy(book)
    long = rows.withColumn("any_long", F.max((F.col("chars") >= least).cast("int")).over(of_book)).where((F.col("any_long") == 0) | (F.col("chars") >= least))
    return long.withColumn("pos", F.row_number().over(of_book.orderBy("position")) - 1).withColumn("total", F.count("*").over(of_book)).drop("any_long")


def _bucket(start: "callable", count: int) -> Column:
    """The r with start(r) <= pos < start(r + 1); the last bucket is open."""
    out = F.lit(count - 1)
    for r in range(count - 2, -1, -1):
        out = F.when(F.col("pos") < start(r + 1), F.lit(r)).otherwise(out)
    return out


def _longest(rows: DataFrame, book: str) -> Column:
    return F.row_number().over(Window.partitionBy(book, "bucket").orderBy(F.desc("chars"), "pos"))


def strided(rows: DataFrame, book: str, count: int = 6, least: int = 300) -> DataFrame:
    """Of rows (book, position, chars) the longest of each of `count` equal buckets, or all where there are no more."""
    valid = _valid(rows, book, least)
    start = lambda r: F.floor(F.lit(float(r)) * (F.col("total").cast("double") / count))
    ranked = valid.withColumn("bucket", _bucket(start, count)).withColumn("rank", F.when(F.col("total") <= count, 1).otherwise(_longest(valid, book)))
    return ranked.where("rank = 1").select(book, "position", "chars", "pos", "total")


def regional(rows: DataFrame, book: str, regions: int = 3, each: int = 2, least: int = 300, skip: int = 0) -> DataFrame:
    """The longest chapters of each region; `skip` passes over as many of the longest, except in books that are taken whole."""
    valid = _valid(rows, book, least)
    count = F.least(F.lit(regions), F.col("total"))
    bucket = F.lit(regions - 1)
    for r in range(regions - 2, -1, -1):
        bucket = F.when(F.col("pos") < F.floor(F.lit(r + 1) * F.col("total") / count), F.lit(r)).otherwise(bucket)
    ranked = valid.withColumn("bucket", F.least(bucket, count - 1)).withColumn("rank", _longest(valid, book))
    whole = F.col("total") <= regions * each
    return ranked.where(whole | F.col("rank").between(skip + 1, skip + each)).select(book, "position", "chars", "pos", "total")


def budget(total: Column, base: int = 30_000, per_100k: int = 20_000, cap: int = 60_000) -> Column:
    """Characters to sample: at least base, more for longer books, at most cap."""
    return F.least(F.lit(cap), F.greatest(F.lit(base), F.lit(base) + F.lit(per_100k) * F.floor(total / 100_000)))


def region_plan(budget_chars: int, regions: int = 3, each: int = 2, chapters: int = 6, base: int = 30_000) -> tuple[int, int]:
    """Regions and chapters of each that spend a budget."""
    wanted = max(chapters, budget_chars // max(3000, base // max(1, chapters)))
    return regions, max(each, -(-wanted // max(1, regions)))


def sampled_text(chosen: DataFrame, paragraphs: DataFrame, book: str, budget_chars: Column) -> DataFrame:
    """Paragraphs (book, position, ord, text) of the chosen chapters cut to a quota a chapter and to the book's budget."""
    quota = F.greatest(F.lit(3000), F.floor(F.col("budget") / F.col("n")))
    sized = chosen.withColumn("n", F.count("*").over(Window.partitionBy(book))).withColumn("budget", budget_chars).withColumn("quota", quota)
    rows = paragraphs.join(sized.select(book, "position", "budget", "quota"), [book, "position"])
    in_chapter = Window.partitionBy(book, "position").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("room", F.greatest(F.lit(0), F.col("quota") - F.coalesce(F.sum(F.length("text")).over(in_chapter), F.lit(0))))
    rows = rows.withColumn("take", F.least(F.length("text").cast("long"), F.col("room")))
    in_book = Window.partitionBy(book).orderBy("position", "ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("left", F.greatest(F.lit(0), F.col("budget") - F.coalesce(F.sum("take").over(in_book), F.lit(0))))
    cut = rows.withColumn("take", F.least("take", "left")).where("take > 0")
    return cut.select(book, "position", "ord", F.expr("substring(text, 1, int(take))").alias("text"))


def chosen(rows: DataFrame, book: str, total_chars: int, regions: int | None = 3, each: int | None = 2, count: int = 6, round_: int = 0, least: int = 300) -> DataFrame:
    """Chapters by regions, more for a longer book and others in a later round, where regions are set; else by equal buckets."""
    if regions is None or each is None:
        return strided(rows, book, count, least)
    spend = min(60_000, max(30_000, 30_000 + 20_000 * (total_chars // 100_000)))
    regions, each = region_plan(spend, regions, each, count)
    return regional(rows, book, regions, each, least, skip=round_ * each)


def report_text(report_: DataFrame, chosen_: DataFrame, book: str) -> DataFrame:
    """(book, text): a report in one line: chapters, characters where the book is long, positions, progress and how well it is covered."""
    positions = chosen_.groupBy(book).agg(F.array_join(F.transform(F.array_sort(F.collect_list("position")), lambda p: p.cast("string")), ",").alias("_at"))
    percent = lambda c: F.concat(F.floor(F.col(c) * 100).cast("string"), F.lit("%"))
    size = F.when(F.col("total_chars") >= 10_000, F.concat(F.least("budget_chars", "total_chars").cast("string"), F.lit("/"), F.col("total_chars").cast("string"))).otherwise(F.col("budget_chars").cast("string"))
    state = F.when(F.col("all_chapters"), "all chapters").when(F.col("spans_whole"), "start, middle and end covered").otherwise("not covered, sample more chapters")
    text = F.concat(
        F.col("sample_chapters").cast("string"), F.lit("/"), F.col("valid_chapters").cast("string"), F.lit(" chapters, "), size, F.lit(" characters, at ["), "_at", F.lit("], "),
        percent("first_progress"), F.lit(" to "), percent("last_progress"), F.lit(", "), state,
    )
    return report_.join(positions, book).select(book, text.alias("text"))


def report(rows: DataFrame, chosen: DataFrame, book: str, least: int = 300) -> DataFrame:
    """How well the chosen chapters cover each book."""
    whole = rows.groupBy(book).agg(F.count("*").alias("total_chapters"), F.sum("chars").alias("total_chars"), F.sum((F.col("chars") >= least).cast("long")).alias("long_chapters"))
    progress = F.when(F.col("total_chapters") <= 1, F.lit(1.0)).otherwise(F.round(F.col("position") / (F.col("total_chapters") - 1), 3))
    found = chosen.select(book, "position").join(whole, book).withColumn("progress", progress)
    out = found.groupBy(book, "total_chapters", "total_chars", "long_chapters").agg(
        F.count("*").alias("sample_chapters"), F.min("progress").alias("first_progress"), F.max("progress").alias("last_progress"), F.max(F.col("progress").between(0.25, 0.75)).alias("middle_covered")
    )
    spans = (F.col("first_progress") <= 0.34) & (F.col("last_progress") >= 0.66) & F.col("middle_covered")
    return out.select(
        book, "total_chapters", F.when(F.col("long_chapters") > 0, F.col("long_chapters")).otherwise(F.col("total_chapters")).alias("valid_chapters"), "sample_chapters", "total_chars",
        budget(F.col("total_chars")).cast("long").alias("budget_chars"), "first_progress", "last_progress", "middle_covered",
        (F.col("sample_chapters") == F.col("total_chapters")).alias("all_chapters"), (spans | (F.col("sample_chapters") == F.col("total_chapters"))).alias("spans_whole"),
    )


def distinct_titles(rows: DataFrame, book: str, most: int = 80, chars: int = 60) -> DataFrame:
    """(book, position, title): the first `most` different titles of a book, without blank ones and those over `chars` characters."""
    title = strip(F.coalesce("title", F.lit("")))
    short = rows.select(book, "position", title.alias("title")).where((F.col("title") != "") & (F.length("title") <= chars))
    first = short.groupBy(book, "title").agg(F.min("position").alias("position"))
    return first.withColumn("_n", F.row_number().over(Window.partitionBy(book).orderBy("position", "title"))).where(F.col("_n") <= most).select(book, "position", "title")


def evenly(rows: DataFrame, book: str, count: int = 10) -> DataFrame:
    """At most `count` rows of a book at even distances from first to last; halves round to even places."""
    seen = Window.partitionBy(book)
    placed = rows.withColumn("_p", F.row_number().over(seen.orderBy("position")) - 1).withColumn("_t", F.count("*").over(seen))
    some = F.least("_t", F.lit(count))
    place = lambda i: F.bround(i * (F.col("_t") - 1) / (some - 1), 0).cast("long")
    wanted = F.when(some > 1, F.transform(F.sequence(F.lit(0).cast("long"), some - 1), place)).otherwise(F.array(F.lit(0).cast("long")))
    return placed.where(F.array_contains(wanted, F.col("_p").cast("long")) & (some > 0)).drop("_p", "_t")
