"""Volumes and corrections: merging, chapter trees, unusual chapters, note chapters and title order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import PRODUCTION_MARKS, PRODUCTION_TITLE, format_prefix, is_word_count_line, number_of, strip, u
from quire.operators.package import references
from quire.operators.segment import remapped
from quire.operators.tree import preorder
from quire.sources.files import stored


def merged_volumes(chapters: DataFrame, title: str = "", series: str | None = None) -> DataFrame:
    """One book of volumes (volume_no, chapter_index, title, heading_level, parent_index): a node before each volume, levels one deeper (6 at most), parents kept or set to the node.

    With `series`, a column, one book for each of its values.
    """
    of = [series] if series else []
    prefix = f"{title.strip()} " if title.strip() else ""
    nodes = chapters.select(*of, "volume_no").distinct().select(
        *of, "volume_no", F.lit(None).cast("int").alias("old_index"), F.concat(F.lit(f"{prefix}第"), F.col("volume_no").cast("string"), F.lit("卷")).alias("title"),
        F.lit(1).alias("heading_level"), F.lit(None).cast("int").alias("old_parent"), F.lit(True).alias("is_section"),
    )
    bodies = chapters.select(*of, "volume_no", F.col("chapter_index").cast("int").alias("old_index"), "title", F.least(F.col("heading_level") + 1, F.lit(6)).alias("heading_level"), F.col("parent_index").cast("int").alias("old_parent"), F.lit(False).alias("is_section"))
    # volumes are numbered by their sizes, so no task orders all chapters of all volumes
    sizes = bodies.groupBy(*of, "volume_no").agg((F.count("*") + 1).alias("size"))
    before = Window.partitionBy(*of).orderBy("volume_no") if of else Window.orderBy("volume_no")  # a row a volume
    starts = sizes.withColumn("start", F.coalesce(F.sum("size").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy(*of, "volume_no").orderBy(F.col("old_index").asc_nulls_first())
    placed = nodes.unionByName(bodies).join(starts, [*of, "volume_no"]).withColumn("chapter_index", (F.col("start") + F.row_number().over(inside) - 1).cast("int"))
    parents = placed.where(~F.col("is_section")).select(*of, "volume_no", F.col("old_index").alias("old_parent"), F.col("chapter_index").alias("found"))
    return placed.join(parents, [*of, "volume_no", "old_parent"], "left").select(
        *of, "chapter_index", "volume_no", "title", "heading_level", F.when(~F.col("is_section"), F.coalesce("found", F.col("start").cast("int"))).alias("parent_index"), "is_section"
    )


def centre(rows: DataFrame, book: str, size: str = "chars") -> DataFrame:
    """(book, content_count, centre): the mean without the smallest and largest tenth, or the median where the two differ by more than twice.

    Worked out from the counts of distinct sizes: no task has all chapters of a book.
    """
    counts = rows.where(F.col(size) > 0).groupBy(book, F.col(size).alias("_v")).agg(F.count("*").alias("_c"))
    totals = counts.groupBy(book).agg(F.sum("_c").alias("n"))
    ahead = Window.partitionBy(book).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)  # a row a distinct size
    placed = counts.withColumn("_low", F.coalesce(F.sum("_c").over(ahead), F.lit(0))).join(totals, book)
    high, k = F.col("_low") + F.col("_c"), F.floor(F.col("n") * 0.1)
    inside = F.greatest(F.lit(0), F.least(high, F.col("n") - k) - F.greatest("_low", k))
    at = lambda rank: F.max(F.when((F.col("_low") < rank) & (rank <= high), F.col("_v")))
    out = placed.groupBy(book).agg(
        F.max("n").alias("content_count"), (F.sum(F.col("_v") * inside) / F.sum(inside)).alias("mean"),
        ((at(F.floor((F.col("n") + 1) / 2)) + at(F.floor((F.col("n") + 2) / 2))) / 2).alias("median"),
    )
    return out.select(book, "content_count", F.when((F.col("median") > 0) & ~F.col("mean").between(F.col("median") * 0.5, F.col("median") * 2), F.col("median")).otherwise(F.col("mean")).alias("centre"))


def abnormal(rows: DataFrame, book: str, percent: float = 50) -> DataFrame:
    """Chapters (book, position, chars) with text whose size is outside the centre by more than `percent`."""
    near = F.col("chars").between(F.col("centre") * (1 - percent / 100), F.col("centre") * (1 + percent / 100))
    return rows.where("chars > 0").join(centre(rows, book), book).where(~near)


def _minutes(a_minute: int) -> Column:
    return F.bround(F.col("chars") / a_minute).cast("long").alias("minutes")


def volume_chars(chapters: DataFrame, volume: str, a_minute: int = 400) -> DataFrame:
    """(volume, chars, minutes, chapters, total): sizes of each volume and, with total 1 and no volume, of all together; minutes are rounded, halves to even."""
    sized = chapters.rollup(volume).agg(F.sum("chars").alias("chars"), F.count("*").alias("chapters"), F.grouping(volume).cast("long").alias("total"))
    return sized.select(volume, "chars", _minutes(a_minute), "chapters", "total")


def char_tree(chapters: DataFrame, volume: str, chapter: str, a_minute: int = 400) -> DataFrame:
    """(volume, chapter, level, chars, minutes): level 0 is every chapter, 1 every volume, 2 all together."""
    level = (F.grouping(volume) + F.grouping(chapter)).cast("int").alias("level")
    sized = chapters.rollup(volume, chapter).agg(F.sum("chars").alias("chars"), level)
    return sized.select(volume, chapter, "level", "chars", _minutes(a_minute))


def is_production(title: Column, paragraphs: Column) -> Column:
    body, hit = F.array_join(paragraphs, ""), F.coalesce(title, F.lit("")).contains(PRODUCTION_TITLE)
    for mark in PRODUCTION_MARKS:
        hit = hit | body.contains(mark)
    return hit


def common_title(volumes: DataFrame, series: str, title: str = "title") -> DataFrame:
    """(series, title): the common start of the titles of its volumes without separators at the end, or the one title they share.

    Only the smallest and the largest title matter: all others lie between them and share what these two share.
    """
    named = F.when(strip(F.col(title)) != "", strip(F.col(title)))
    ends = volumes.groupBy(series).agg(F.min(named).alias("_low"), F.max(named).alias("_high"))
    low, high = F.col("_low"), F.col("_high")
    same = F.size(F.filter(F.sequence(F.lit(1), F.length(low)), lambda k: F.substring(low, F.lit(1), k) == F.substring(high, F.lit(1), k)))
    start = F.regexp_replace(F.substring(low, F.lit(1), same), "[ \\t·—_/-]+$", "")
    return ends.select(series, F.coalesce(F.when(low == high, low).otherwise(start), F.lit("")).alias("title"))


def format_report(chapters: DataFrame, book: str) -> DataFrame:
    """Note chapters and word-count lines of each book."""
    counted = F.size(F.filter("paragraphs", is_word_count_line)).cast("long")
    return chapters.groupBy(book).agg(F.count("*").alias("chapters"), F.count(F.when(is_production(F.col("title"), F.col("paragraphs")), 1)).alias("production"), F.sum(counted).alias("word_count_lines"))


def without_format(chapters: DataFrame) -> DataFrame:
    """Chapters without note chapters and word-count lines."""
    kept = chapters.where(~is_production(F.col("title"), F.col("paragraphs")))
    return kept.withColumn("paragraphs", F.filter("paragraphs", lambda p: ~is_word_count_line(p)))


def with_word_counts(chapters: DataFrame, template: str = "（本章字数：{chars}）") -> DataFrame:
    """A word-count line before the text of every chapter that has any."""
    from quire.functions.text import substituted
    from quire.operators.segment import chars

    line = substituted(template, {"chars": chars(F.col("paragraphs")), "count": chars(F.col("paragraphs"))})
    return chapters.withColumn("paragraphs", F.when(F.size("paragraphs") > 0, F.concat(F.array(line), "paragraphs")).otherwise(F.col("paragraphs")))


def title_records(chapters: DataFrame) -> DataFrame:
    """The first number of each title, and what stands before and after it."""
    t = strip(F.coalesce("title", F.lit("")))
    digits = F.regexp_extract(t, u("(\\d+)"), 1)
    has = digits != ""
    return (
        chapters.withColumn("number", F.when(has, number_of(digits)))
        .withColumn("prefix", F.when(has, F.regexp_extract(t, u("(?s)^(.*?)\\d+"), 1)).otherwise(t))
        .withColumn("content", F.when(has, F.regexp_replace(t, u("(?s)^.*?\\d+"), "")).otherwise(""))
    )


def organised(chapters: DataFrame, book: str, template: str, by_number: bool) -> DataFrame:
    """New order and titles of a tree of chapters (book, chapter_index, parent_index, heading_level, title).

    Siblings are ordered by their numbers if all have one, else as they stand; the order is the
    tree's, parents first, whatever its depth; titles of level 1 stay.  The smallest chapter of a
    cycle of parents counts as one without a parent.
    """
    rows = stored(title_records(chapters.select(book, "chapter_index", "parent_index", "heading_level", "title")), "titles")
    placed = preorder(rows, book, "chapter_index", "parent_index", "number" if by_number else None)
    rows = rows.join(placed.select(book, F.col("node").alias("chapter_index"), F.col("place").alias("new_index"), "seq"), [book, "chapter_index"])
    use = F.lit(by_number) & F.col("number").isNotNull()
    new = strip(F.concat(F.when(use, format_prefix(template, F.col("number"))).otherwise(format_prefix(template, F.col("seq"))), strip(F.when(use, F.col("content")).otherwise(F.coalesce("title", F.lit(""))))))
    return rows.select(book, "new_index", "chapter_index", F.when(F.col("heading_level") == 1, strip(F.coalesce("title", F.lit("")))).otherwise(new).alias("new_title"))


def put_in_order(chapters: DataFrame, book: str, template: str, by_number: bool) -> DataFrame:
    """Chapters in the order of `organised` with its titles, numbered from 1, parents mapped along; `changed` tells new titles."""
    new = organised(chapters, book, template, by_number)
    both = chapters.join(new, [book, "chapter_index"]).withColumn("changed", ~F.col("title").eqNullSafe(F.col("new_title"))).withColumn("title", F.col("new_title")).drop("new_title")
    return remapped(both, book)


def _with_references(resources: DataFrame) -> DataFrame:
    """Resources with `sha`: of their bytes, and for a style sheet also of the package's files that it refers to."""
    own = resources.withColumn("own", F.sha2("content", 256))
    sheets = own.where(F.lower("name").endswith(".css")).select("volume_no", "name", F.decode("content", "UTF-8").alias("content"))
    found = references(sheets, "volume_no").select("volume_no", "name", "target").distinct()
    known = found.join(own.select("volume_no", F.col("name").alias("target"), F.col("own").alias("theirs")), ["volume_no", "target"])
    refers = known.groupBy("volume_no", "name").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("target", "theirs")))), 256).alias("refers"))
    return own.join(refers, ["volume_no", "name"], "left").withColumn("sha", F.when(F.col("refers").isNull(), F.col("own")).otherwise(F.sha2(F.concat("own", "refers"), 256))).drop("own", "refers")


def shared_resources(resources: DataFrame) -> DataFrame:
    """Resources (volume_no, name, content) of merged volumes: equal name and bytes are shared, other bytes under a taken name get the volume's suffix.

    A style sheet is shared only where the files that it refers to are equal too.
    """
    base = F.regexp_extract("name", "([^/]*)$", 1)
    keyed = _with_references(resources).withColumn("base", base)
    first = keyed.groupBy("base", "sha").agg(F.min(F.struct("volume_no", "name")).alias("o"))
    nth = F.row_number().over(Window.partitionBy("base").orderBy("o.volume_no", "sha"))
    named = first.withColumn("nth", nth).withColumn(
        "merged_name", F.when(F.col("nth") == 1, F.col("o.name")).otherwise(F.regexp_replace("o.name", "(\\.[^./]*)?$", "")).cast("string")
    ).withColumn("merged_name", F.when(F.col("nth") == 1, F.col("merged_name")).otherwise(F.concat("merged_name", F.lit("_v"), F.col("o.volume_no").cast("string"), F.regexp_extract("o.name", "(\\.[^./]*)?$", 0))))
    # two sheets of one volume can get one name: later ones are told apart by a further number
    again = F.row_number().over(Window.partitionBy("merged_name").orderBy("o.volume_no", "sha"))
    told = F.when(F.col("again") == 1, F.col("merged_name")).otherwise(F.concat(F.regexp_replace("merged_name", "(\\.[^./]*)?$", ""), F.lit("_"), F.col("again").cast("string"), F.regexp_extract("merged_name", "(\\.[^./]*)?$", 0)))
    named = named.withColumn("again", again).withColumn("merged_name", told)
    return keyed.join(named.select("base", "sha", "merged_name"), ["base", "sha"]).select("volume_no", "name", "merged_name", "sha")


__all__ = ["abnormal", "centre", "char_tree", "format_report", "is_production", "merged_volumes", "organised", "remapped", "shared_resources", "title_records", "volume_chars", "with_word_counts", "without_format"]
