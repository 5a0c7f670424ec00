"""Results of an external service kept as an append-only ledger: what is pending, assembly, audits and titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.replies import normalised
from quire.functions.text import hangul_count, is_decorative, numbered_title, strip, u


def latest(ledger: DataFrame, *keys: str) -> DataFrame:
    """The last entry of each key in an append-only ledger (column seq)."""
    return ledger.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("seq")))).where("_n = 1").drop("_n")


def pending(chunks: DataFrame, completed: DataFrame, *keys: str) -> DataFrame:
    """Chunks without a completed entry: the work list of a run."""
    return chunks.join(completed.select(*keys), list(keys), "left_anti")


def same_structure(chunks: DataFrame, completed: DataFrame, *keys: str) -> bool:
    """Whether any completed id is still a chunk; a resume without one is refused."""
    return not completed.join(chunks.select(*keys), list(keys), "left_semi").isEmpty() or completed.isEmpty()


def assembled(chunks: DataFrame, completed: DataFrame, *keys: str) -> DataFrame:
    """Chunks with the completed text, or the source where there is none."""
    joined = chunks.join(completed.select(*keys, F.col("text").alias("done")), list(keys), "left")
    return joined.withColumn("final", F.coalesce("done", "text")).withColumn("translated", F.col("done").isNotNull()).drop("done")


def failed_view(failed: DataFrame, chunks: DataFrame, *keys: str) -> DataFrame:
    """Failed entries with their stored paragraphs, else those of the chunk; missing where there is neither."""
    joined = failed.join(chunks.select(*keys, F.col("paragraphs").alias("own")), list(keys), "left")
    return joined.withColumn("paragraphs", F.coalesce("paragraphs", "own")).withColumn("missing", F.col("paragraphs").isNull()).drop("own")


def untranslated(completed: DataFrame, threshold: int = 30) -> DataFrame:
    """Completed chunks with a paragraph of at least `threshold` Hangul characters."""
    most = F.array_max(F.transform("paragraphs", hangul_count))
    return completed.withColumn("hangul", most).where(F.col("hangul") >= threshold)


def matching(completed: DataFrame, pattern: str) -> DataFrame:
    """Completed chunks whose paragraphs, one a line, match."""
    return completed.where(F.array_join("paragraphs", "\n").rlike(pattern))


def title_audit(titles: DataFrame, archive: str) -> DataFrame:
    """Translated and missing titles of (archive, ko, zh); decorative ones do not count."""
    plain = titles.where((strip(F.coalesce("ko", F.lit(""))) != "") & ~is_decorative(F.col("ko")))
    done = strip(F.coalesce("zh", F.lit(""))) != ""
    return plain.groupBy(archive).agg(F.count("*").alias("titles"), F.count(F.when(done, 1)).alias("translated"), F.count(F.when(~done, 1)).alias("missing"))


def saved_titles(items: DataFrame, archive: str) -> DataFrame:
    """The last entry (by seq) with a translated title for each chapter of an archive; items are (archive, chapter_index, ko, zh, seq)."""
    filled = items.withColumn("zh", strip(F.coalesce("zh", F.lit("")))).where("zh <> ''")
    last = filled.groupBy(archive, "chapter_index").agg(F.max(F.struct("seq", "ko", "zh")).alias("t"))
    return last.select(archive, "chapter_index", "t.ko", "t.zh")


def malformed_issue(raw: Column, parsed: Column, status: Column) -> Column:
    """What is wrong with a completed chunk: its stored values, the paragraphs read from them, and how they were read."""
    plain = F.transform(F.coalesce(raw, F.array().cast("array<string>")), lambda x: strip(F.coalesce(x, F.lit(""))))
    tail = F.slice(plain, F.lit(2), F.size(plain))
    head = F.coalesce(F.get(plain, F.lit(0)), F.lit("")).startswith('{"paragraphs"')
    lines = F.when(head, F.exists(tail, lambda x: x != "")).otherwise(F.size(F.filter(tail, lambda x: x.endswith('",'))) >= 2)
    return (
        F.when(lines, "json lines")
        .when(F.size(F.filter(plain, lambda x: x != "")) == 1, "one blob")
        .when(F.exists(parsed, lambda p: p.rlike("“{2,}|”{2,}")), "run of quotes")
        .when(F.exists(parsed, lambda p: strip(p) == ""), "missing paragraphs")
        .when(status == "fallback_source", "not repairable")
        .otherwise("other")
    )


def malformed(completed: DataFrame, chunks: DataFrame, *keys: str) -> DataFrame:
    """Completed chunks (keys, values) that are not simply fine: (keys, values, source, chapter_index, title, known, parsed, status, issue, repairable, repaired).

    `chunks` has (keys, chapter_index, title, paragraphs); a completed chunk that is no longer among
    them has no source and no expected number.  `repaired` fills gaps from the source.
    """
    both = completed.join(chunks.select(*keys, "chapter_index", "title", F.col("paragraphs").alias("source"), F.lit(True).alias("known")), list(keys), "left").where("values IS NOT NULL")
    own = F.coalesce("source", F.array().cast("array<string>"))
    expected = F.when(F.col("known"), F.size("source"))
    rows = both.withColumn("n", normalised(F.col("values"), expected, own)).select("*", F.col("n.paragraphs").alias("parsed"), F.col("n.status").alias("status")).where("status <> 'ok'").drop("n")
    told = rows.withColumn("issue", malformed_issue(F.col("values"), F.col("parsed"), F.col("status"))).withColumn("repairable", repairable(F.col("parsed"), F.col("status")))
    filled = normalised(F.col("values"), expected, own, fill=True)["paragraphs"]
    return told.withColumn("known", F.coalesce("known", F.lit(False))).withColumn("source", own).withColumn("repaired", F.when(F.col("repairable") & F.col("known"), filled).otherwise(F.array().cast("array<string>")))


def repairable(parsed: Column, status: Column) -> Column:
    """Whether at least two paragraphs were recovered."""
    return (F.size(F.filter(parsed, lambda p: strip(p) != "")) >= 2) & status.isin("recovered", "cleaned")


def repair_counts(found: DataFrame) -> DataFrame:
    """(fixed, skipped, unresolved) of malformed chunks (archive, repairable, repaired); those without an archive are skipped."""
    text = F.exists("repaired", lambda p: strip(p) != "")
    ready = F.col("repairable") & (F.coalesce(F.size("repaired"), F.lit(0)) > 0)
    placed = F.coalesce("archive", F.lit("")) != ""
    count = lambda c, name: F.count(F.when(F.coalesce(c, F.lit(False)), 1)).alias(name)
    return found.agg(count(ready & placed & text, "fixed"), count(ready & ~placed, "skipped"), count(~F.coalesce(ready, F.lit(False)), "unresolved"))


def title_groups(titles: DataFrame) -> DataFrame:
    """Titles (ord, ko) grouped by their core without numbers; the member with the most numbers, the first of those, represents."""
    parts = titles.select("ord", "ko", numbered_title(F.col("ko")).alias("p"))
    keyed = parts.withColumn("core", F.regexp_replace("p.core", u("\\s+"), " ")).withColumn("rank", F.struct((F.col("p.trail") != "").alias("t"), (F.col("p.lead") != "").alias("l"), (-F.col("ord")).alias("o")))
    return keyed.groupBy("core").agg(F.min("ord").alias("first_ord"), F.count("*").alias("members"), F.max_by("ko", "rank").alias("representative"))


def group_titles(titles: DataFrame, translated: DataFrame) -> DataFrame:
    """(ord, ko, zh): the translated title of each group's representative (core, zh) given to all members.

    A number of the translation is exchanged for the member's own; a part that the member lacks is left out.
    """
    own = titles.select("ord", "ko", numbered_title(F.col("ko")).alias("p")).withColumn("core", F.regexp_replace("p.core", u("\\s+"), " "))
    said = translated.select("core", numbered_title(F.col("zh")).alias("r"))

    def part(side: str) -> Column:
        raw, old, new = F.col(f"r.{side}_raw"), F.col(f"r.{side}"), F.col(f"p.{side}")
        at = F.instr(raw, old)
        put = F.concat(F.substring(raw, F.lit(1), at - 1), new, F.substring(raw, at + F.length(old), F.length(raw)))
        return F.when((raw == "") | (new == ""), "").when((old == "") | (at == 0), raw).otherwise(put)

    return own.join(said, "core").select("ord", "ko", strip(F.concat(part("lead"), F.col("r.core"), part("trail"))).alias("zh"))


def matched_titles(saved: DataFrame, chapters: DataFrame, book: str) -> DataFrame:
    """Saved titles (book, key, ko, zh) for chapters (book, chapter_index, title).

    Equal index and title first; then the n-th remaining chapter of a title takes the n-th
    remaining entry with that title, in the order of numeric keys.
    """
    entries = saved.where(strip(F.col("ko")) != "").select(book, F.col("key").cast("string").alias("key"), strip(F.col("ko")).alias("title"), F.coalesce(strip(F.col("zh")), F.lit("")).alias("zh"))
    exact = chapters.select(book, "chapter_index", "title", F.col("chapter_index").cast("string").alias("key")).join(entries, [book, "key", "title"])
    rest = chapters.join(exact.select(book, "chapter_index"), [book, "chapter_index"], "left_anti").where((F.coalesce("title", F.lit("")) != "") & ~is_decorative(F.col("title")))
    free = entries.join(exact.select(book, "key"), [book, "key"], "left_anti")
    number = F.when(F.col("key").rlike("^\\d+$"), F.col("key").cast("long")).otherwise(F.lit(10**9))
    rest = rest.withColumn("nth", F.row_number().over(Window.partitionBy(book, "title").orderBy("chapter_index")))
    free = free.withColumn("nth", F.row_number().over(Window.partitionBy(book, "title").orderBy(number, "key")))
    return exact.select(book, "chapter_index", "title", "zh").unionByName(rest.join(free, [book, "title", "nth"]).select(book, "chapter_index", "title", "zh"))


def missing_titles(saved: DataFrame, chapters: DataFrame, book: str) -> DataFrame:
    """(book, chapter_index, ko, zh): chapters with a title that is no decoration, whose saved title is blank, of another text, or not there."""
    plain = chapters.where((F.coalesce("title", F.lit("")) != "") & ~is_decorative(F.col("title")))
    found = matched_titles(saved, chapters, book).select(book, "chapter_index", "zh")
    both = plain.select(book, "chapter_index", F.col("title").alias("ko")).join(found, [book, "chapter_index"], "left")
    return both.where(F.coalesce("zh", F.lit("")) == "").select(book, "chapter_index", "ko", F.coalesce("zh", F.lit("")).alias("zh"))
