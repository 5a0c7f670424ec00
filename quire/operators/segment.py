"""Books to chapters, chapters to pieces and chunks, and back.

A book is one row with its text, so segmentation and packing are expressions over the row: no
shuffle, whatever the number of books.  Every list position becomes an explicit ordinal.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import SENTENCE_END, let, normalized_title, strip, strip_invisible, u, valid_pattern

# Headings of the books that are read.
HEADINGS = (
    "(?iU)^\\s*(?:제\\s*)?(?:\\d{1,4}|[一二三四五六七八九十百千零〇]+)\\s*(?:장|화|부|편|권|막)\\b",
    "(?iU)^\\s*(?:프롤로그|에필로그|서문|발문|후기|외전|번외\\s*편?|side\\s*story|chapter\\s*\\d+|prologue|epilogue)\\s*[:.]?",
)
HEADING_CHARS = 90
FALLBACK_CHARS = 8000


def heading_patterns(given: list[str] | tuple[str, ...]) -> tuple[str, ...]:
    """A user's patterns, matched from the start of a line whatever the case; blank and broken ones are left out, and where none is left the fixed ones hold."""
    said = [p.strip() for p in given if p and p.strip()]
    return tuple(f"(?i)^(?:{u(p)})" for p in said if valid_pattern(p)) or HEADINGS


def lines(text: Column) -> Column:
    """Lines without format characters; CRLF and CR count as line ends."""
    return F.transform(F.split(F.regexp_replace(text, "\\r\\n?", "\n"), "\n", -1), strip_invisible)


def is_heading(line: Column, patterns: tuple[str, ...] = HEADINGS) -> Column:
    """A line of at most HEADING_CHARS that matches a pattern; stripped once and matched once."""
    either = "|".join(f"(?:{p})" for p in patterns) or "(?!)"
    return let(strip(line), lambda s: (F.length(s) > 0) & (F.length(s) <= HEADING_CHARS) & s.rlike(either))


def pack_starts(sizes: Column, most: int, extra: int = 1) -> Column:
    """First positions of greedy packs: a piece opens a new one if with it (and `extra` a piece) the pack would exceed `most`."""
    empty = F.struct(F.lit(0).cast("long").alias("held"), F.array().cast("array<int>").alias("starts"))
    numbered = F.transform(sizes, lambda n, i: F.struct(n.cast("long").alias("n"), i.alias("i")))

    def step(acc: Column, x: Column) -> Column:
        full = (F.size(acc["starts"]) == 0) | (acc["held"] + x["n"] + extra > most)
        return F.when(full, F.struct((x["n"] + extra).alias("held"), F.concat(acc["starts"], F.array(x["i"])).alias("starts"))).otherwise(
            F.struct((acc["held"] + x["n"] + extra).alias("held"), acc["starts"].alias("starts"))
        )

    return F.aggregate(numbered, empty, step, lambda acc: acc["starts"])


def cut_at(items: Column, starts: Column) -> Column:
    """Slices of an array from each start to the next."""
    return let(items, lambda a: let(starts, lambda s: F.transform(s, lambda b, k: F.slice(a, b + 1, F.coalesce(F.get(s, k + 1), F.size(a)) - b))))


def packed(pieces: Column, most: int, extra: int = 1) -> Column:
    """Greedy packs of an array of texts."""
    return let(pieces, lambda a: cut_at(a, pack_starts(F.transform(a, F.length), most, extra)))


def _filled(paragraphs: Column) -> Column:
    return F.filter(paragraphs, lambda p: strip(p) != "")


def chapter_list(text: Column, patterns: tuple[str, ...] = HEADINGS) -> Column:
    """Array of (title, paragraphs): headings open chapters, lines before the first form 正文, and a text without headings is packed by size."""

    def chapters(all_lines: Column) -> Column:
        marks = F.filter(F.transform(all_lines, lambda x, i: F.when(is_heading(x, patterns), i)), lambda i: i.isNotNull())

        def cut(heads: Column) -> Column:
            parts = F.transform(cut_at(all_lines, heads), lambda p: F.struct(strip(F.element_at(p, 1)).alias("title"), F.transform(_filled(F.slice(p, F.lit(2), F.size(p))), strip).alias("paragraphs")))
            before = _filled(F.slice(all_lines, F.lit(1), F.coalesce(F.get(heads, F.lit(0)), F.lit(0))))
            lead = F.when(F.size(before) > 0, F.array(F.struct(F.lit("正文").alias("title"), before.alias("paragraphs")))).otherwise(F.slice(parts, 1, 0))
            whole = F.transform(packed(F.transform(_filled(all_lines), strip), FALLBACK_CHARS), lambda p, i: F.struct(F.concat(F.lit("第 "), (i + 1).cast("string"), F.lit(" 节")).alias("title"), p.alias("paragraphs")))
            return F.when(F.size(heads) > 0, F.concat(lead, parts)).otherwise(whole)

        return let(marks, cut)

    return let(lines(F.coalesce(text, F.lit(""))), chapters)


def chapters(books: DataFrame, patterns: tuple[str, ...] = HEADINGS, book: str = "book_id") -> DataFrame:
    """Rows (book, chapter_index, title, paragraphs) of (book, text); indices are dense from 0."""
    listed = books.select(book, F.posexplode(chapter_list(F.col("text"), patterns)).alias("chapter_index", "c"))
    return listed.select(book, "chapter_index", F.col("c.title").alias("title"), F.col("c.paragraphs").alias("paragraphs"))


def chars(paragraphs: Column) -> Column:
    """Characters without the line ends between paragraphs."""
    return F.aggregate(paragraphs, F.lit(0).cast("long"), lambda a, p: a + F.length(p))


def chars_joined(paragraphs: Column) -> Column:
    """Characters with one line end between paragraphs."""
    return chars(paragraphs) + F.greatest(F.size(paragraphs) - 1, F.lit(0))


def heading_preview(books: DataFrame, patterns: tuple[str, ...] = HEADINGS, book: str = "book_id") -> DataFrame:
    """Heading lines of each book, or the default chapter titles where no line matches."""
    found = F.transform(F.filter(lines(F.col("text")), lambda x: is_heading(x, patterns)), strip)
    titles = F.transform(chapter_list(F.col("text")), lambda c: c["title"])
    return books.select(book, F.posexplode(let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(titles))).alias("ord", "title"))


def without_empty(chapters_: DataFrame, book: str = "book_id") -> DataFrame:
    """Chapters with text, renumbered from 0; a parent keeps pointing at the same chapter, or at none if that is gone."""
    order = Window.partitionBy(book).orderBy("chapter_index")
    kept = chapters_.where(chars(F.col("paragraphs")) > 0).withColumn("new_index", F.row_number().over(order) - 1)
    return remapped(kept, book)


def renumbered(chapters_: DataFrame, book: str = "book_id", base: int = 1) -> DataFrame:
    """Dense indices from `base` in the present order, parents mapped along."""
    order = Window.partitionBy(book).orderBy("chapter_index")
    return remapped(chapters_.withColumn("new_index", F.row_number().over(order) - 1 + base), book)


def remapped(numbered: DataFrame, book: str) -> DataFrame:
    """new_index in place of chapter_index, for parents too."""
    if "parent_index" not in numbered.columns:
        return numbered.withColumn("chapter_index", F.col("new_index")).drop("new_index")
    parents = numbered.select(book, F.col("chapter_index").alias("parent_index"), F.col("new_index").alias("new_parent"))
    rest = [c for c in numbered.columns if c not in (book, "chapter_index", "parent_index", "new_index")]
    return numbered.join(parents, [book, "parent_index"], "left").select(book, F.col("new_index").alias("chapter_index"), F.col("new_parent").alias("parent_index"), *rest)


def smart_split(text: Column, most: int) -> Column:
    """Pieces of at most `most` characters: lines; long lines by sentences joined with a blank; the rest cut hard."""
    if most <= 0:
        raise ValueError("most must be positive")

    def push(value: Column) -> Column:
        hard = F.transform(F.sequence(F.lit(0), F.ceil(F.length(value) / most).cast("int") - 1), lambda i: strip(F.substring(value, i * most + 1, F.lit(most))))
        return F.when(F.length(value) == 0, F.array().cast("array<string>")).when(F.length(value) <= most, F.array(value)).otherwise(hard)

    def sentences(part: Column) -> Column:
        empty = F.struct(F.lit("").alias("buffer"), F.array().cast("array<string>").alias("out"))

        def step(acc: Column, s: Column) -> Column:
            return let(strip(F.concat(acc["buffer"], F.lit(" "), s)), lambda joined: F.when(
                (acc["buffer"] != "") & (F.length(joined) > most), F.struct(strip(s).alias("buffer"), F.concat(acc["out"], let(strip(acc["buffer"]), push)).alias("out"))
            ).otherwise(F.struct(joined.alias("buffer"), acc["out"].alias("out"))))

        return F.aggregate(F.split(part, f"(?<=[{SENTENCE_END}])", -1), empty, step, lambda acc: F.concat(acc["out"], let(strip(acc["buffer"]), push)))

    parts = F.filter(F.transform(F.split(strip(text), "\\n+"), strip), lambda p: p != "")
    pieces = F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(sentences(p))))
    return F.filter(pieces, lambda p: p != "")


_SENTENCES = re.compile(f"(?<=[{SENTENCE_END}])")


def text_pieces(text: str, most: int) -> list[str]:
    """What `smart_split` gives, for use in Arrow batches."""
    out: list[str] = []

    def close(held: str) -> None:
        out.extend(held[k : k + most].strip() for k in range(0, len(held), most))

    for line in text.strip().split("\n"):
        line, held = line.strip(), ""
        if len(line) <= most:
            out.append(line)
            continue
        for sentence in _SENTENCES.split(line):
            longer = f"{held} {sentence}".strip()
            if held and len(longer) > most:
                close(held)
                longer = sentence.strip()
            held = longer
        close(held)
    return [p for p in out if p]


def text_packs(pieces: list[str], most: int) -> list[list[str]]:
    """What `packed` gives, for use in Arrow batches."""
    out: list[list[str]] = []
    room = 0
    for p in pieces:
        if not out or len(p) + 1 > room:
            out.append([])
            room = most
        out[-1].append(p)
        room -= len(p) + 1
    return out


def chunks(chapters_: DataFrame, chunk_chars: int = 1800, paragraph_chars: int = 2600, book: str = "book_id") -> DataFrame:
    """Rows (book, chunk_id, chapter_index, title, chunk_index, paragraphs): pieces packed to `chunk_chars`, never across chapters.

    A fold over sentences of unbounded texts is one Arrow-batched pass: as expressions it would copy
    what is held at every step.
    """
    most = min(chunk_chars, paragraph_chars)
    if most <= 0:
        raise ValueError("chunks need a positive number of characters")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packs = [text_packs([q for p in paragraphs or [] for q in text_pieces(p or "", most)], chunk_chars) for paragraphs in batch.column("paragraphs").to_pylist()]
            of = pa.array([k for k, found in enumerate(packs) for _ in found], pa.int64())
            index = pa.array([i for found in packs for i in range(len(found))], pa.int32())
            kept = [batch.column(c).take(of) for c in (book, "chapter_index", "title")]
            yield pa.RecordBatch.from_arrays([*kept, index, pa.array([p for found in packs for p in found], pa.list_(pa.string()))], [book, "chapter_index", "title", "chunk_index", "paragraphs"])

    kind = {c: chapters_.schema[c].dataType.simpleString() for c in (book, "chapter_index", "title")}
    rows = chapters_.select(book, "chapter_index", "title", "paragraphs").mapInArrow(run, ", ".join(f"{c} {k}" for c, k in kind.items()) + ", chunk_index int, paragraphs array<string>")
    return rows.select(book, F.format_string("ch-%05d-%05d", "chapter_index", "chunk_index").alias("chunk_id"), "chapter_index", "title", "chunk_index", "paragraphs")


def signature(chunks_: DataFrame, book: str = "book_id") -> DataFrame:
    """SHA-256 of each book's chunk ids in order, one a line."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chapter_index", "chunk_index", "chunk_id"))), lambda x: x["chunk_id"])
    return chunks_.groupBy(book).agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("signature"), F.count("*").alias("total_chunks"))


def _resplit_title(pattern: str, group: int) -> Column:
    """The group of a match, or the whole match where the group took no part."""
    whole = strip(F.regexp_extract("text", u(pattern), 0))
    return whole if not group else F.coalesce(F.nullif(strip(F.regexp_extract("text", u(pattern), group)), F.lit("")), whole)


def _resplit_parts(stream: DataFrame, pattern: str, book: str, order: list[str]) -> DataFrame:
    seen = Window.partitionBy(book).orderBy(*order)
    marked = stream.where(strip(F.col("text")) != "").withColumn("hit", F.col("text").rlike(u(pattern)))
    return marked.withColumn("part", F.sum(F.col("hit").cast("int")).over(seen)).withColumn("ends", F.max("part").over(Window.partitionBy(book)))


def resplit(stream: DataFrame, pattern: str, group: int = 0, book: str = "book_id") -> DataFrame:
    """Paragraphs (book, ord, text) cut at lines that match; a last heading without text is dropped, earlier ones stay."""
    rows = _resplit_parts(stream, pattern, book, ["ord"]).groupBy(book, "part").agg(
        F.coalesce(F.max(F.when(F.col("hit"), _resplit_title(pattern, group))), F.lit("正文")).alias("title"),
        F.count(F.when(~F.col("hit"), 1)).alias("n_paragraphs"),
        F.coalesce(F.sum(F.when(~F.col("hit"), F.length("text"))), F.lit(0)).alias("chars"),
        F.max("ends").alias("ends"),
    )
    kept = rows.where((F.col("n_paragraphs") > 0) | (F.col("part") < F.col("ends")))
    return kept.withColumn("chapter_index", F.row_number().over(Window.partitionBy(book).orderBy("part"))).select(book, "chapter_index", "title", "n_paragraphs", "chars")


def resplit_stream(stream: DataFrame, pattern: str, group: int, book: str, order: list[str]) -> DataFrame:
    """As `resplit`, with the paragraphs themselves: (book, chapter_index, title, paragraphs)."""
    rows = _resplit_parts(stream, pattern, book, order).groupBy(book, "part").agg(
        F.coalesce(F.max(F.when(F.col("hit"), _resplit_title(pattern, group))), F.lit("正文")).alias("title"),
        F.array_sort(F.collect_list(F.when(~F.col("hit"), F.struct(*order, "text")))).alias("p"), F.max("ends").alias("ends"),
    )
    kept = rows.where((F.size("p") > 0) | (F.col("part") < F.col("ends")))
    number = F.row_number().over(Window.partitionBy(book).orderBy("part"))
    return kept.select(book, number.alias("chapter_index"), "title", F.transform("p", lambda x: x["text"]).alias("paragraphs"))


def clean_title(c: Column) -> Column:
    return normalized_title(c)
