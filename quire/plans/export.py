"""Finished books: volumes merged, terms put right, and written as texts and packages; and terms put right in packages as they are."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.html import spliced
from quire.functions.replace import Replacer, one_pass_each
from quire.functions.text import Cleaning, without_markers
from quire.operators.books import shared_resources
from quire.operators.package import CSS, image_markers, rewritten
from quire.sources import epub


def file_name(title: str) -> str:
    """A title as the name of a file."""
    return re.sub(r'[\\/:*?"<>|\x00-\x1f]+', "_", title).strip(" ._") or "book"


def merged(volumes: DataFrame, title: str = "合集") -> DataFrame:
    """One book (book_id, chapter_index, ...) of the chapters of volumes (volume_no, and the columns of `epub.read_chapters`).

    Before each volume comes a chapter without text, `title` with the volume's number, which is the
    parent of its first level; levels go one deeper, six at the most; source ids and image markers
    are those of the merged package.
    """
    from quire.operators.books import merged_volumes

    placed = merged_volumes(volumes, title).select("volume_no", F.col("chapter_index").alias("_new"), "parent_index", F.col("heading_level").alias("_level"), "is_section", "title")
    inside = placed.where(~F.col("is_section")).withColumn("_n", F.row_number().over(_order("volume_no", "_new")))
    own = volumes.withColumn("_n", F.row_number().over(_order("volume_no", "chapter_index"))).drop("title", "parent_index", "heading_level", "is_section", "chapter_index")
    rest = [c for c in own.columns if c not in ("volume_no", "_n", "source_id", "book_id")]
    body = inside.join(own, ["volume_no", "_n"]).select(
        F.lit(title).alias("book_id"), F.col("_new").alias("chapter_index"), F.concat(F.lit("v"), F.col("volume_no").cast("string"), F.lit(":"), "source_id").alias("source_id"), "title",
        F.col("_level").alias("heading_level"), "parent_index", "is_section", F.concat(F.lit("v"), F.col("volume_no").cast("string")).alias("volume"), *rest,
    )
    empty = {f.name: f.dataType for f in body.schema.fields}
    nodes = placed.where("is_section")
    fixed = {"book_id": F.lit(title), "chapter_index": F.col("_new"), "title": F.col("title"), "heading_level": F.col("_level"), "parent_index": F.col("parent_index"), "is_section": F.lit(True), "paragraphs": F.expr("array()")}
    return body.unionByName(nodes.select(*(fixed.get(c, F.lit(None)).cast(t).alias(c) for c, t in empty.items())))


def _order(group: str, by: str):
    from pyspark.sql import Window

    return Window.partitionBy(group).orderBy(by)


def merged_resources(resources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(book resources, names): resources (volume_no, name, content, is_cover) of the merged package, and the new name of each (volume_no, name).

    Style sheets refer to the new names; the cover is that of the first volume that has one.
    """
    names = shared_resources(resources.select("volume_no", "name", "content")).select("volume_no", "name", F.col("merged_name").alias("new_name"))
    sheets = resources.where(F.lower("name").endswith(".css")).select("volume_no", "name", F.decode("content", "UTF-8").alias("content"))
    led = rewritten(sheets, names, "volume_no", CSS).select("volume_no", "name", F.encode("content", "UTF-8").alias("_css"))
    both = resources.join(names, ["volume_no", "name"]).join(led, ["volume_no", "name"], "left")
    first = both.groupBy(F.col("new_name").alias("name")).agg(F.min_by(F.coalesce("_css", "content"), "volume_no").alias("content"), F.min(F.when(F.col("is_cover"), F.col("volume_no"))).alias("_v"))
    one = first.agg(F.min("_v").alias("_first"))
    return first.crossJoin(F.broadcast(one)).select("name", "content", F.coalesce(F.col("_v") == F.col("_first"), F.lit(False)).alias("is_cover")), names  # one row


def with_new_images(volumes: DataFrame, names: DataFrame) -> DataFrame:
    """Chapters of volumes whose image markers and style sheets have the names of the merged package."""
    by = names.groupBy("volume_no").agg(F.map_from_entries(F.collect_list(F.struct("name", "new_name"))).alias("_names"))
    both = volumes.join(by, "volume_no", "left").withColumn("_names", F.coalesce("_names", F.expr("map()").cast("map<string,string>")))
    out = both.withColumn("paragraphs", image_markers(F.col("paragraphs"), F.col("_names")))
    if "css" in volumes.columns:
        out = out.withColumn("css", F.transform("css", lambda n: F.coalesce(F.try_element_at("_names", n), n)))
    return out.select(*volumes.columns)


def corrected(chapters: DataFrame, pairs: list[tuple[str, str]], cleaning: Cleaning | None = None) -> DataFrame:
    """Chapters with terms replaced in one pass, and cleaned on demand; cleaning leaves places of paragraphs, blank ones too, so that styles still fit."""
    fixed = one_pass_each(F.col("paragraphs"), pairs) if pairs else F.col("paragraphs")
    return chapters.withColumn("paragraphs", F.transform(fixed, cleaning) if cleaning else fixed)


def texts(chapters: DataFrame, book_title: str) -> DataFrame:
    """(book_id, text): the book's title, and each chapter's title and paragraphs without markers, blank lines between."""
    plain = F.filter(F.transform("paragraphs", lambda p: without_markers(p)), lambda p: p != "")
    part = F.concat_ws("\n\n", F.array("title"), plain)
    listed = chapters.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("chapter_index", part.alias("part")))).alias("c"))
    return listed.select("book_id", F.concat(F.lit(book_title + "\n\n"), F.array_join(F.transform("c", lambda x: x["part"]), "\n\n"), F.lit("\n")).alias("text"))


def exported(volumes: DataFrame, resources: DataFrame, pairs: list[tuple[str, str]], title: str = "合集", cleaning: Cleaning | None = None) -> tuple[DataFrame, DataFrame]:
    """(texts, packages) of one book merged from volumes with their resources, terms put right."""
    shared, names = merged_resources(resources)
    chapters = corrected(merged(with_new_images(volumes, names), title), pairs, cleaning)
    titled = chapters.select("book_id").distinct().withColumn("book_title", F.lit(title))
    return texts(chapters, title), epub.to_packages(chapters, shared.withColumn("book_id", F.lit(title)), titled)


def fixed_packages(files: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(path, content, changed): packages (path, content) with terms replaced in the texts of their pages; `changed` counts pages, other bytes stay."""
    change = Replacer(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for page in batch.column("page").to_pylist():
                text, encoding = epub.declared(page)
                text, n = spliced(text, change)
                new.append(text.encode(encoding) if n else page)
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("name"), pa.array(new, pa.binary())], ["path", "name", "page"])

    return epub.entry_changes(files, epub.page_entries(files).mapInArrow(run, "path string, name string, page binary"))


def package_hits(files: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(path, name, src, dst, hits): what `fixed_packages` would replace in each page; nothing is written."""
    replacer = Replacer(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, name, page in zip(*(batch.column(c).to_pylist() for c in ("path", "name", "page")), strict=True):
                seen: dict[str, int] = {}

                def count(text: str, seen: dict[str, int] = seen) -> str:
                    for source, n in replacer.counted(text)[1].items():
                        seen[source] = seen.get(source, 0) + n
                    return text

                spliced(epub.declared(page)[0], count)
                rows += [{"path": path, "name": name, "src": s, "dst": replacer.table[s], "hits": n} for s, n in seen.items()]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("name", pa.string()), ("src", pa.string()), ("dst", pa.string()), ("hits", pa.int64())]))

    return epub.page_entries(files).mapInArrow(run, "path string, name string, src string, dst string, hits long")
