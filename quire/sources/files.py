"""Books on disk: text files in unknown encodings and EPUB archives, read from Spark's binary file source.

Texts and binary resources go to different tables, so a query on texts never reads an image.
"""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources import epub, packages

KINDS = {".txt": "txt", ".epub": "epub"}


def decode(data: bytes) -> str:
    """Text by its byte-order mark, else the first encoding that fits, else UTF-8 with replacements."""
    if data.startswith((b"\xff\xfe", b"\xfe\xff")):
        return data.decode("utf-16", "replace")
    if data.startswith(b"\xef\xbb\xbf"):
        return data.decode("utf-8-sig", "replace")
    return epub.decode(data)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder that the driver and all executors share; a temporary one only for local masters that name none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """A table written to the shared folder and read again, which cuts its lineage."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """book_id (the path), title (the file's stem) and text of text files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([decode(x.as_py()) for x in batch.column("content")], pa.string())], ["book_id", "text"])

    rows = _files(spark, path, "*.txt").mapInArrow(run, "book_id string, text string")
    return rows.select("book_id", F.regexp_extract("book_id", "([^/]*)\\.[^.]*$", 1).alias("title"), "text")


def entries(spark: SparkSession, path: str) -> DataFrame:
    """book_id, name, content and sha of every entry of EPUB archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for book, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for name in z.namelist():
                        if not name.endswith("/"):
                            data = z.read(name)
                            yield pa.RecordBatch.from_pydict({"book_id": [book], "name": [name], "content": [data], "sha": [hashlib.sha256(data).hexdigest()]})

    return _files(spark, path, "*.epub").mapInArrow(run, "book_id string, name string, content binary, sha string")


def epub_chapters(data: bytes) -> list[tuple[int, str, str, int, list[str]]]:
    """(spine position, name, title, heading level, paragraphs) of a package."""
    p = epub.package(data)
    return [(c.chapter_index, p.items[c.source_id].name, c.title, c.heading_level, c.paragraphs) for c in epub.chapters(p)]


def epubs(spark: SparkSession, path: str) -> DataFrame:
    """Chapters of EPUB archives; `quire.sources.epub` has their contents and resources."""
    return epub.load(spark, path)


def epub_bytes(title: str, chapters: list[tuple[str, list[str]]]) -> bytes:
    """An EPUB archive of (title, paragraphs) chapters; the same input gives the same bytes."""
    from html import escape

    page = '<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{t}</title></head><body><h1>{t}</h1>{b}</body></html>'
    names = [f"chap_{i:04d}.xhtml" for i in range(len(chapters))]
    items = "".join(f'<item id="c{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate(names))
    spine = "".join(f'<itemref idref="c{i}"/>' for i in range(len(names)))
    package = f'<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{escape(title)}</dc:title></metadata><manifest>{items}</manifest><spine>{spine}</spine></package>'
    container = '<?xml version="1.0"?><container xmlns="urn:oasis:names:tc:opendocument:xmlns:container" version="1.0"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    files = {"mimetype": "application/epub+zip", "META-INF/container.xml": container, "OEBPS/content.opf": package}
    files |= {f"OEBPS/{n}": page.format(t=escape(t), b="".join(f"<p>{escape(p)}</p>" for p in ps)) for n, (t, ps) in zip(names, chapters, strict=True)}
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return held.getvalue()


def written_epubs(chapters: DataFrame) -> DataFrame:
    """(book_id, content): an archive for each book of (book_id, chapter_index, title, paragraphs)."""
    books = chapters.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("chapter_index", "title", "paragraphs"))).alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [epub_bytes(str(b), [(x["title"] or "", x["paragraphs"] or []) for x in c]) for b, c in zip(batch.column("book_id").to_pylist(), batch.column("c").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("book_id"), pa.array(made, pa.binary())], ["book_id", "content"])

    kind = chapters.schema["book_id"].dataType.simpleString()
    return books.mapInArrow(run, f"book_id {kind}, content binary")


def written_texts(chapters: DataFrame) -> DataFrame:
    """(book_id, text): chapter titles and paragraphs with blank lines between."""
    part = F.concat_ws("\n\n", F.array("title"), "paragraphs")
    listed = chapters.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("chapter_index", part.alias("part")))).alias("c"))
    return listed.select("book_id", F.array_join(F.transform("c", lambda x: x["part"]), "\n\n").alias("text"))


def load(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Books of a registered kind, `txt` or `epub`."""
    if kind not in KINDS.values():
        raise ValueError(f"unknown kind of book: {kind}")
    return texts(spark, path) if kind == "txt" else epubs(spark, path)


__all__ = ["decode", "entries", "epub_bytes", "epub_chapters", "epubs", "load", "texts", "written_epubs", "written_texts"]


def books(spark: SparkSession, path: str, heading_patterns: tuple[str, ...] | None = None, drop_zero: bool = False) -> DataFrame:
    """Chapters (book_id, chapter_index, title, heading_level, parent_index, paragraphs) of all books under a path, text files and packages by their suffixes.

    A single file of another kind is refused; in folders other files are left out.  With
    `drop_zero` chapters without text go and the others are numbered anew.
    """
    from quire.operators.segment import HEADINGS, chapters, without_empty

    ending = os.path.splitext(path.rstrip("/"))[1].lower()
    if ending and ending not in KINDS and not path.endswith("/") and "*" not in path:
        raise ValueError(f"unknown kind of book: {path}")
    names = ("book_id", "chapter_index", "title", "heading_level", "parent_index", "paragraphs")
    parts = []
    if KINDS.get(ending, "txt") == "txt":
        cut = chapters(texts(spark, path), heading_patterns or HEADINGS)
        parts.append(cut.withColumns({"heading_level": F.lit(1), "parent_index": F.lit(None).cast("int")}).select(*names))
    if KINDS.get(ending, "epub") == "epub":
        parts.append(epub.load(spark, path).select(*names))
    found = reduce(DataFrame.unionByName, parts)
    return without_empty(found) if drop_zero else found


def save_texts(chapters: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Books as text files `book_id.txt` under a folder."""
    packages.publish(written_texts(chapters).select(F.concat(F.col("book_id").cast("string"), F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content")), folder, overwrite)


def save_packages(chapters: DataFrame, folder: str, resources: DataFrame | None = None, titles: DataFrame | None = None, overwrite: bool = False) -> None:
    """Books as packages `book_id.epub` under a folder."""
    made = epub.to_packages(chapters, resources, titles)
    packages.publish(made.select(F.concat(F.col("book_id").cast("string"), F.lit(".epub")).alias("name"), "content"), folder, overwrite)


def save_json(rows: DataFrame, key: str, folder: str, overwrite: bool = False) -> None:
    """Archives or glossaries (key, content) as files `key.json` under a folder."""
    packages.publish(rows.select(F.concat(F.col(key).cast("string"), F.lit(".json")).alias("name"), F.col("content").cast("binary").alias("content")), folder, overwrite)
