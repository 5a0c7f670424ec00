"""JSON archives of a run and JSON glossaries as tables, and back.

An archive is one row: its header, and what is completed, failed and titled as maps.  Reading
JSON of uncertain types is one Arrow-batched step; checks and changes are columns over the row.
"""

from __future__ import annotations

import base64
import binascii
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import replaced, strip, u
from quire.operators.glossary import SCHEMA as GLOSSARY

_ENTRY = "struct<error:string,chapter_index:int,chapter_title:string,chunk_index:int,paragraphs:array<string>>"
ARCHIVE = (
    "archive string, source string, total_chunks int, chunk_signature string, chunk_chars int, max_paragraph_chars int, txt_patterns array<string>, "
    f"ignore_zero_chapters boolean, completed map<string,array<string>>, failed map<string,{_ENTRY}>, titles map<string,struct<ko:string,zh:string>>, metadata string, problem string"
)
# Marks of a volume at the end of an archive's name.
_COUNT = "[0-9一二三四五六七八九十百千〇零]+"
VOLUME_MARK = f"(?:[\\s_\\-·.:：、]*(?:第\\s*{_COUNT}[卷권册部集篇]|{_COUNT}[卷권册部集篇]|(?:上|中|下)(?:卷|권|册|部|集|篇)?|前传|后传|外传|番外|序章|终章))\\z"
MEDIA = {
    ".css": "text/css", ".ttf": "font/ttf", ".otf": "font/otf", ".woff": "font/woff", ".woff2": "font/woff2", ".eot": "application/vnd.ms-fontobject",
    ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".svg": "image/svg+xml", ".webp": "image/webp",
}


def media_type(name: Column) -> Column:
    """The media type of a file name."""
    table = F.create_map(*(F.lit(x) for pair in MEDIA.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(name, "(\\.[^./\\\\]*)$", 1))), F.lit("application/octet-stream"))


def _texts(value: object) -> list[str] | None:
    return [str(x) for x in value] if isinstance(value, list) else None


def _number(value: object) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) else None


def _failure(value: object) -> dict:
    """A stored failure: a record with its source, or only the error."""
    if not isinstance(value, dict):
        return {"error": str(value), "chapter_index": None, "chapter_title": None, "chunk_index": None, "paragraphs": None}
    return {
        "error": str(value.get("error") or ""), "chapter_index": _number(value.get("chapter_index")) or 0, "chapter_title": str(value.get("chapter_title") or ""),
        "chunk_index": _number(value.get("chunk_index")) or 0, "paragraphs": _texts(value.get("paragraphs")),
    }


def parsed(content: str) -> dict:
    """The fields of an archive; `problem` says why one cannot be used."""
    empty = dict.fromkeys(x.split()[0] for x in ("source", "total_chunks", "chunk_signature", "chunk_chars", "max_paragraph_chars", "txt_patterns", "ignore_zero_chapters", "metadata"))
    try:
        data = json.loads(content)
    except ValueError:
        return empty | {"completed": [], "failed": [], "titles": [], "problem": "not JSON"}
    if not isinstance(data, dict):
        return empty | {"completed": [], "failed": [], "titles": [], "problem": "not an object"}
    done, failed, titles = ({} if data.get(k) is None else data[k] for k in ("completed", "failed", "chapter_titles"))
    problem = "no completed" if not isinstance(done, dict) else "no source" if not data.get("source") else None
    return {
        "source": str(data.get("source") or ""), "total_chunks": _number(data.get("total_chunks")), "chunk_signature": data["chunk_signature"] if isinstance(data.get("chunk_signature"), str) else None,
        "chunk_chars": _number(data.get("chunk_chars")), "max_paragraph_chars": _number(data.get("max_paragraph_chars")), "txt_patterns": _texts(data.get("txt_patterns")),
        "ignore_zero_chapters": data["ignore_zero_chapters"] if isinstance(data.get("ignore_zero_chapters"), bool) else None,
        "completed": [(str(k), _texts(v)) for k, v in done.items()] if isinstance(done, dict) else [],
        "failed": [(str(k), _failure(v)) for k, v in failed.items()] if isinstance(failed, dict) else [],
        "titles": [(str(k), {"ko": str(v.get("ko") or ""), "zh": str(v.get("zh") or "")}) for k, v in titles.items() if isinstance(v, dict)] if isinstance(titles, dict) else [],
        "metadata": json.dumps(data["metadata"], ensure_ascii=False) if data.get("metadata") else None, "problem": problem,
    }


_FAILURE = pa.struct([("error", pa.string()), ("chapter_index", pa.int32()), ("chapter_title", pa.string()), ("chunk_index", pa.int32()), ("paragraphs", pa.list_(pa.string()))])
_KINDS = pa.schema([
    ("archive", pa.string()), ("source", pa.string()), ("total_chunks", pa.int32()), ("chunk_signature", pa.string()), ("chunk_chars", pa.int32()), ("max_paragraph_chars", pa.int32()),
    ("txt_patterns", pa.list_(pa.string())), ("ignore_zero_chapters", pa.bool_()), ("completed", pa.map_(pa.string(), pa.list_(pa.string()))), ("failed", pa.map_(pa.string(), _FAILURE)),
    ("titles", pa.map_(pa.string(), pa.struct([("ko", pa.string()), ("zh", pa.string())]))), ("metadata", pa.string()), ("problem", pa.string()),
])


def from_json(rows: DataFrame) -> DataFrame:
    """Archives of rows (archive, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([{"archive": a} | parsed(c or "") for a, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], _KINDS)

    return rows.select("archive", "content").mapInArrow(run, ARCHIVE)


def read(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Archives in files under a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return from_json(files.select(F.col("path").alias("archive"), F.col("content").cast("string").alias("content")))


def to_json(archives: DataFrame) -> DataFrame:
    """(archive, content): the JSON that `from_json` reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                data = {k: row[k] for k in ("source", "total_chunks", "chunk_signature", "chunk_chars", "max_paragraph_chars", "txt_patterns", "ignore_zero_chapters") if row[k] is not None}
                data |= {"completed": dict(row["completed"] or []), "failed": {k: v if v["paragraphs"] is not None else v["error"] for k, v in row["failed"] or []}, "chapter_titles": dict(row["titles"] or [])}
                out.append(json.dumps(data | ({"metadata": json.loads(row["metadata"])} if row["metadata"] else {}), ensure_ascii=False, indent=2))
            yield pa.RecordBatch.from_arrays([batch.column("archive"), pa.array(out, pa.string())], ["archive", "content"])

    return archives.mapInArrow(run, "archive string, content string")


def summary(archives: DataFrame) -> DataFrame:
    """(archive, title, source, total_chunks, completed, failed, problem)."""
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    title = F.regexp_replace(F.regexp_extract("source", "([^/\\\\]*)$", 1), "(?<=.)\\.[^.]*$", "")
    return archives.select("archive", title.alias("title"), "source", F.coalesce("total_chunks", F.lit(0)).alias("total_chunks"), count(F.col("completed")).alias("completed"), count(F.col("failed")).alias("failed"), "problem")


def for_resume(archives: DataFrame, sources: DataFrame, resume: bool = True) -> DataFrame:
    """Archives for (archive, source): one that is missing, unreadable, of another source, or not to be resumed starts empty."""
    kept = archives.where("problem IS NULL OR problem = 'no completed'") if resume else archives.limit(0)
    both = sources.select("archive", "source").join(kept.drop("problem").withColumnsRenamed({"source": "_source"}), "archive", "left").withColumn("_same", F.coalesce(F.col("_source") == F.col("source"), F.lit(False)))
    fields = [f for f in archives.schema.fields if f.name not in ("archive", "source", "problem")]
    fresh = {"completed": "map()", "failed": "map()", "titles": "map()"}
    keep = [F.when(F.col("_same"), F.col(f.name)).otherwise(F.expr(fresh.get(f.name, "NULL")).cast(f.dataType)).alias(f.name) for f in fields]
    return both.select("archive", "source", *keep, F.lit(None).cast("string").alias("problem"))


def completed(archives: DataFrame) -> DataFrame:
    """(archive, chunk_id, paragraphs); paragraphs are null where the archive has no list."""
    return archives.select("archive", F.explode("completed").alias("chunk_id", "paragraphs"))


def failed(archives: DataFrame) -> DataFrame:
    """(archive, chunk_id, error, chapter_index, chapter_title, chunk_index, paragraphs); paragraphs are null where the source must be cut anew."""
    return archives.select("archive", F.explode("failed").alias("chunk_id", "f")).select("archive", "chunk_id", "f.*")


def titles(archives: DataFrame) -> DataFrame:
    """(archive, key, ko, zh)."""
    return archives.select("archive", F.explode("titles").alias("key", "t")).select("archive", "key", "t.*")


def failure(chunk_id: Column, error: Column, chapter_index: Column, title: Column, chunk_index: Column, paragraphs: Column) -> Column:
    """A map entry for a failed chunk that holds all that is needed to try again."""
    return F.map_from_arrays(F.array(chunk_id), F.array(F.struct(error.alias("error"), chapter_index.cast("int").alias("chapter_index"), title.alias("chapter_title"), chunk_index.cast("int").alias("chunk_index"), paragraphs.alias("paragraphs"))))


def settings(archives: DataFrame, chunk_chars: int, max_paragraph_chars: int, txt_patterns: list[str], ignore_zero_chapters: bool) -> DataFrame:
    """(archive, chunk_chars, max_paragraph_chars, txt_patterns, ignore_zero_chapters): those of the archive where usable, else the given ones."""
    positive = lambda c, other: F.when(F.col(c) > 0, F.col(c)).otherwise(F.lit(other)).alias(c)
    patterns = F.filter("txt_patterns", lambda p: strip(p) != "")
    return archives.select(
        "archive", positive("chunk_chars", chunk_chars), positive("max_paragraph_chars", max_paragraph_chars),
        F.coalesce(patterns, F.lit(txt_patterns).cast("array<string>")).alias("txt_patterns"), F.coalesce("ignore_zero_chapters", F.lit(ignore_zero_chapters)).alias("ignore_zero_chapters"),
    )


def resume_problem(archives: DataFrame, current: DataFrame) -> DataFrame:
    """(archive, problem): why an archive cannot go on with the current (archive, chunk_signature, total_chunks, chunk_chars, max_paragraph_chars, chunk_ids), null if it can.

    A signature decides where the archive has one; else changed settings, another number of
    chunks, or no completed chunk that is still there.  An archive without any work can go on.
    """
    c = current.select("archive", *(F.col(x).alias(f"_{x}") for x in ("chunk_signature", "total_chunks", "chunk_chars", "max_paragraph_chars", "chunk_ids")))
    both = archives.join(c, "archive")
    ids = F.map_keys("completed")
    worked = (F.coalesce("total_chunks", F.lit(0)) != 0) | (F.coalesce(F.size("completed"), F.lit(0)) > 0) | (F.coalesce(F.size("failed"), F.lit(0)) > 0)
    signed = F.coalesce("chunk_signature", F.lit("")) != ""
    settings_ = F.coalesce(F.col("chunk_chars") != F.col("_chunk_chars"), F.lit(False)) | F.coalesce(F.col("max_paragraph_chars") != F.col("_max_paragraph_chars"), F.lit(False))
    other = ((F.col("total_chunks") > 0) & (F.col("total_chunks") != F.col("_total_chunks"))) | ((F.size(ids) > 0) & ~F.arrays_overlap(ids, "_chunk_ids"))
    why = F.when(worked & signed & (F.col("chunk_signature") != F.col("_chunk_signature")), "structure").when(worked & ~signed & settings_, "settings").when(worked & ~signed & F.coalesce(other, F.lit(False)), "chunks")
    return both.select("archive", why.alias("problem"))


def _changed(archives: DataFrame, changes: DataFrame, column: str) -> Column:
    return F.when(F.col("_new").isNull(), F.col(column)).otherwise(F.map_concat(F.map_filter(column, lambda k, _: ~F.map_contains_key("_new", k)), "_new"))


def with_completed(archives: DataFrame, edits: DataFrame) -> DataFrame:
    """Archives with edits (archive, chunk_id, paragraphs, seq) as completed, the last of a chunk counts; they are no longer failed."""
    last = edits.groupBy("archive", "chunk_id").agg(F.max_by("paragraphs", "seq").alias("paragraphs"))
    new = last.groupBy("archive").agg(F.map_from_entries(F.collect_list(F.struct("chunk_id", "paragraphs"))).alias("_new"))
    both = archives.join(new, "archive", "left")
    left = F.when(F.col("_new").isNull(), F.col("failed")).otherwise(F.map_filter("failed", lambda k, _: ~F.map_contains_key("_new", k)))
    return both.withColumn("completed", _changed(archives, edits, "completed")).withColumn("failed", left).select(*archives.columns)


def with_titles(archives: DataFrame, edits: DataFrame) -> DataFrame:
    """Archives with edits (archive, chapter_index, ko, zh, seq) as titles, the last of a chapter counts; blank targets change nothing."""
    filled = edits.withColumn("zh", strip(F.coalesce("zh", F.lit("")))).where("zh <> ''")
    last = filled.groupBy("archive", F.col("chapter_index").cast("string").alias("key")).agg(F.max_by(F.struct("ko", "zh"), "seq").alias("t"))
    new = last.groupBy("archive").agg(F.map_from_entries(F.collect_list(F.struct("key", "t"))).alias("_new"))
    both = archives.join(new, "archive", "left")
    return both.withColumn("titles", _changed(archives, edits, "titles")).select(*archives.columns)


def failed_again(archives: DataFrame, found: DataFrame) -> DataFrame:
    """Archives in which completed chunks (archive, chunk_id, error, chapter_index, chapter_title, chunk_index, paragraphs) are failed instead."""
    entry = F.struct("error", F.col("chapter_index").cast("int").alias("chapter_index"), "chapter_title", F.col("chunk_index").cast("int").alias("chunk_index"), "paragraphs")
    new = found.groupBy("archive").agg(F.map_from_entries(F.collect_list(F.struct("chunk_id", entry.alias("e")))).alias("_new"))
    both = archives.join(new, "archive", "left")
    left = F.when(F.col("_new").isNull(), F.col("completed")).otherwise(F.map_filter("completed", lambda k, _: ~F.map_contains_key("_new", k)))
    return both.withColumn("failed", _changed(archives, found, "failed")).withColumn("completed", left).select(*archives.columns)


def book_title(archive: Column) -> Column:
    """The title that an archive's file name holds, without the mark of a volume."""
    name = strip(F.regexp_replace(F.regexp_extract(archive, "([^/\\\\]*)$", 1), "(?i)(?:\\.translation_state(?:\\.json)?|\\.json)$", ""))
    return F.regexp_replace(strip(replaced(name, u(VOLUME_MARK))), "^\\.+", "")


def state_file(folder: str, name: Column, kind: str = "translation_state") -> Column:
    """The hidden file next to the output that keeps the state of a book; `name` comes from `text.state_name`."""
    return F.concat(F.lit(folder.rstrip("/") + "/."), name, F.lit(f".{kind}.json"))


class _Files:
    """Named contents: bytes in a book, base64 text in JSON."""

    @staticmethod
    def to_json(files: list[dict]) -> list[dict]:
        raw = [(f.get("content") or b"") for f in files]
        return [{"name": str(f.get("name", "")), "content_b64": base64.b64encode(c.encode() if isinstance(c, str) else c).decode()} for f, c in zip(files, raw, strict=True)]

    @classmethod
    def from_json(cls, files: list[dict]) -> list[dict]:
        return [{"name": str(f.get("name", "")), "content": cls._bytes(f.get("content_b64") or f.get("content") or "")} for f in files]

    @staticmethod
    def _bytes(said: str | bytes) -> bytes:
        try:
            return base64.b64decode(said) if isinstance(said, str) else bytes(said)
        except binascii.Error:  # written before contents were encoded
            return said.encode()


class _Lists:
    """Lists by document."""

    @staticmethod
    def to_json(lists: dict) -> dict:
        return {str(k): list(v) for k, v in lists.items()}

    from_json = to_json


class _Same:
    """What JSON has too."""

    @staticmethod
    def to_json(value: dict) -> dict:
        return value

    from_json = to_json


#: The parts of a book's metadata that its archive keeps, and how each is written and read.
METADATA = {"css_resources": _Files, "images": _Files, "doc_inline_css": _Lists, "chapter_css": _Lists, "document_structure": _Same}


def encoded_metadata(metadata: dict) -> dict:
    """Metadata of a book for JSON: the parts of METADATA that it has."""
    return {part: kind.to_json(metadata[part]) for part, kind in METADATA.items() if metadata.get(part)}


def decoded_metadata(data: dict | None) -> dict:
    """The inverse of `encoded_metadata`; contents that are no base64 are the bytes of their text."""
    return {part: kind.from_json(data[part]) for part, kind in METADATA.items() if data.get(part)} if data else {}


def glossary_from_json(rows: DataFrame) -> DataFrame:
    """(glossary, source_text, raw_response, sample_chars, and the columns of an entry) of rows (glossary, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = json.loads(content)
                head = {"glossary": name, "source_text": str(data.get("source_text", "")), "raw_response": str(data.get("raw_response", "")), "sample_chars": int(data.get("sample_chars", 0))}
                for k, e in enumerate(x for x in data.get("entries", []) if isinstance(x, dict)):
                    text = lambda key, other="": str(e.get(key, other)).strip()  # noqa: B023, E731  used at once
                    others, former = e.get("alternatives", ""), e.get("zh_history")
                    out.append(head | {
                        "ord": k, "ko": text("ko"), "zh": text("zh"), "kind": text("kind", "term") or "term", "note": text("note"), "confirmed": bool(e.get("confirmed", False)), "replace_short": bool(e.get("replace_short", False)),
                        "alternatives": [x.strip() for x in (others if isinstance(others, list) else str(others).split(",")) if str(x).strip()], "zh_history": [str(x).strip() for x in former if str(x).strip()] if isinstance(former, list) else [],
                    })
            kinds = [("glossary", pa.string()), ("source_text", pa.string()), ("raw_response", pa.string()), ("sample_chars", pa.int32()), ("ord", pa.int32()), ("ko", pa.string()), ("zh", pa.string()), ("kind", pa.string()), ("note", pa.string()), ("confirmed", pa.bool_()), ("alternatives", pa.list_(pa.string())), ("replace_short", pa.bool_()), ("zh_history", pa.list_(pa.string()))]
            yield pa.RecordBatch.from_pylist(out, pa.schema(kinds))

    return rows.select("glossary", "content").mapInArrow(run, f"glossary string, source_text string, raw_response string, sample_chars int, {GLOSSARY}")


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a glossary file; none where there is no file."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], GLOSSARY)
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("glossary"), F.col("content").cast("string").alias("content"))
    return glossary_from_json(files).select(*(c.split()[0] for c in GLOSSARY.split(", ")))


def glossary_to_json(entries: DataFrame, source_text: str = "", raw_response: str = "", sample_chars: int = 0) -> DataFrame:
    """One row (content): a glossary as the JSON that `glossary_from_json` reads; alternatives as a comma-separated text."""
    entry = F.struct("ko", "zh", "kind", "note", "confirmed", F.array_join("alternatives", ",").alias("alternatives"), "replace_short", "zh_history")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", entry.alias("e")))), lambda x: x["e"])
    whole = F.struct(F.lit(source_text).alias("source_text"), F.lit(raw_response).alias("raw_response"), F.lit(sample_chars).alias("sample_chars"), F.col("entries"))
    return entries.agg(listed.alias("entries")).select(F.to_json(whole, {"pretty": "true"}).alias("content"))


PERSON = "archive string, mode string, source_path string, source_fingerprint string, output_path string, options string, blocks map<string,struct<file:string,index:int,class:string,segments:array<string>,translated:array<string>,status:string,error:string>>, problem string"


def person_from_json(rows: DataFrame) -> DataFrame:
    """Archives of person rewriting of rows (archive, content); `problem` names what is missing: the kind, a path, the options or the blocks."""

    def block(b: dict) -> dict:
        segments = b.get("source_segments") or [str(b.get("source", ""))]
        return {"file": str(b.get("file", "")), "index": _number(b.get("index")) or 0, "class": str(b.get("classification", "narration")), "segments": [str(x) for x in segments], "translated": [str(x) for x in b.get("translated_segments") or []], "status": str(b.get("status", "pending")), "error": str(b.get("error", ""))}

    def one(name: str, content: str) -> dict:
        try:
            data = json.loads(content)
        except ValueError:
            data = None
        said = data if isinstance(data, dict) else {}
        options, blocks = said.get("options"), said.get("blocks")
        wrong = (("not an object", not isinstance(data, dict)), ("kind", said.get("mode") != "first_to_third"), ("source_path", not str(said.get("source_path") or "").strip()), ("output_path", not str(said.get("output_path") or "").strip()), ("options", not isinstance(options, dict)), ("blocks", not isinstance(blocks, dict)))
        text = lambda k: str(said[k]) if said.get(k) is not None else None
        return {
            "archive": name, "mode": text("mode"), "source_path": text("source_path"), "source_fingerprint": text("source_fingerprint"), "output_path": text("output_path"), "options": json.dumps(options, ensure_ascii=False) if isinstance(options, dict) else None,
            "blocks": [(str(k), block(b)) for k, b in blocks.items() if isinstance(b, dict)] if isinstance(blocks, dict) else [], "problem": next((w for w, bad in wrong if bad), None),
        }

    held = pa.struct([("file", pa.string()), ("index", pa.int32()), ("class", pa.string()), ("segments", pa.list_(pa.string())), ("translated", pa.list_(pa.string())), ("status", pa.string()), ("error", pa.string())])
    kinds = pa.schema([*((c, pa.string()) for c in ("archive", "mode", "source_path", "source_fingerprint", "output_path", "options")), ("blocks", pa.map_(pa.string(), held)), ("problem", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([one(a, c or "") for a, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], kinds)

    return rows.select("archive", "content").mapInArrow(run, PERSON)


def person_to_json(archives: DataFrame) -> DataFrame:
    """(archive, content): the JSON that `person_from_json` reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                blocks = {k: {"file": b["file"], "index": b["index"], "classification": b["class"], "source": "".join(b["segments"]), "source_segments": b["segments"], "translated_segments": b["translated"], "status": b["status"], "error": b["error"]} for k, b in r["blocks"] or []}
                out.append(json.dumps({k: r[k] for k in ("mode", "source_path", "source_fingerprint", "output_path")} | {"options": json.loads(r["options"] or "{}"), "blocks": blocks}, ensure_ascii=False, indent=2))
            yield pa.RecordBatch.from_arrays([batch.column("archive"), pa.array(out, pa.string())], ["archive", "content"])

    return archives.mapInArrow(run, "archive string, content string")


def forget(spark: SparkSession, path: str) -> bool:
    """Delete a stored state; whether there was one."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True))
