"""Work done by an external text-completion service, as a resumable plan.

The service is any object with complete(prompt: str) -> str, made once a task by a factory.
Every piece of work gets a completed or a failed entry; a failure never stops the others, and a
later run works on what is still pending.  Entries are appended to a ledger, never rewritten.

Chunks of books are known by their content (`addressed`): the key of an entry is the digest of
all that is asked, so that a run with other sizes, another instruction or an edited text finds
the entries of what is unchanged and asks for the rest, whatever the places of chunks, and equal
chunks are asked for once.  Digests of chapters and books (`structure`) tell what has changed.

Translation, titles, glossaries and rewriting differ in their prompts and in how a reply is
read; the calls themselves are `asked`.
"""

from __future__ import annotations

import contextlib
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.functions.replace import one_pass_each
from quire.functions.replies import json_value, translated
from quire.functions.text import is_decorative, strip
from quire.operators.archive import latest, pending
from quire.sources.archives import ARCHIVE

LEDGER = "chunk_id string, reply string, error string, attempts int, seq long"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Entries that a task hands on together, and seconds between two looks at whether to stop.
HELD, POLL = 16, 0.2


class Completer(Protocol):
    def complete(self, prompt: str) -> str: ...


class JsonRequired:
    """A service whose replies must hold JSON: others count as failures and are asked for again."""

    def __init__(self, service: Completer) -> None:
        self.service = service

    def complete(self, prompt: str) -> str:
        reply = self.service.complete(prompt)
        json_value(reply)
        return reply


def numbered(paragraphs: Column) -> Column:
    """Paragraphs as lines with their numbers from 1."""
    return F.array_join(F.transform(paragraphs, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p)), "\n")


def _prompt(chunks: DataFrame, instruction: str) -> Column:
    head = [F.concat(F.lit("Chapter: "), F.coalesce("title", F.lit(""))), F.concat(F.lit("Paragraphs: "), F.size("paragraphs").cast("string"))] if "title" in chunks.columns else []
    return F.concat_ws("\n", F.lit(instruction), *head, numbered(F.col("paragraphs")))


def prompts(chunks: DataFrame, instruction: str) -> DataFrame:
    """chunk_id and a prompt with numbered paragraphs; with the title and the number of paragraphs where chunks have a title."""
    return chunks.select("chunk_id", _prompt(chunks, instruction).alias("prompt"))


def addressed(chunks: DataFrame, instruction: str) -> DataFrame:
    """Chunks with the digest of what is asked for them as chunk_id; `place` is the id that they had."""
    return chunks.withColumn("place", F.col("chunk_id")).withColumn("chunk_id", F.sha2(_prompt(chunks, instruction), 256))


def structure(addressed_: DataFrame, book: str) -> DataFrame:
    """(book, chapter_index, chunks, digest): digests of chapters from those of their chunks, and of whole books, with a null chapter_index, from those of their chapters."""

    def rows(parts: DataFrame, keys: list[str], order: str, part: str) -> DataFrame:
        listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.col(part).alias("d")))), lambda x: x["d"])
        return parts.groupBy(*keys).agg(F.sum("chunks").alias("chunks"), F.sha2(F.array_join(listed, "\n"), 256).alias("digest"))

    chapters = rows(addressed_.withColumn("chunks", F.lit(1).cast("long")), [book, "chapter_index"], "chunk_index", "chunk_id")
    whole = rows(chapters, [book], "chapter_index", "digest").withColumn("chapter_index", F.lit(None).cast(chapters.schema["chapter_index"].dataType))
    return chapters.unionByName(whole)


def changed(now: DataFrame, before: DataFrame, book: str) -> DataFrame:
    """(book, chapter_index, change) of two structures: new, gone or changed chapters and books; chapters of books with equal digests are not compared."""
    keys = [book, "digest"]
    whole = lambda s: s.where("chapter_index IS NULL").select(*keys)
    same = whole(now).join(whole(before), keys).select(book)
    left = lambda s, name: s.join(same, book, "left_anti").select(book, "chapter_index", F.col("digest").alias(name))
    a, b = left(now, "_now").alias("a"), left(before, "_before").alias("b")
    both = a.join(b, (F.col(f"a.{book}") == F.col(f"b.{book}")) & F.col("a.chapter_index").eqNullSafe(F.col("b.chapter_index")), "full")
    change = F.when(F.col("_before").isNull(), "new").when(F.col("_now").isNull(), "gone").when(F.col("_now") != F.col("_before"), "changed")
    found = both.select(F.coalesce(f"a.{book}", f"b.{book}").alias(book), F.coalesce("a.chapter_index", "b.chapter_index").alias("chapter_index"), change.alias("change"))
    return found.where("change IS NOT NULL")


class Stopped(Exception):
    """The run was stopped while a call was under way."""


class Watched:
    """Counts of a run that grow while it goes on, as its tasks end; a task that is run again counts again."""

    def __init__(self, spark: SparkSession) -> None:
        self.completed, self.failed = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def __call__(self) -> tuple[int, int]:
        """(completed, failed) so far."""
        return self.completed.value, self.failed.value


def _waited(seconds: float, stop: Callable[[], bool] | None, over: Callable[[float], bool]) -> None:
    """Until over(seconds to wait for it) says so or the time is up; looks at `stop` every POLL seconds."""
    until = time.monotonic() + seconds
    while (left := until - time.monotonic()) > 0 and not over(min(left, POLL) if stop is not None else left):
        if stop is not None and stop():
            raise Stopped


def _called(service: Completer, prompt: str, stop: Callable[[], bool] | None) -> str:
    """The reply; where `stop` says so, the call is left to itself in its thread and Stopped is raised."""
    if stop is None:
        return service.complete(prompt)
    said: list[tuple[str | None, Exception | None]] = []

    def work() -> None:
        try:
            said.append((service.complete(prompt), None))
        except Exception as e:  # noqa: BLE001  handed on below
            said.append((None, e))

    thread = threading.Thread(target=work, daemon=True)
    thread.start()

    def over(wait: float) -> bool:
        thread.join(wait)
        return not thread.is_alive()

    _waited(float("inf"), stop, over)
    reply, error = said[0]
    if error is not None:
        raise error
    return reply


def asked(
    work: DataFrame, key: str, factory: Callable[[], Completer], seq: int = 0, retries: int = 4, delay: float = 3.0, tasks: int | None = None,
    stop: Callable[[], bool] | None = None, watched: Watched | None = None,
) -> DataFrame:
    """A ledger entry (with `key` for chunk_id) for every row (key, prompt).

    Waits double after each failure, and `tasks` bounds the calls at a time.  Where `stop` is
    given and says so, a call or wait under way is given up within POLL seconds, and it and the
    rest of the work get no entry and stay pending; what was finished is handed on.
    """
    schema = pa.schema([(key, pa.string()), ("reply", pa.string()), ("error", pa.string()), ("attempts", pa.int32()), ("seq", pa.int64())])

    def one(service: Completer, prompt: str) -> tuple[str | None, str | None, int]:
        error = None
        for attempt in range(1, retries + 1):
            try:
                reply = _called(service, prompt, stop)
                if reply is None:
                    raise ValueError("empty reply")
                return reply, None, attempt
            except Stopped:
                raise
            except Exception as e:  # noqa: BLE001  a service fails in its own ways
                error = f"{type(e).__name__}: {e}"
                if attempt < retries:
                    _waited(delay * 2 ** (attempt - 1), stop, lambda wait: bool(time.sleep(wait)))
        return None, error, retries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        service = None
        for batch in batches:
            held: list[dict] = []
            for name, prompt in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if stop is not None and stop():
                    break
                service = service or factory()
                try:
                    reply, error, attempts = one(service, prompt)
                except Stopped:
                    break
                if watched is not None:
                    (watched.completed if error is None else watched.failed).add(1)
                held.append({key: name, "reply": reply, "error": error, "attempts": attempts, "seq": seq})
                if len(held) == HELD:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, schema)

    dealt = work.select(F.col(key).cast("string").alias(key), "prompt")
    return (dealt.repartition(tasks) if tasks else dealt).mapInArrow(run, LEDGER.replace("chunk_id", key, 1))


def completed(work: DataFrame, factory: Callable[[], Completer], **options) -> DataFrame:
    """A ledger entry for every (chunk_id, prompt)."""
    return asked(work, "chunk_id", factory, **options)


def resumed(chunks: DataFrame, ledger: DataFrame, instruction: str, factory: Callable[[], Completer], **options) -> DataFrame:
    """Entries for the chunks that the ledger's latest entries leave pending."""
    done = latest(ledger, "chunk_id").where(F.col("error").isNull())
    return completed(prompts(pending(chunks, done, "chunk_id"), instruction), factory, **options)


def rounds(spark: SparkSession, chunks: DataFrame, folder: str, instruction: str, factory: Callable[[], Completer], most: int = 3, **options) -> DataFrame:
    """Run until nothing is pending, at most `most` times, and return the ledger kept in `folder`.

    Each round appends a file set, so that a run that is broken off loses its own round alone.
    """
    return _rounds(spark, chunks, folder, instruction, factory, most, **options)[0]


def _rounds(spark: SparkSession, chunks: DataFrame, folder: str, instruction: str, factory: Callable[[], Completer], most: int = 3, **options) -> tuple[DataFrame, bool]:
    """The ledger of `rounds`, and whether it was seen to have a reply for every chunk."""
    ledger = _stored(spark, folder, LEDGER)
    for _ in range(most):
        ledger = spark.read.schema(LEDGER).parquet(folder)
        done = latest(ledger, "chunk_id").where(F.col("error").isNull())
        with shuffles_removed(spark):
            if pending(chunks, done, "chunk_id").isEmpty():
                return ledger, ledger.where("error IS NULL AND reply IS NULL").isEmpty()
            seq = (ledger.agg(F.max("seq")).first()[0] or 0) + 1
            _append(resumed(chunks, ledger, instruction, factory, seq=seq, **options), folder)
    return spark.read.schema(LEDGER).parquet(folder), False


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Files of shuffles go when the query that made them ends: else those of all rounds stay until the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def _append(df: DataFrame, folder: str) -> None:
    df.write.mode("append").option("compression", "zstd").parquet(folder)


def progress(chunks: DataFrame, ledger: DataFrame) -> DataFrame:
    """(total, completed, failed, pending) of the chunks, for a caller that watches a run."""
    last = latest(ledger, "chunk_id").select("chunk_id", F.col("error").isNull().alias("ok"))
    both = chunks.select("chunk_id").join(last, "chunk_id", "left")
    return both.agg(F.count("*").alias("total"), F.count(F.when(F.col("ok"), 1)).alias("completed"), F.count(F.when(~F.col("ok"), 1)).alias("failed"), F.count(F.when(F.col("ok").isNull(), 1)).alias("pending"))


def results(chunks: DataFrame, ledger: DataFrame, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """Chunks with their replies as paragraphs of the expected number, glossary pairs applied, or the source where there is none."""
    done = latest(ledger, "chunk_id").where(F.col("error").isNull()).select("chunk_id", "reply")
    both = chunks.join(done, "chunk_id", "left")
    fitted = translated(F.col("reply"), F.size("paragraphs"))
    fitted = one_pass_each(fitted, pairs) if pairs else fitted
    return both.withColumn("final", F.when(F.col("reply").isNotNull(), fitted).otherwise(F.col("paragraphs"))).drop("reply")


def _replies(chunks: DataFrame, ledger: DataFrame, pairs: list[tuple[str, str]] | None, book: str) -> DataFrame:
    """(book, chapter_index, chunk_index, final) as in `results` where every chunk has a reply: no source text is shuffled."""
    done = latest(ledger, "chunk_id").where(F.col("error").isNull()).select("chunk_id", "reply")
    places = chunks.select("chunk_id", book, "chapter_index", "chunk_index", F.size("paragraphs").alias("_n"))
    fitted = translated(F.col("reply"), F.col("_n"))
    return places.join(done, "chunk_id").select(book, "chapter_index", "chunk_index", (one_pass_each(fitted, pairs) if pairs else fitted).alias("final"))


def title_prompts(chapters: DataFrame, book: str, instruction: str, glossary: str = "none") -> DataFrame:
    """(book, prompt): all titles of a book that are no decoration, with the numbers of their chapters, in one piece of work."""
    plain = chapters.where((F.coalesce("title", F.lit("")) != "") & ~is_decorative(F.col("title")))
    listed = plain.groupBy(book).agg(F.array_sort(F.collect_list(F.struct("chapter_index", "title"))).alias("_t"))
    lines = F.array_join(F.transform("_t", lambda x: F.concat(F.lit("["), x["chapter_index"].cast("string"), F.lit("] "), x["title"])), "\n")
    return listed.select(book, F.concat(F.lit(f"{instruction}\nNames:\n{glossary}\n\nTitles, each after its number:\n"), lines).alias("prompt"))


def title_results(chapters: DataFrame, ledger: DataFrame, book: str) -> DataFrame:
    """Chapters with title_zh from replies {"titles": {"number": title}}; null where a reply has none or cannot be read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, reply in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    said = json_value(reply)
                except ValueError:
                    continue
                titles = said.get("titles") if isinstance(said, dict) else None
                rows += [{"_book": name, "_number": str(k), "_zh": str(v).strip()} for k, v in titles.items() if v] if isinstance(titles, dict) else []
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("_book", pa.string()), ("_number", pa.string()), ("_zh", pa.string())]))

    done = latest(ledger, book).where(F.col("error").isNull()).select(F.col(book).cast("string").alias("_book"), "reply")
    found = done.mapInArrow(read, "_book string, _number string, _zh string").where(strip(F.col("_zh")) != "").dropDuplicates(["_book", "_number"])
    said = (F.coalesce("title", F.lit("")) != "") & ~is_decorative(F.col("title"))
    same = (F.col(book).cast("string") == F.col("_book")) & (F.col("chapter_index").cast("string") == F.col("_number"))
    return chapters.alias("c").join(found.alias("f"), same, "left").select("c.*", F.when(said, F.col("f._zh")).alias("title_zh"))


def assembled_chapters(chapters: DataFrame, done: DataFrame, book: str) -> DataFrame:
    """Chapters with the paragraphs of their finished chunks (book, chapter_index, chunk_index, final) in order; those without chunks keep their own."""
    listed = done.groupBy(book, "chapter_index").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "final"))), lambda x: x["final"])).alias("_p"))
    both = chapters.join(listed, [book, "chapter_index"], "left")
    return both.withColumn("paragraphs", F.when(F.coalesce(F.size("_p"), F.lit(0)) > 0, F.col("_p")).otherwise(F.col("paragraphs"))).select(*chapters.columns)


class Structural(ValueError):
    """A run over other chapters or chunks than the run before it, where that is not wanted."""


def _stored(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    spark.createDataFrame([], schema).write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


class Run(NamedTuple):
    """A finished run: chapters in the target language, the chunks with `place` and final paragraphs, their ledger, and what has changed since the run before."""

    chapters: DataFrame
    chunks: DataFrame
    ledger: DataFrame
    changes: DataFrame


def run(
    spark: SparkSession, chapters: DataFrame, folder: str, instruction: str, factory: Callable[[], Completer], book: str = "book_id",
    pairs: list[tuple[str, str]] | None = None, chunk_chars: int = 1800, paragraph_chars: int = 2600, refuse: bool = False, title_instruction: str | None = None,
    keep: bool = False, **options,
) -> Run:
    """Chapters put through the service chunk by chunk, with ledgers and structures in `folder`; what fails three rounds stays in the source language.

    A later run over the same folder, with whatever sizes, reuses the entries of unchanged chunks
    and asks for all others.  With `refuse` it raises Structural instead, before any call, where
    books that were there before have other chapters or chunks; new books are no change.  With
    `title_instruction` titles are asked for too, a book at a time, and chapters get title_zh.
    With `keep` the finished chunks are written to `folder` before they are put together, so that
    the shuffles of ledger and of chapters do not stand on disks at once.
    """
    from quire.operators.segment import chunks

    cut = addressed(chunks(chapters, chunk_chars, paragraph_chars, book), instruction)
    kind = chapters.schema[book].dataType.simpleString()
    index = cut.schema["chapter_index"].dataType.simpleString()
    stored = _stored(spark, f"{folder}/structure", f"{book} {kind}, chapter_index {index}, chunks long, digest string, run long")
    with shuffles_removed(spark):
        at = (stored.agg(F.max("run")).first()[0] or 0) + 1
    before = stored.where(F.col("run") == at - 1)  # the files that were there when `stored` was read
    now = structure(cut, book)
    changes = changed(now, before, book)
    if refuse:
        known = changes.join(before.where("chapter_index IS NULL").select(book), book).where("chapter_index IS NULL")
        with shuffles_removed(spark):
            others = [r[0] for r in known.select(book).limit(5).collect()]
        if others:
            raise Structural(f"other chapters or chunks than in the run before, in books {others}")
    with shuffles_removed(spark):
        now.withColumn("run", F.lit(at).cast("long")).write.mode("append").parquet(f"{folder}/structure")

    ledger, every = _rounds(spark, cut.dropDuplicates(["chunk_id"]), f"{folder}/ledger", instruction, factory, **options)
    done = results(cut, ledger, pairs)
    # chapters with any text have chunks, which hold all of it; without keys they get none back
    blank = ~F.exists("paragraphs", lambda p: strip(F.coalesce(p, F.lit(""))) != "")
    bare = chapters.withColumn("paragraphs", F.when(blank | F.col(book).isNull() | F.col("chapter_index").isNull(), F.col("paragraphs")))
    said = _replies(cut, ledger, pairs, book) if every else done.select(book, "chapter_index", "chunk_index", "final")
    if keep:
        with shuffles_removed(spark):
            _append(said, path := f"{folder}/finished/{uuid.uuid4().hex}")
        said = spark.read.schema(said.schema).parquet(path)
    finished = assembled_chapters(bare, said, book)
    if title_instruction is not None:
        work = title_prompts(chapters, book, title_instruction)
        keyed = work.withColumn("chunk_id", F.sha2("prompt", 256))
        said = titled(spark, keyed, f"{folder}/titles", factory, **options)
        answers = keyed.select(book, "chunk_id").join(said, "chunk_id").drop("chunk_id")
        finished = title_results(finished, answers, book)
    return Run(finished, done, ledger, changes)


def titled(spark: SparkSession, keyed: DataFrame, folder: str, factory: Callable[[], Completer], **options) -> DataFrame:
    """The ledger in `folder` with an entry for every (chunk_id, prompt) that it did not have yet."""
    ledger = _stored(spark, folder, LEDGER)
    done = latest(ledger, "chunk_id").where(F.col("error").isNull())
    seq = (ledger.agg(F.max("seq")).first()[0] or 0) + 1
    own = {k: v for k, v in options.items() if k != "most"}
    completed(pending(keyed.dropDuplicates(["chunk_id"]), done, "chunk_id"), factory, seq=seq, **own).write.mode("append").parquet(folder)
    return spark.read.schema(LEDGER).parquet(folder)


def translated_books(spark: SparkSession, chapters: DataFrame, folder: str, instruction: str, factory: Callable[[], Completer], **options) -> DataFrame:
    """The chapters of `run`."""
    return run(spark, chapters, folder, instruction, factory, **options).chapters


def archived(run_: Run, sources: DataFrame, book: str = "book_id", chunk_chars: int = 1800, paragraph_chars: int = 2600) -> DataFrame:
    """An archive a book (book, source) in the form that `archives.to_json` writes, with completed and failed chunks by their places and titles where the run has some.

    An archive is one row a book, since it is one file.
    """
    last = latest(run_.ledger, "chunk_id").select("chunk_id", "error", F.col("reply").isNotNull().alias("_ok"))
    each = run_.chunks.join(last, "chunk_id", "left")
    entry = F.struct("error", F.col("chapter_index").cast("int").alias("chapter_index"), F.col("title").alias("chapter_title"), F.col("chunk_index").cast("int").alias("chunk_index"), "paragraphs")
    pick = lambda when, value: F.map_from_entries(F.array_compact(F.collect_list(F.when(when, F.struct("place", value.alias("v"))))))
    order = F.transform(F.array_sort(F.collect_list(F.struct("chapter_index", "chunk_index", "place"))), lambda x: x["place"])
    rows = each.groupBy(book).agg(F.count("*").cast("int").alias("total_chunks"), F.sha2(F.array_join(order, "\n"), 256).alias("chunk_signature"), pick(F.col("_ok"), F.col("final")).alias("completed"), pick(F.col("error").isNotNull(), entry).alias("failed"))
    if "title_zh" in run_.chapters.columns:
        named = run_.chapters.where("title_zh IS NOT NULL").groupBy(book).agg(F.map_from_entries(F.collect_list(F.struct(F.col("chapter_index").cast("string"), F.struct(F.col("title").alias("ko"), F.col("title_zh").alias("zh"))))).alias("titles"))
        rows = rows.join(named, book, "left")
    both = sources.select(F.col(book).cast("string").alias("archive"), "source", F.col(book).alias("_book")).join(rows, F.col("_book") == F.col(book), "left")
    columns = {"chunk_chars": F.lit(chunk_chars), "max_paragraph_chars": F.lit(paragraph_chars)}
    fields = StructType.fromDDL(ARCHIVE).fields
    return both.select(*((columns.get(f.name) if f.name in columns else F.col(f.name) if f.name in both.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))
