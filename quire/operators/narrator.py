"""Rewriting a narrator's person block by block: options, blocks of pages, batches, and the ledger of results.

The ledger is append-only: one row an event with (file, block, seq, status, segments, error).
The state of a block is its last event; a block without one is pending.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.html import read, skipped, spliced_blocks
from quire.functions.replies import json_value
from quire.functions.replace import one_pass_each
from quire.functions.text import edge_whitespace_kept, strip
from quire.operators.archive import latest
from quire.operators.glossary import valid
from quire.operators.packs import packs
from quire.operators.segment import pack_starts
from quire.sources.epub import declared

# Accepted styles and strategies, the first is the default.
STYLES = ("pronoun", "full_name", "short_name")
STRATEGIES = ("conservative", "coverage")
MODE = "first_to_third"
#: Blocks of a file whose numbers and sizes are gathered in one row.
GATHERED = 10_000
_MARKUP = re.compile(r"<\s*/?\s*[A-Za-z!][^>]*>")


@dataclass(frozen=True)
class Options:
    """What to rewrite and how; `checked` gives the form that is stored and compared on resume."""

    name: str
    short_name: str = ""
    pronoun: str = "他"
    style: str = STYLES[0]
    strategy: str = STRATEGIES[0]
    dialogue: bool = False
    letters: bool = False
    monologue: bool = False
    batch_chars: int = 1800

    def checked(self) -> Options:
        if not self.name.strip():
            raise ValueError("the narrator needs a name")
        if self.batch_chars <= 0:
            raise ValueError("a batch needs a positive number of characters")
        return replace(
            self, name=self.name.strip(), short_name=self.short_name.strip(), pronoun=self.pronoun.strip() or "他",
            style=self.style if self.style in STYLES else STYLES[0], strategy=self.strategy if self.strategy in STRATEGIES else STRATEGIES[0],
        )

    def record(self) -> dict:
        """The checked options as they are stored and compared when a run goes on."""
        return asdict(self.checked())

    def eligible(self, kind: Column) -> Column:
        """Whether blocks of a class are rewritten: all but headings under coverage, else narration and what is switched on."""
        if self.strategy == "coverage":
            return ~kind.isin("heading", "code")
        wanted = {"narration": True, "dialogue": self.dialogue, "letter": self.letters, "monologue": self.monologue}
        return kind.isin(*(k for k, on in wanted.items() if on))


def _body(nodes: DataFrame) -> DataFrame:
    return nodes.where("in_body") if "in_body" in nodes.columns else nodes


def blocks(nodes: DataFrame, file: str, options: Options) -> DataFrame:
    """(file, block, class, segments, chars) of text nodes (file, node, block, tag, class, text), those of the body where nodes tell.

    Blocks keep the number that they have among all blocks of a file; those that are not
    rewritten are left out afterwards.  The class of a block is that of its first node.
    """
    whole = _body(nodes).groupBy(file, "block").agg(
        F.array_sort(F.collect_list(F.struct("node", "text"))).alias("_n"), F.min_by("class", "node").alias("class")
    )
    segments = F.transform("_n", lambda n: n["text"])
    chars = F.aggregate(segments, F.lit(0).cast("long"), lambda a, s: a + F.length(s))
    out = whole.select(file, "block", "class", segments.alias("segments"), chars.alias("chars"))
    return out.where(options.checked().eligible(F.col("class")))


def batches(blocks_: DataFrame, file: str, most: int, gathered: int = GATHERED) -> DataFrame:
    """Blocks (file, block, chars) with the `batch` of their file: greedy, an empty block counts as one character.

    Only numbers and sizes are moved; texts stay where they are.  Files of at most `gathered`
    blocks are folded in a row of their own, larger ones are packed in parallel (`packs`).
    """
    counts = blocks_.groupBy(F.struct(F.col(file).alias("f")).alias("_f")).count().where(F.col("count") > gathered)
    keyed = blocks_.select(file, "block", "chars", F.struct(F.col(file).alias("f")).alias("_f"))
    if counts.isEmpty():
        return _folded(blocks_, file, most)
    large = packs(keyed.join(counts.select("_f"), "_f", "left_semi"), file, "block", "chars", most).select(file, "batch", "block")
    small = keyed.join(counts.select("_f"), "_f", "left_anti")
    return _folded(small, file, most).unionByName(large)


def _folded(blocks_: DataFrame, file: str, most: int) -> DataFrame:
    sizes = blocks_.groupBy(file).agg(F.array_sort(F.collect_list(F.struct("block", F.greatest("chars", F.lit(1)).alias("n")))).alias("_b"))
    starts = sizes.withColumn("_s", pack_starts(F.transform("_b", lambda b: b["n"]), most, 0))
    numbered = starts.select(file, F.posexplode("_s").alias("batch", "_at"), F.slice("_s", F.col("batch") + 2, 1).alias("_next"), "_b")
    members = F.slice("_b", F.col("_at") + 1, F.coalesce(F.get("_next", F.lit(0)), F.size("_b")) - F.col("_at"))
    return numbered.select(file, "batch", F.explode(members).alias("_m")).select(file, "batch", F.col("_m.block").alias("block"))


def state(blocks_: DataFrame, ledger: DataFrame, file: str) -> DataFrame:
    """Every block with status (pending, completed or failed), translated segments and error of its last event."""
    last = latest(ledger, file, "block").select(file, "block", "status", F.col("segments").alias("translated"), "error")
    return blocks_.join(last, [file, "block"], "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def failed(state_: DataFrame) -> DataFrame:
    return state_.where("status = 'failed'").withColumn("translated", F.coalesce("translated", F.array().cast("array<string>"))).withColumn("error", F.coalesce("error", F.lit("")))


def manual(blocks_: DataFrame, edits: DataFrame, file: str) -> DataFrame:
    """Events for edits (file, block, seq, segments) by hand, with a `problem` where one cannot be taken.

    An edit needs a known block, as many segments as it has, none of them blank; the blank edges
    of the source segments are kept.  Rows with a problem have no status and must not be appended.
    """
    both = edits.withColumnRenamed("segments", "given").join(blocks_.select(file, "block", "segments"), [file, "block"], "left")
    blank = F.exists("given", lambda s: F.coalesce(strip(s), F.lit("")) == "")
    problem = (
        F.when(F.col("segments").isNull(), "unknown block")
        .when(F.col("given").isNull() | (F.size("given") != F.size("segments")), "number of segments")
        .when(blank, "blank segment")
    )
    kept = F.zip_with("segments", "given", edge_whitespace_kept)
    out = both.withColumn("problem", problem)
    done = F.col("problem").isNull()
    return out.select(file, "block", "seq", F.when(done, "completed").alias("status"), F.when(done, kept).alias("segments"), F.lit("").alias("error"), "problem")


def failures(blocks_: DataFrame, errors: DataFrame, file: str) -> DataFrame:
    """Events for errors (file, block, seq, error) of known blocks."""
    known = errors.join(blocks_.select(file, "block"), [file, "block"], "left_semi")
    return known.select(file, "block", "seq", F.lit("failed").alias("status"), F.lit(None).cast("array<string>").alias("segments"), F.coalesce("error", F.lit("")).alias("error"))


def progress(state_: DataFrame, file: str) -> DataFrame:
    one = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return state_.groupBy(file).agg(one("completed"), one("failed"), one("pending"))


def preview(blocks_: DataFrame, nodes: DataFrame, file: str, options: Options, samples: int = 5, chars: int = 180) -> DataFrame:
    """One row: how many blocks there are, how many are rewritten, and the first of these, given all blocks (of coverage) and text nodes."""
    whole = _body(nodes).groupBy(file, "block").agg(F.min_by("class", "node").alias("class"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "text"))), lambda n: n["text"]), "").alias("text"))
    wanted = options.checked().eligible(F.col("class"))
    told = F.concat(F.lit("["), F.col(file).cast("string"), F.lit("] "), F.substring("text", 1, chars))
    first = whole.where(wanted).orderBy(file, "block").limit(samples).agg(F.transform(F.array_sort(F.collect_list(F.struct(file, "block", told.alias("t")))), lambda x: x["t"]).alias("samples"))
    total = whole.agg(F.count("*").alias("total"), F.count(F.when(wanted, 1)).alias("eligible"), F.sum(F.length("text")).alias("chars"), F.countDistinct(F.when(wanted, F.col(file))).alias("files"))
    return total.crossJoin(F.broadcast(first)).select("total", "eligible", (F.col("total") - F.col("eligible")).alias("kept"), "chars", "files", "samples")  # two rows of one


def same_run(stored: dict, options: Options, source: str, fingerprint: str) -> str | None:
    """Why a stored run cannot go on: another kind, source, content or other options; None if it can."""
    if stored.get("mode") != MODE:
        return "kind"
    if not str(stored.get("source_path") or "").strip() or stored["source_path"] != source:
        return "source"
    if stored.get("source_fingerprint") != fingerprint:
        return "content"
    said = stored.get("options")
    return None if isinstance(said, dict) and Options(**said).record() == options.record() else "options"


def carried(blocks_: DataFrame, ledger: DataFrame, stored: DataFrame, file: str) -> DataFrame:
    """The events of a stored run that still hold: those of blocks whose segments are unchanged; `stored` has (file, block, segments)."""
    same = blocks_.select(file, "block", F.col("segments").alias("_now")).join(stored.select(file, "block", F.col("segments").alias("_then")), [file, "block"]).where("_now <=> _then")
    return ledger.join(same.select(file, "block"), [file, "block"], "left_semi")


def style_instruction(options: Options) -> str:
    """How the narrator is to be called."""
    o = options.checked()
    return {"pronoun": f"{o.pronoun} wherever it is clear who is meant", "full_name": f"the full name {o.name} where it is natural", "short_name": f"the short name {o.short_name or o.name} where it is natural"}[o.style]


def prompts(numbered: DataFrame, blocks_: DataFrame, file: str, options: Options, entries: DataFrame | None = None) -> DataFrame:
    """(file, batch, prompt): the blocks of each batch (file, batch, block) with names, classes and numbered segments, and what is to be done with them."""
    o = options.checked()
    scope = "All text is here; change the narration alone and leave what others say or write." if o.strategy == "coverage" else "Most of the text is narration; where it is not, leave it."
    head = (
        "Rewrite a first-person narration in the third person.\n"
        f"Narrator: {o.name}. Pronoun: {o.pronoun}. Call the narrator {style_instruction(o)}.\n{scope}\n"
        "Keep facts, tense, tone and names; keep every block and segment, their order and number; write no markup and no remarks.\n"
        'Answer with JSON alone: {"blocks": [{"id": "the block\'s id", "segments": ["text"]}]}.\n'
    )
    one = lambda s, k: F.concat(F.lit("SEGMENT "), k.cast("string"), F.lit(": "), s)
    told = F.concat_ws("\n", F.concat(F.lit("BLOCK "), block_id(F.col(file), F.col("block"))), F.concat(F.lit("CLASS "), "class"), F.array_join(F.transform("segments", one), "\n"), F.lit("END"))
    rows = numbered.join(blocks_, [file, "block"]).groupBy(file, "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", told.alias("t")))), lambda x: x["t"]), "\n").alias("_b"))
    if entries is None:
        return rows.select(file, "batch", F.concat(F.lit(head), F.lit("\n"), "_b").alias("prompt"))
    # the first entry of each target
    names = valid(entries).groupBy(strip(F.col("zh")).alias("zh")).agg(F.min(F.struct("ord", "ko", "kind")).alias("e"))
    line = F.concat(F.lit("- "), "e.ko", F.lit(" -> "), "zh", F.lit(" ("), "e.kind", F.lit(")"))
    listed = names.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("e.ord", line.alias("l")))), lambda x: x["l"]), "\n").alias("_names"))
    return rows.crossJoin(F.broadcast(listed)).select(file, "batch", F.concat(F.lit(head + "Names, to be kept as they are:\n"), "_names", F.lit("\n\n"), "_b").alias("prompt"))  # one row


def block_id(file: Column, block: Column) -> Column:
    return F.concat_ws("#", file.cast("string"), block.cast("string"))


def parsed(reply: str | None, expected: dict[str, list[str]]) -> dict[str, list[str]]:
    """New segments of every expected block (id: source segments); ValueError for a reply that has not exactly these, whole and without markup."""
    try:
        said = json_value(reply)
    except ValueError:
        raise ValueError(f"no JSON: {(reply or '')[:300]}") from None
    items = said.get("blocks") if isinstance(said, dict) else None
    if not isinstance(items, list) or not all(isinstance(i, dict) for i in items):
        raise ValueError("no list of blocks")
    out: dict[str, list[str]] = {}
    for item in items:
        key, segments = str(item.get("id", "")).strip(), item.get("segments")
        if key not in expected or key in out:
            raise ValueError(f"unknown or repeated block {key}")
        if not isinstance(segments, list) or len(segments) != len(expected[key]):
            raise ValueError(f"number of segments of {key}")
        for s in segments:
            if not isinstance(s, str) or not s.strip() or _MARKUP.search(s):
                raise ValueError(f"segment of {key} is no text, blank or markup")
        out[key] = [old[: len(old) - len(old.lstrip())] + new.strip() + old[len(old.rstrip()) :] for old, new in zip(expected[key], segments, strict=True)]
    if missing := sorted(expected.keys() - out.keys()):
        raise ValueError(f"missing blocks {', '.join(missing)}")
    return out


def events(replies: DataFrame, numbered: DataFrame, blocks_: DataFrame, file: str, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """Events for replies (file, batch, seq, reply, error): every block of a batch is completed, or failed with the reason; glossary pairs are applied to new segments."""
    kind, number = blocks_.schema[file].dataType.simpleString(), blocks_.schema["block"].dataType.simpleString()
    listed = numbered.join(blocks_.select(file, "block", "segments"), [file, "block"]).groupBy(file, "batch").agg(F.collect_list(F.struct("block", block_id(F.col(file), F.col("block")).alias("id"), "segments")).alias("blocks"))
    both = replies.select(file, "batch", "seq", "reply", "error").join(listed, [file, "batch"])

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        for batch in batches_:
            kinds = kinds or pa.schema([(file, batch.schema.field(file).type), ("block", pa.int64()), ("seq", pa.int64()), ("status", pa.string()), ("segments", pa.list_(pa.string())), ("error", pa.string())])
            out = []
            for r in batch.to_pylist():
                new, error = {}, r["error"]
                if error is None:
                    try:
                        new = parsed(r["reply"], {b["id"]: b["segments"] for b in r["blocks"]})
                    except ValueError as e:
                        error = str(e)
                out += [{file: r[file], "block": b["block"], "seq": r["seq"], "status": "failed" if error else "completed", "segments": new.get(b["id"]), "error": error or ""} for b in r["blocks"]]
            yield pa.RecordBatch.from_pylist(out, kinds)

    rows = both.withColumn("seq", F.col("seq").cast("long")).mapInArrow(run, f"{file} {kind}, block long, seq long, status string, segments array<string>, error string")
    rows = rows.withColumn("block", F.col("block").cast(number))
    return rows.withColumn("segments", one_pass_each(F.col("segments"), pairs)) if pairs else rows


def rendered(pages: DataFrame, state_: DataFrame, file: str) -> DataFrame:
    """(file, page, changed, done, differ): pages (file, page as bytes) with their completed blocks written in, text alone.

    A block is written whole or not at all; `differ` has those whose source is no longer that of the
    state.  A page keeps its encoding; what that cannot hold is an error.
    """
    ready = state_.where("status = 'completed'").groupBy(file).agg(F.collect_list(F.struct(F.col("block").cast("int").alias("block"), "segments", "translated")).alias("_done"))

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            new, changed, done, differ = [], [], [], []
            for page, blocks__ in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                content, applied, other = page, set(), set()
                if blocks__:
                    text, encoding = declared(page)
                    text, applied, other = spliced_blocks(text, {b["block"]: (b["segments"], b["translated"] or []) for b in blocks__})
                    content = text.encode(encoding) if applied else page
                new.append(content)
                changed.append(content != page)
                done.append(sorted(applied))
                differ.append(sorted(other))
            numbers = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.binary()), pa.array(changed), pa.array(done, numbers), pa.array(differ, numbers)], [file, "page", "changed", "done", "differ"])

    kind = pages.schema[file].dataType.simpleString()
    return pages.join(ready, file, "left").select(file, "page", "_done").mapInArrow(run, f"{file} {kind}, page binary, changed boolean, done array<int>, differ array<int>")


def is_skipped(name: str, page: str) -> bool:
    """Whether a page of a package holds no text of its own."""
    return skipped(name, read(page))
