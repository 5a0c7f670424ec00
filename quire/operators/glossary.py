"""Terminology as relations: rows (ord, ko, zh, kind, note, confirmed, alternatives, replace_short, zh_history)."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.replace import GLOSSARY_CHARS
from quire.functions.text import strip

SCHEMA = "ord int, ko string, zh string, kind string, note string, confirmed boolean, alternatives array<string>, replace_short boolean, zh_history array<string>"
#: Shorter alternatives replace too much (fixed value).
LEAST_ALTERNATIVE = 2


def _first(rows: DataFrame, key: str) -> DataFrame:
    order = Window.partitionBy(key).orderBy("ord")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def given(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def valid(entries: DataFrame, without_ko: bool = False) -> DataFrame:
    """Entries with a target and a source; with `without_ko` alternatives or history are source enough."""
    other = (F.size("alternatives") > 0) | (F.size("zh_history") > 0)
    return entries.where(given(F.col("zh")) & (given(F.col("ko")) | (other if without_ko else F.lit(False))))


def looks_common(entries: DataFrame) -> DataFrame:
    return entries.agg(F.coalesce(F.bool_or(~given(F.col("ko")) & ((F.size("alternatives") > 0) | (F.size("zh_history") > 0))), F.lit(False)).alias("common"))


def deduplicated(entries: DataFrame) -> DataFrame:
    """The first entry of each ko; entries without one go."""
    return _first(entries.where(given(F.col("ko"))), "ko")


def appended(entries: DataFrame, more: DataFrame) -> DataFrame:
    """Entries and those of `more` with a new ko, the first of each; they come after in order."""
    new = _first(more.where(given(F.col("ko")) & given(F.col("zh"))), "ko").join(entries.select("ko"), "ko", "left_anti")
    end = entries.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("end"))
    placed = new.crossJoin(F.broadcast(end)).withColumn("ord", (F.col("ord") + F.col("end") + 1).cast("int"))  # one row
    return entries.unionByName(placed.select(*entries.columns))


def removed(entries: DataFrame, kos: DataFrame) -> DataFrame:
    return entries.join(kos, "ko", "left_anti")


def _with_history(history: Column, old: Column, new: Column) -> Column:
    changed = (old != new) & given(old) & ~F.array_contains(history, old)
    return F.when(F.coalesce(changed, F.lit(False)), F.concat(history, F.array(old))).otherwise(history)


def upserted(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """Entries with the changes applied by ko (the last of each counts); a changed target goes to the history, replace_short stays."""
    last = changes.withColumn("_n", F.row_number().over(Window.partitionBy("ko").orderBy(F.desc("ord")))).where("_n = 1").drop("_n")
    # new ones come after the others, in the order of the changes
    end = entries.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("_end"))
    last = last.crossJoin(F.broadcast(end))  # one row
    both = entries.alias("e").join(last.alias("c"), "ko", "full_outer")
    old, new = F.col("e.ord").isNotNull(), F.col("c.ord").isNotNull()
    pick = lambda c: F.when(new, F.col(f"c.{c}")).otherwise(F.col(f"e.{c}")).alias(c)
    return both.select(
        F.coalesce("e.ord", F.col("c.ord") + F.col("c._end") + 1).cast("int").alias("ord"), "ko", pick("zh"), pick("kind"), pick("note"), pick("confirmed"), pick("alternatives"),
        F.when(old, F.col("e.replace_short")).otherwise(F.col("c.replace_short")).alias("replace_short"),
        F.when(old & new, _with_history(F.col("e.zh_history"), F.col("e.zh"), F.col("c.zh"))).when(old, F.col("e.zh_history")).otherwise(F.col("c.zh_history")).alias("zh_history"),
    )


def overridden(entries: DataFrame, common: DataFrame) -> DataFrame:
    """Targets of the common list where it has the same ko (its last entry counts)."""
    by_ko = valid(common, without_ko=True).where(given(F.col("ko"))).groupBy("ko").agg(F.max_by("zh", "ord").alias("common_zh"))
    both = entries.join(by_ko, "ko", "left")
    changed = F.col("common_zh").isNotNull() & (F.col("common_zh") != F.col("zh"))
    return both.select(
        "ord", "ko", F.when(changed, F.col("common_zh")).otherwise(F.col("zh")).alias("zh"), "kind", "note", "confirmed", "alternatives", "replace_short",
        F.when(changed, _with_history(F.col("zh_history"), F.col("zh"), F.col("common_zh"))).otherwise(F.col("zh_history")).alias("zh_history"),
        F.coalesce(changed, F.lit(False)).alias("overridden"),
    )


def clean_alternatives(tokens: Column, ko: Column, zh: Column) -> Column:
    """Trimmed, distinct, neither ko nor zh nor too short, in first-seen order."""
    return F.filter(F.array_distinct(F.transform(tokens, strip)), lambda t: (F.length(t) >= LEAST_ALTERNATIVE) & (t != ko) & (t != zh))


def merged_alternatives(a: Column, b: Column, ko: Column, zh: Column) -> Column:
    return clean_alternatives(F.concat(a, b), ko, zh)


def pairs(entries: DataFrame, without_ko: bool = False) -> DataFrame:
    """Distinct (src, dst, ord): ko, and of confirmed entries alternatives and earlier targets."""
    rows = valid(entries, without_ko)
    nick = entries.where((F.col("kind") == "person-nickname") & given(F.col("zh")) & given(F.col("ko"))).select(F.col("zh").alias("src")).distinct()
    base = rows.where(given(F.col("ko"))).select(F.col("ko").alias("src"), F.col("zh").alias("dst"), "ord")
    sure = rows.where("confirmed")
    alternative = sure.select(F.explode("alternatives").alias("src"), F.col("zh").alias("dst"), "ord", "replace_short").where(
        (F.length("src") >= LEAST_ALTERNATIVE) & (~F.col("dst").contains(F.col("src")) | F.col("replace_short"))
    ).drop("replace_short")
    former = sure.select(F.explode("zh_history").alias("src"), F.col("zh").alias("dst"), "ord").where((F.length("src") >= LEAST_ALTERNATIVE) & (F.col("src") != F.col("dst"))).join(nick, "src", "left_anti")
    return base.unionByName(alternative).unionByName(former).groupBy("src", "dst").agg(F.min("ord").alias("ord"))


def merged_pairs(dedicated: DataFrame, common: DataFrame) -> DataFrame:
    """One target for each source: the common list first, then the earlier entry, then the smaller target."""
    both = pairs(common, True).withColumn("origin", F.lit("common")).unionByName(pairs(dedicated).withColumn("origin", F.lit("dedicated")))
    order = Window.partitionBy("src").orderBy("origin", "ord", "dst")
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("src", "dst", "origin")


def collected(pairs_: DataFrame) -> list[tuple[str, str]]:
    """Pairs on the driver, longest source first, for `one_pass`: a glossary is a list that people keep, and a larger one is refused."""
    size = pairs_.agg(F.coalesce(F.sum(F.length("src") + F.length("dst")), F.lit(0))).first()[0]
    if size > GLOSSARY_CHARS:
        raise ValueError(f"a glossary of {size} characters is more than the {GLOSSARY_CHARS} that go with a task")
    rows = pairs_.orderBy(F.desc(F.length("src")), "src", "dst").collect()
    return [(r["src"], r["dst"]) for r in rows]


def hits(paragraphs: DataFrame, pairs_: DataFrame, key: str) -> DataFrame:
    """Every source found in every row of (key, text), with its occurrences (nested ones too, not overlapping itself).

    The sources, a list that people keep, are one automaton; each text is read once, however many
    sources there are.
    """
    rows = [(r["src"], r["origin"]) for r in pairs_.groupBy("src").agg(F.min("origin").alias("origin")).collect() if r["src"]]
    kind = paragraphs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for k, (src, _) in enumerate(rows):
            automaton.add_word(src, k)
        if rows:
            automaton.make_automaton()
        for batch in batches:
            of, found, counts = [], [], []
            for n, text in enumerate(batch.column(1).to_pylist() if rows else []):
                ends: dict[int, list[int]] = {}
                for end, k in automaton.iter(text or ""):
                    seen = ends.setdefault(k, [0, -1])
                    if end - len(rows[k][0]) >= seen[1]:
                        seen[0], seen[1] = seen[0] + 1, end
                for k, (count, _) in ends.items():
                    of.append(n)
                    found.append(k)
                    counts.append(count)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array([rows[k][0] for k in found], pa.string()), pa.array([rows[k][1] for k in found], pa.string()), pa.array(counts, pa.int64())], [key, "src", "origin", "occurrences"])

    return paragraphs.select(key, "text").mapInArrow(run, f"{key} {kind}, src string, origin string, occurrences long")


def prompt_lines(entries: DataFrame) -> DataFrame:
    note = F.when(given(F.col("note")), F.concat(F.lit("（"), "note", F.lit("）"))).otherwise("")
    return valid(entries).select("ord", F.concat(F.lit("- "), "ko", F.lit(" -> "), "zh", note).alias("line"))
