"""Glossaries from replies of a completion service: entries, suggestions for known entries, and nicknames that the text bears out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.replace import GLOSSARY_CHARS
from quire.functions.replies import json_value
from quire.functions.text import quoted, strip
from quire.operators.glossary import LEAST_ALTERNATIVE, clean_alternatives, given, merged_alternatives, valid

# Keys of the replies, and particles that may follow a name.
GROUPS = ("entries", "terms", "people", "persons", "characters", "places", "locations", "organizations", "orgs", "titles")
SOURCES = ("ko", "kr", "korean", "source", "원문", "原文")
TARGETS = ("zh", "cn", "chinese", "target", "中文", "译名")
PARTICLES = "에게 한테 께서 으로 부터 까지 처럼 같이 만큼 마저 조차 이랑 하고 보다 나마 이 가 은 는 을 를 과 와 의 도 만 에 서 로 한 테 께 아 야".split()
#: Characters of a sample that a prompt takes.
SAMPLE_CHARS = 200_000
ENTRY = "ord int, ko string, zh string, kind string, note string, confirmed boolean, alternatives array<string>"
_ENTRY = pa.struct([("ko", pa.string()), ("zh", pa.string()), ("kind", pa.string()), ("note", pa.string()), ("confirmed", pa.bool_()), ("alternatives", pa.list_(pa.string()))])


def _entry(item: object) -> dict | None:
    """An entry of an object with any of the keys, or of a text `source -> target`."""
    plain = {"kind": "term", "note": "", "confirmed": False, "alternatives": []}
    if isinstance(item, str):
        ko, arrow, zh = item.partition("->")
        return plain | {"ko": ko.strip(), "zh": zh.strip()} if arrow else None
    if not isinstance(item, dict):
        return None
    ko, zh = (next((item[k] for k in keys if item.get(k)), None) for keys in (SOURCES, TARGETS))
    if not ko or not zh:
        return None
    others = item.get("alts") or item.get("alternatives") or []
    others = others if isinstance(others, list) else str(others).split(",")
    return {
        "ko": str(ko).strip(), "zh": str(zh).strip(), "kind": str(item.get("kind", "term")).strip() or "term", "note": str(item.get("note", "")).strip(),
        "confirmed": bool(item.get("confirmed", False)), "alternatives": [str(x) for x in others],
    }


def entries_of(value: object) -> list[dict]:
    """Entries of a JSON value: a list, an object of groups, or a plain object of source and target."""
    if isinstance(value, list):
        items = value
    elif isinstance(value, dict):
        groups = [value[g] for g in GROUPS if isinstance(value.get(g), (list, dict))]
        items = [x for g in groups for x in (g if isinstance(g, list) else [g])]
        if not items:
            items = [{"ko": k, "zh": str(v)} for k, v in value.items() if isinstance(v, (str, int, float))]
            return [{"ko": x["ko"].strip(), "zh": x["zh"].strip(), "kind": "term", "note": "", "confirmed": False, "alternatives": []} for x in items]
    else:
        items = []
    return [e for e in map(_entry, items) if e]


def parsed(replies: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """(key, ord, ko, zh, kind, note, confirmed, alternatives) of replies (key, reply), the first `limit` of each; replies without JSON give one row with a problem.

    The extra column `problem` has the start of such a reply and is null elsewhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, problems = [], []
            for reply in batch.column(1).to_pylist():
                try:
                    found.append(entries_of(json_value(reply))[:limit])
                    problems.append(None)
                except ValueError:
                    found.append([])
                    problems.append((reply or "")[:300])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(_ENTRY)), pa.array(problems, pa.string())], [key, "entries", "problem"])

    kind = replies.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, entries array<struct<ko:string,zh:string,kind:string,note:string,confirmed:boolean,alternatives:array<string>>>, problem string"
    rows = replies.select(key, "reply").mapInArrow(run, schema)
    each = rows.select(key, "problem", F.posexplode_outer("entries").alias("ord", "e")).where("e IS NOT NULL OR problem IS NOT NULL")
    return each.select(key, "ord", "e.ko", "e.zh", "e.kind", "e.note", "e.confirmed", clean_alternatives(F.col("e.alternatives"), F.col("e.ko"), F.col("e.zh")).alias("alternatives"), "problem")


def prompt_text(entries: DataFrame) -> DataFrame:
    """One row (text): all valid entries for a prompt, a line each, or a mark for none; a glossary is a list that people keep."""
    note = F.when(given(F.col("note")), F.concat(F.lit("（"), "note", F.lit("）"))).otherwise("")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat(F.lit("- "), "ko", F.lit(" -> "), "zh", note).alias("line")))), lambda x: x["line"])
    return valid(entries).agg(F.when(F.count("*") > 0, F.array_join(lines, "\n")).otherwise("（无）").alias("text"))


def extract_prompt(samples: DataFrame, key: str, limit: int, instruction: str, known: DataFrame | None = None) -> DataFrame:
    """(key, prompt) of samples (key, text): names to extract, with the entries known already; samples without text are left out."""
    text = F.substring(strip(F.col("text")), 1, SAMPLE_CHARS)
    head = F.lit(f"{instruction}\nList the proper names of the text below, {limit} at the most, frequent and important ones first.\n\n")
    rows = samples.where(strip(F.coalesce("text", F.lit(""))) != "")
    if known is None:
        return rows.select(key, F.concat(head, text).alias("prompt"))
    mark = F.when(F.col("confirmed"), " (confirmed)").otherwise(" (open)")
    line = F.concat(F.lit("- "), "ko", F.lit(" -> "), "zh", F.lit(" ["), "kind", F.lit("]"), mark)
    lines = valid(known).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n").alias("_known"))
    said = F.when(F.col("_known") == "", "none").otherwise(F.col("_known"))
    return rows.crossJoin(F.broadcast(lines)).select(key, F.concat(F.lit("Known entries, not to be listed again:\n"), said, F.lit("\n\n"), head, text).alias("prompt"))  # one row


def enriched(entries: DataFrame, suggested: DataFrame) -> DataFrame:
    """Entries with the alternatives of suggestions of the same ko added, and a note where they had none; `changed_alternatives`, `changed_note` tell which."""
    own = suggested.where(given(F.col("ko"))).withColumn("_alts", F.col("alternatives"))
    by_ko = own.groupBy("ko").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col("_alts").alias("a")))), lambda x: x["a"])).alias("_alts"),
        F.get(F.transform(F.array_sort(F.collect_list(F.when(given(F.col("note")), F.struct("ord", "note")))), lambda x: x["note"]), F.lit(0)).alias("_note"),
    )
    # of entries with one ko the last takes the suggestion
    last = Window.partitionBy("ko").orderBy(F.desc("ord"))
    both = entries.withColumn("_n", F.row_number().over(last)).join(by_ko, "ko", "left").withColumn("_on", (F.col("_n") == 1) & given(F.col("ko")))
    merged = merged_alternatives(F.col("alternatives"), F.coalesce("_alts", F.array().cast("array<string>")), F.col("ko"), F.col("zh"))
    more = F.col("_on") & (F.coalesce(F.size("_alts"), F.lit(0)) > 0) & (merged != F.col("alternatives"))
    noted = F.col("_on") & ~given(F.col("note")) & given(F.col("_note"))
    rest = [c for c in entries.columns if c not in ("alternatives", "note")]
    return both.select(*rest, F.when(more, merged).otherwise(F.col("alternatives")).alias("alternatives"), F.when(noted, F.col("_note")).otherwise(F.col("note")).alias("note"), F.coalesce(more, F.lit(False)).alias("changed_alternatives"), F.coalesce(noted, F.lit(False)).alias("changed_note"))


def enrich_prompt(entries: DataFrame, instruction: str) -> DataFrame:
    """One row (prompt): all valid entries with what is known of them, for suggestions; none for an empty glossary."""
    line = F.concat(F.lit("- ko="), "ko", F.lit(" | zh="), "zh", F.lit(" | kind="), "kind", F.lit(" | note="), F.coalesce("note", F.lit("")), F.lit(" | alts="), F.array_join("alternatives", ","))
    return _listed(valid(entries), line, instruction)


def nickname_prompt(entries: DataFrame, instruction: str) -> DataFrame:
    """One row (prompt): the persons of a glossary, for their short names; none without persons."""
    line = F.concat(F.lit("- ko="), "ko", F.lit(" | zh="), "zh", F.lit(" | note="), F.coalesce("note", F.lit("")))
    return _listed(valid(entries).where("kind = 'person'"), line, instruction)


def _listed(entries: DataFrame, line: Column, instruction: str) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"])
    head = F.lit(f"{instruction}\nAnswer with one JSON object; the ko of every entry must be as given.\n\n")
    return entries.agg(F.count("*").alias("n"), F.array_join(lines, "\n").alias("l")).where("n > 0").select(F.concat(head, "l").alias("prompt"))


def improved(entries: DataFrame, texts: DataFrame, ask, nick: str = "Which short names do these persons have?", alts: str = "Which other spellings do these entries have?") -> DataFrame:
    """Entries with new nicknames that the texts bear out, and then suggestions for all, the new ones too.

    `ask` takes a row (prompt) and gives a row (reply); a glossary without persons skips the first step.
    """
    from quire.operators.glossary import appended

    names = nickname_prompt(entries, nick)
    if not names.isEmpty():
        found = nickname_entries(nicknames(entries, said_nicknames(ask(names)), texts))
        entries = appended(entries, found.select(*entries.columns))
    reply = ask(enrich_prompt(entries, alts))
    return enriched(entries, parsed(reply.select(F.lit(0).alias("k"), "reply"), "k").where("problem IS NULL").drop("k", "problem"))


def without_name(text: Column, name: Column) -> Column:
    """A text without a full name and the particle that may follow it."""
    pattern = F.concat(F.lit("\\Q"), F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(f"\\E(?:{'|'.join(quoted(p) for p in PARTICLES)})?"))
    return F.regexp_replace(text, pattern, F.lit(""))


def said_outside(names: DataFrame, texts: DataFrame) -> DataFrame:
    """The distinct (person, ko) of `names` for which some row of texts (text) holds ko, and still does without the person's full name and the particle that may follow it.

    One automaton finds full and short names in one reading of a text; a full name is taken out
    only in a text that holds both.  The names come from replies: their size is checked.
    """
    size = names.agg(F.coalesce(F.sum(F.length("person") + F.length("ko")), F.lit(0))).first()[0]
    if size > GLOSSARY_CHARS:
        raise ValueError(f"names of {size} characters are more than the {GLOSSARY_CHARS} that go with a task")
    persons: dict[str, list[str]] = {}
    for r in names.select("person", "ko").distinct().collect():
        persons.setdefault(r["ko"], []).append(r["person"])
    particle = f"(?:{'|'.join(map(re.escape, PARTICLES))})?"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for name in {*persons, *(p for listed in persons.values() for p in listed)} - {""}:
            automaton.add_word(name, name)
        if len(automaton):
            automaton.make_automaton()
        seen: set[tuple[str, str]] = set()
        for batch in batches:
            new = []
            for text in batch.column(0).to_pylist() if len(automaton) else []:
                held = {name for _, name in automaton.iter(text or "")}
                for ko in held & persons.keys():
                    for person in persons[ko]:
                        if (person, ko) not in seen and (person not in held or ko in re.sub(re.escape(person) + particle, "", text)):
                            seen.add((person, ko))
                            new.append((person, ko))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in new], pa.string()) for i in (0, 1)], ["person", "ko"])

    return texts.select("text").mapInArrow(run, "person string, ko string").distinct()


def nicknames(entries: DataFrame, said: DataFrame, texts: DataFrame) -> DataFrame:
    """Verdicts (ord, person, ko, zh, verdict) on nicknames (ord, person, ko, zh) of persons: added, skipped or not_found.

    A nickname is added if it is new, long enough, unlike the person's own name, and occurs in a
    row of texts (text) outside the full name.  Of equal new ones the first that is found counts.
    The text is scanned once, in parallel, for all nicknames: they come from a reply, a short list.
    """
    persons = valid(entries).where("kind = 'person'").groupBy("ko").agg(F.max_by("zh", "ord").alias("person_zh")).withColumnRenamed("ko", "person")
    rows = said.select("ord", strip("person").alias("person"), strip(F.coalesce("ko", F.lit(""))).alias("ko"), strip(F.coalesce("zh", F.lit(""))).alias("zh")).join(F.broadcast(persons), "person")
    known = entries.select("ko").distinct().withColumn("_known", F.lit(True))
    rows = rows.join(known, "ko", "left")
    bad = (F.col("ko") == "") | (F.col("zh") == "") | (F.length("ko") < LEAST_ALTERNATIVE) | (F.col("ko") == F.col("person")) | (F.col("zh") == F.col("person_zh")) | F.col("_known").isNotNull()
    open_ = rows.where(~F.coalesce(bad, F.lit(False))).select("person", "ko").distinct()
    hit = said_outside(open_, texts).withColumn("_hit", F.lit(True))
    judged = rows.join(hit, ["person", "ko"], "left").withColumn("_bad", F.coalesce(bad, F.lit(False)))
    found = ~F.col("_bad") & F.col("_hit").isNotNull()
    first = F.min(F.when(found, F.col("ord"))).over(Window.partitionBy("ko"))
    verdict = F.when(F.col("_bad"), "skipped").when(first < F.col("ord"), "skipped").when(found, "added").otherwise("not_found")
    return judged.withColumn("_first", first).select("ord", "person", "person_zh", "ko", "zh", verdict.alias("verdict"))


def nickname_entries(judged: DataFrame) -> DataFrame:
    """Entries of the nicknames that were added, in the order of the reply."""
    rows = judged.where("verdict = 'added'")
    return rows.select(
        "ord", "ko", "zh", F.lit("person-nickname").alias("kind"), F.concat("person_zh", F.lit("的昵称")).alias("note"), F.lit(False).alias("confirmed"),
        F.array().cast("array<string>").alias("alternatives"), F.lit(False).alias("replace_short"), F.array().cast("array<string>").alias("zh_history"),
    )


def said_nicknames(replies: DataFrame) -> DataFrame:
    """(ord, person, ko, zh) of replies (reply): {"entries": [{"ko": person, "nicknames": [{"ko", "zh"}]}]}, or the list alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for reply in batch.column(0).to_pylist():
                value = json_value(reply)
                listed = value.get("entries") if isinstance(value, dict) else value
                if not isinstance(listed, list):
                    raise ValueError("the reply has no list of entries")
                for item in listed:
                    names = (item.get("nicknames") or []) if isinstance(item, dict) else []
                    for nick in names if isinstance(names, list) else []:
                        pair = nick if isinstance(nick, dict) else {}
                        rows.append({"ord": len(rows), "person": str(item.get("ko", "")), "ko": str(pair.get("ko", "")), "zh": str(pair.get("zh", ""))})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("ord", pa.int32()), ("person", pa.string()), ("ko", pa.string()), ("zh", pa.string())]))

    return replies.select("reply").mapInArrow(run, "ord int, person string, ko string, zh string")
