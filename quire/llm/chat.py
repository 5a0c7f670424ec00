"""Chat formatting by incremental black-box rendering.

A template is any function from turns to text.  The operator renders the prefixes of a
conversation one turn longer each time; where a rendering starts with the one before, the
rest is the new turn's span, and where it does not, the template rewrites history and the
conversation is marked with the first such turn instead of getting spans.  The text inside a
span is found by rendering the same prefix with a one-character probe in place of the last
text, which shows what the template puts before and after it.  The loss mask covers the
texts of assistant turns.

`InstructTemplate` marks user turns as `<s>[INST] ... [/INST]`, assistant turns as
` ... </s>` and any other role as `<s>[ROLE name] ... [/ROLE]`; control strings inside texts
get a backslash before them, and so do backslashes, which `unescape` takes back.

Defined cases: null texts and roles are empty; turns are ordered by turn, then role, then
text (nulls first), so repeated and tied rows keep a fixed order and stay; rows with a null
conv_id form one conversation; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
_PROBES = ("\ue000", "\ue001")


class InstructTemplate:
    """Renders turns, and reads them back from its own output."""

    _control = re.compile(r"\\|<(?=/?s>)|\[(?=/?(?:INST|ROLE)\b)")
    _inner = re.compile(r"\\|\]")
    _marks = re.compile(r"(?P<user><s>\[INST\] )|<s>\[ROLE (?P<role>(?:[^\\\]]|\\.)*)\] | (?=.|$)", re.S)
    _end = {"user": " [/INST]", "assistant": " </s>", "": " [/ROLE]"}

    def __init__(self) -> None:
        # the last rendering and the one before it: a prefix one turn longer is a rendering that is known and a turn
        self._base: tuple[list[Turn], str] = ([], "")
        self._last: tuple[list[Turn], str] = ([], "")

    def __call__(self, turns: list[Turn]) -> str:
        if not turns:
            return ""
        before = turns[:-1]
        if before == self._last[0]:
            self._base = self._last
        elif before != self._base[0]:
            self._base = (before, "".join(map(self._turn, before)))
        self._last = (turns, self._base[1] + self._turn(turns[-1]))
        return self._last[1]

    def _turn(self, turn: Turn) -> str:
        role, text = turn
        text = self.escape(text)
        if role == "user":
            return f"<s>[INST] {text} [/INST]"
        if role == "assistant":
            return f" {text} </s>"
        return f"<s>[ROLE {self._inner.sub(lambda m: chr(92) + m[0], role)}] {text} [/ROLE]"

    def escape(self, text: str) -> str:
        return self._control.sub(lambda m: "\\" + m[0], text)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def read(self, text: str) -> list[Turn]:
        """The turns of a rendering; ValueError where it is none."""
        out, at = [], 0
        while at < len(text):
            mark = self._marks.match(text, at)
            if not mark:
                raise ValueError(f"no turn starts at {at}")
            role = "user" if mark["user"] else self.unescape(mark["role"]) if mark["role"] is not None else "assistant"
            end = self._end.get(role if mark["role"] is None else "", self._end[""])
            stop = mark.end()
            while (stop := text.find(end, stop)) >= 0 and self._escaped(text, stop + 1, mark.end()):
                stop += 1
            if stop < 0:
                raise ValueError(f"the turn at {at} does not end")
            out.append((role, self.unescape(text[mark.end() : stop])))
            at = stop + len(end)
        return out

    @staticmethod
    def _escaped(text: str, at: int, least: int) -> bool:
        """Whether an odd number of backslashes stands before `at`."""
        n = 0
        while at - n > least and text[at - n - 1] == "\\":
            n += 1
        return n % 2 == 1


@dataclass
class Rendered:
    """A formatted conversation: spans of turns and of their texts, and the turn that rewrote history (or -1)."""

    text: str
    turns: list[tuple[int, int]] = field(default_factory=list)
    texts: list[tuple[int, int]] = field(default_factory=list)
    rewritten_at: int = -1


def render_incrementally(template: Callable[[list[Turn]], str], turns: list[Turn]) -> Rendered:
    """Render every prefix of the turns and locate what each one added."""
    before, out = "", Rendered("")
    for k in range(1, len(turns) + 1):
        earlier, role = turns[: k - 1], turns[k - 1][0]
        probes = [template([*earlier, (role, p)]) for p in _PROBES]
        now = template(turns[:k])
        if not all(x.startswith(before) for x in (*probes, now)):
            return Rendered(template(turns), rewritten_at=k - 1)
        # only what comes after the rendering before is looked at, so a turn costs its own length
        tails = [x[len(before) :] for x in probes]
        at = next((i for i, (x, y) in enumerate(zip(*tails, strict=False)) if x != y), None)
        added = now[len(before) :]
        if at is None or not (added.startswith(tails[0][:at]) and added.endswith(tails[0][at + 1 :]) and len(added) >= len(tails[0]) - 1):
            return Rendered(template(turns), rewritten_at=k - 1)
        out.turns.append((len(before), len(now)))
        out.texts.append((len(before) + at, len(now) - (len(tails[0]) - at - 1)))
        before = now
    out.text = before
    return out


def conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation with its ordered turns."""
    turn = F.struct("turn", "role", "text")
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def formatted(rows: DataFrame, template=InstructTemplate) -> DataFrame:
    """conv_id, formatted text, spans of turns and of loss (code points, end excluded), and rewritten_at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = template()
        for batch in batches:
            text, spans, loss, rewritten = [], [], [], []
            for turns in batch.column("turns").to_pylist():
                turns = [(t["role"] or "", t["text"] or "") for t in turns]
                done = render_incrementally(made, turns)
                text.append(done.text)
                spans.append([{"start": a, "end": b} for a, b in done.turns])
                loss.append([{"start": a, "end": b} for (role, _), (a, b) in zip(turns, done.texts, strict=False) if role == "assistant"])
                rewritten.append(done.rewritten_at)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(text, pa.string()), pa.array(spans, kind), pa.array(loss, kind), pa.array(rewritten, pa.int32())], ["conv_id", "formatted", "turn_spans", "loss_spans", "rewritten_at"])

    kind = rows.schema["conv_id"].dataType.simpleString()
    span = "array<struct<start:bigint,end:bigint>>"
    return conversations(rows).mapInArrow(run, f"conv_id {kind}, formatted string, turn_spans {span}, loss_spans {span}, rewritten_at int")


def digests(done: DataFrame, template=InstructTemplate) -> DataFrame:
    """What can be read back from formatted conversations: turns, and the text under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = template()
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
                turns = made.read(text)
                loss = "".join(made.unescape(text[s["start"] : s["end"]]) for s in spans)
                values = (len(turns), hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = done.schema["conv_id"].dataType.simpleString()
    return done.select("conv_id", "formatted", "loss_spans").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op10_chat(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    kinds = dict(rows.dtypes)
    says = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string")
    return digests(formatted(rows.unionByName(own)))
