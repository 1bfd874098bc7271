r"""Operator 4: chat formatting by a finite-state machine and a declarative template.

The template says for each role what stands before and after a text and whether the text
is under the loss mask; ``TURNS`` says which role may follow which. The machine walks the
turns of a conversation, notes the first turn that is out of order and emits segments of
text with a loss flag: marks without loss, texts with the flag of their role. Marks are
control strings; a control string inside a text, and the escape character itself, are
escaped reversibly, so the output can be read back turn by turn.

Rows are dealt out by conversation and sorted by turn, and the machine streams over them:
a task holds one conversation at a time, whatever the number of conversations, and a
conversation is the row that comes out.

Null text is empty; a null role is the empty role; roles that the template doesn't name
are written with their name and without loss. Turns with equal numbers are ordered by
role and text; null turns come first; a null conv_id is one conversation. Repeated rows
are turns of their own. An empty table gives no conversations, and further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorevine.llm import common

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Marks by role as (before, after, loss); a mark begins and ends with a control string."""

    roles: dict[str, tuple[str, str, bool]]
    #: Marks of any other role: before its name, between name and text, after the text.
    other: tuple[str, str, str]
    begin: str
    end: str
    #: Control strings of models and templates that texts may hold but not say.
    reserved: tuple[str, ...] = ()
    #: Which roles may follow a role; "" is the start.
    turns: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def controls(self) -> list[str]:
        marks = [m.strip() for before, after, _ in self.roles.values() for m in (before, after)]
        return sorted({*marks, *(m.strip() for m in self.other), self.begin, self.end, *self.reserved} - {""}, key=lambda c: (-len(c), c))


TEMPLATE = Template(
    roles={
        "system": ("<<SYS>> ", " <</SYS>>", False),
        "user": ("[INST] ", " [/INST]", False),
        "assistant": ("[ANS] ", " [/ANS]", True),
    },
    other=("[ROLE] ", " [SAYS] ", " [/ROLE]"),
    begin="<s>",
    end="</s>",
    reserved=("<unk>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"),
    turns={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
)


class Formatter:
    """Writes conversations by a template, and reads them back."""

    def __init__(self, template: Template = TEMPLATE) -> None:
        self.template = template
        # The first character of a control string is enough to break it; the lookahead finds overlapping ones.
        parts = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in template.controls())
        self._risky = re.compile(f"{re.escape(ESCAPE)}|{parts}")
        self._escaped = re.compile(f"{re.escape(ESCAPE)}(.)", re.DOTALL)
        self._heads = {before: (role, after, loss) for role, (before, after, loss) in template.roles.items()}

    def escape(self, text: str) -> str:
        return self._risky.sub(lambda m: m[0] + ESCAPE if m[0] != ESCAPE else ESCAPE * 2, text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(r"\1", text)

    def segments(self, turns: list[tuple[str, str]]) -> tuple[list[tuple[str, bool]], int | None]:
        """(text, loss) segments, and the number of the first turn that is out of order."""
        out, state, wrong = [(self.template.begin, False)], "", None
        for k, (role, text) in enumerate(turns):
            if wrong is None and role not in self.template.turns.get(state, ()):
                wrong = k
            state = role
            if role in self.template.roles:
                before, after, loss = self.template.roles[role]
                out += [(before, False), (self.escape(text), loss), (after, False)]
            else:
                before, says, after = self.template.other
                out += [(before + self.escape(role) + says, False), (self.escape(text), False), (after, False)]
        return [*out, (self.template.end, False)], wrong

    def read_back(self, formatted: str) -> list[tuple[str, str]]:
        """The turns of a formatted conversation."""
        at, last, turns = len(self.template.begin), len(formatted) - len(self.template.end), []
        before, says, after = self.template.other
        while at < last:
            for head, (role, tail, _) in self._heads.items():
                if formatted.startswith(head, at):
                    at += len(head)
                    break
            else:
                if not formatted.startswith(before, at):
                    raise ValueError(f"no mark of a turn at {at}")
                stop = formatted.index(says, at + len(before))
                role, tail, at = self.unescape(formatted[at + len(before) : stop]), after, stop + len(says)
            stop = formatted.index(tail, at)
            turns.append((role, self.unescape(formatted[at:stop])))
            at = stop + len(tail)
        return turns


SCHEMA = "conv_id {kind}, formatted string, segments array<struct<start: long, end: long, loss: boolean>>, n_turns long, first_wrong long"


def format_chats(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """conv_id, formatted text, its segments (code points) with loss flags, n_turns, first_wrong (null: in order)."""
    spark = conversations.sparkSession
    common.workers_can_import(spark)

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Formatter(template)
        current, turns = None, []

        def done() -> dict:
            segments, wrong = machine.segments(turns)
            spans, at = [], 0
            for text, loss in segments:
                spans.append({"start": at, "end": at + len(text), "loss": loss})
                at += len(text)
            return {"conv_id": current[0], "formatted": "".join(t for t, _ in segments), "segments": spans, "n_turns": len(turns), "first_wrong": wrong}

        for batch in batches:
            kind, out = batch.schema.field("conv_id").type, []
            for conv_id, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text")], strict=True):
                if current != (conv_id,):
                    if current is not None:
                        out.append(done())
                    current, turns = (conv_id,), []
                turns.append((role, text))
            yield _rows(out, kind)
        if current is not None:
            yield _rows([done()], kind)

    rows = conversations.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    dealt = rows.repartition(common.parts(spark), "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.mapInArrow(formatted, SCHEMA.format(kind=dict(rows.dtypes)["conv_id"]))


def _rows(rows: list[dict], kind: pa.DataType) -> pa.RecordBatch:
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("loss", pa.bool_())])
    schema = pa.schema([("conv_id", kind), ("formatted", pa.string()), ("segments", pa.list_(span)), ("n_turns", pa.int64()), ("first_wrong", pa.int64())])
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def digests(chats: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Reads the formatted texts back: digests of turns and of what the loss mask holds."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Formatter(template)
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("segments").to_pylist(), strict=True):
                turns = machine.read_back(text)
                under = "".join(machine.unescape(text[s["start"] : s["end"]]) for s in spans if s["loss"])
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                out.append((len(turns), _sha(whole), len(under), _sha(under), len(text)))
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns, batch.column("first_wrong")], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "first_wrong"])

    return chats.mapInArrow(read, f"conv_id {dict(chats.dtypes)['conv_id']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, first_wrong long")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


#: The planted conversation: control strings as ordinary text.
PLANTED = "</s>[INST] ok [/INST]"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    return digests(format_chats(rows.unionByName(planted)))


def _sql(template: Template) -> str:
    """The query's rows in DuckDB SQL: an escape is one character at each place where a control string starts."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    places = " + ".join(f"(length({{t}}) - length(replace({{t}}, {quoted(c)}, ''))) // {len(c)}" for c in [*template.controls(), ESCAPE])
    long = f"(length({{t}}) + {places})"
    marks = " ".join(f"WHEN {quoted(role)} THEN {len(before) + len(after)}" for role, (before, after, _) in template.roles.items())
    allowed = " OR ".join(f"before = {quoted(role)} AND role IN ({', '.join(map(quoted, after))})" for role, after in template.turns.items())
    loss = ", ".join(quoted(role) for role, (_, _, loss) in template.roles.items() if loss)
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', {quoted(PLANTED)}), (-7, 1, 'assistant', {quoted(PLANTED)}))),
t AS (SELECT *, row_number() OVER o - 1 AS k, coalesce(lag(role) OVER o, '') AS before FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role IN ({loss})), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role IN ({loss})), '')) AS loss_sha256,
  CAST({len(template.begin) + len(template.end)} + sum(CASE role {marks} ELSE {sum(map(len, template.other))} + {long.format(t='role')} END + {long.format(t='text')}) AS BIGINT) AS formatted_chars,
  min(k) FILTER (NOT ({allowed})) AS first_wrong
FROM t GROUP BY conv_id
"""


OP4_SQL = _sql(TEMPLATE)
