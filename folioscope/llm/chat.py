"""Chat turns formatted by a declarative template, with loss flags per segment.

A template names, for each role, the marks around its text and whether the text
is learned; its order is a finite-state machine over roles. Marks inside texts are
escaped, so what was formatted can be read back exactly. Conversations are sorted
by Spark and stream through one at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START = ""


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """``turns`` by role; a role not named is written inside ``role_marks`` before
    its text and ends with ``other_end``. ``order`` has the roles that may follow
    each role (START before the first), ``last`` those that may end."""

    turns: dict[str, Turn]
    order: dict[str, tuple[str, ...]]
    last: tuple[str, ...]
    role_marks: tuple[str, str] = ("[ROLE]", "[/ROLE]")
    other_end: str = "[END]"
    escape: str = "\\"
    marks: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        marks = {m for t in self.turns.values() for m in (t.before, t.after)} | {*self.role_marks, self.other_end}
        object.__setattr__(self, "marks", tuple(sorted(marks, key=lambda m: (-len(m), m))))
        for m in marks:
            if len(m) < 2 or self.escape in m:
                raise ValueError(f"a mark needs two characters and no escape: {m!r}")
            for n in marks:
                if m != n and m in n or any(m.endswith(n[:k]) for k in range(1, len(n)) if (m, k) != (n, len(n))):
                    raise ValueError(f"the marks {m!r} and {n!r} overlap")

    @cached_property
    def _plain(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, (self.escape, *self.marks))))

    @cached_property
    def _escaped(self) -> re.Pattern:
        inside = (m[0] + self.escape + m[1:] for m in self.marks)
        return re.compile("|".join(map(re.escape, (self.escape * 2, *inside))))

    @cached_property
    def _mark(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, self.marks)))

    def hide(self, text: str) -> str:
        return self._plain.sub(lambda m: self.escape * 2 if m[0] == self.escape else m[0][0] + self.escape + m[0][1:], text)

    def show(self, text: str) -> str:
        return self._escaped.sub(lambda m: self.escape if m[0] == self.escape * 2 else m[0][0] + m[0][2:], text)

    def write(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, bool]], str | None]:
        """The text, its segments ``(start, end, loss)`` in characters, and the
        first fault of the order of turns."""
        parts, segments, at, state, problem = [], [], 0, START, None
        for k, (role, text) in enumerate(turns):
            if problem is None and role not in self.order.get(state, ()):
                problem = f"turn {k}: {role or 'no role'} after {state or 'the start'}"
            state = role
            turn = self.turns.get(role)
            before = turn.before if turn else f"{self.role_marks[0]}{self.hide(role)}{self.role_marks[1]}"
            for part, loss in ((before, False), (self.hide(text), bool(turn and turn.loss)), (turn.after if turn else self.other_end, False)):
                if part:
                    parts.append(part)
                    segments.append((at, at + len(part), loss))
                    at += len(part)
        if problem is None and state not in self.last:
            problem = f"ends after {state or 'the start'}"
        return "".join(parts), segments, problem

    def read(self, text: str) -> list[tuple[str, str]]:
        """The turns that ``write`` was given."""
        by_mark = {t.before: role for role, t in self.turns.items()}
        turns, at = [], 0
        while at < len(text):
            mark = self._mark.match(text, at)[0]
            at += len(mark)
            if mark == self.role_marks[0]:
                end = self._mark.search(text, at)
                role, at = self.show(text[at : end.start()]), end.end()
            else:
                role = by_mark[mark]
            end = self._mark.search(text, at)
            turns.append((role, self.show(text[at : end.start()])))
            at = end.end()
        return turns


INSTRUCT = Template(
    turns={"system": Turn("<<SYS>>", "[/SYS]"), "user": Turn("[INST]", "[/INST]"), "assistant": Turn("[OUT]", "</s>", True)},
    order={START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    last=("assistant",),
)

SCHEMA = "conv_id bigint, formatted string, segments array<struct<start:bigint,stop:bigint,loss:boolean>>, problem string"


def format_chats(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """``conv_id, formatted, segments, problem`` per conversation of ``conv_id,
    turn, role, text``.

    Every conversation is formatted; ``problem`` tells where one breaks the order
    (null if nowhere). Turns go by ``turn`` (nulls first), ties by role and text,
    and repeated rows stay. Null roles and texts are empty; rows without conv_id
    are one conversation. Other columns are ignored. A conversation is one value
    and is all a task holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple[str, str]] = []
        now: list = []
        done: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids, texts, segments, problems = zip(*done)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("loss", pa.bool_())]))
            cut = [[{"start": a, "stop": b, "loss": x} for a, b, x in s] for s in segments]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(cut, kind), pa.array(problems, pa.string())],
                ["conv_id", "formatted", "segments", "problem"],
            )

        for b in batches:
            for conv, role, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                if now and now[0] != conv:
                    done.append((now[0], *template.write(own)))
                    size += len(done[-1][1])
                    own = []
                    if size > 1 << 20:
                        yield flush()
                        done, size = [], 0
                now = [conv]
                own.append((role, text))
        if now:
            done.append((now[0], *template.write(own)))
            yield flush()

    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, SCHEMA)


def read_back(formatted: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Counts and digests of what the formatted text and its loss flags say:
    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, segments in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                turns = template.read(text)
                whole, learned, chars = hashlib.sha256(), hashlib.sha256(), 0
                for role, said in turns:
                    whole.update(f"{role}\n{said}\n".encode())
                for s in segments:
                    if s["loss"]:
                        said = template.show(text[s["start"] : s["stop"]])
                        learned.update(said.encode())
                        chars += len(said)
                rows.append((len(turns), whole.hexdigest(), chars, learned.hexdigest(), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *columns], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            )

    return formatted.select("conv_id", "formatted", "segments").mapInArrow(
        run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )
