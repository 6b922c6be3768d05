"""Chat formatting with a grammar round trip.

    conversation := turn*
    turn         := "### " role ": " text "</turn>\\n"

A backslash makes the next character an ordinary one. A turn is first rendered as it is; the parser reads it back, and
where the turn it recovers differs from the source, the text is escaped and rendered again until it is identical. The
parser knows nothing of the level of escaping: it always takes a backslash off.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .durable import narrow

HEAD, AFTER_ROLE, END = "### ", ": ", "</turn>\n"
LOSS_ROLE = "assistant"

# from the least change to the most: nothing; control strings and backslashes; every character of the grammar
_LEVELS = (None, re.compile(r"\\|###|</turn>|: "), re.compile(r"[\\#<:]"))
_PLAIN_TO_END = re.compile(r"[^\\<]*")
_PLAIN_TO_ROLE = re.compile(r"[^\\:]*")


def escape(text: str, level: int) -> str:
    return text if _LEVELS[level] is None else _LEVELS[level].sub(lambda m: "\\" + m[0], text)


def _until(stream: str, at: int, stop: str, plain: re.Pattern) -> tuple[str, int]:
    """Characters up to an unescaped ``stop``, without their escapes, and the place after it."""
    out = []
    while True:
        run = plain.match(stream, at)
        out.append(run[0])
        at = run.end()
        if at >= len(stream):
            raise ValueError("the turn does not end")
        if stream[at] == "\\":
            out.append(stream[at + 1 : at + 2])
            at += 2
        elif stream.startswith(stop, at):
            return "".join(out), at + len(stop)
        else:
            out.append(stream[at])
            at += 1


def parse(stream: str):
    """The turns (role, text) of a rendered stream; the only reading that the grammar allows."""
    at = 0
    while at < len(stream):
        if not stream.startswith(HEAD, at):
            raise ValueError(f"no turn begins at {at}")
        role, at = _until(stream, at + len(HEAD), AFTER_ROLE, _PLAIN_TO_ROLE)
        text, at = _until(stream, at, END, _PLAIN_TO_END)
        yield role, text


def render(role: str, text: str) -> tuple[str, int]:
    """A turn that reads back as (role, text), and the level of escaping that it needed.

    Text that holds a control string is escaped even where the parser would get by without.
    """
    conflict = any(mark in part for mark in ("###", "</turn>") for part in (role, text))
    for level in range(int(conflict), len(_LEVELS)):
        made = HEAD + escape(role, level) + AFTER_ROLE + escape(text, level) + END
        try:
            if list(parse(made)) == [(role, text)]:
                return made, level
        except ValueError:
            pass
    raise ValueError("no level of escaping gives the turn back")


def _render_rows(source):
    for batch in source:
        made = [render(r or "", t or "") for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("turn"), pa.array([m for m, _ in made], pa.string()), pa.array([k for _, k in made], pa.int32())],
            names=["conv", "turn", "formatted", "escape_level"],
        )


def format_turns(rows: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """One row per turn: conv, turn, formatted (its stretch of the conversation's output) and escape_level.

    Concatenated in order of turn these are the formatted conversation. Defined results: NULL role or text counts as
    empty; an empty table gives no rows; other columns are ignored; very long texts are one string each.
    """
    own = narrow(rows, conv=conv_column, turn=turn_column, role=role_column, text=text_column)
    kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    return own.mapInArrow(_render_rows, f"conv {kinds['conv']}, turn {kinds['turn']}, formatted string, escape_level int")


class _Digest:
    """What is read back of one conversation, turn by turn: memory does not grow with its length."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, formatted: str) -> None:
        self.chars += len(formatted)
        for role, text in parse(formatted):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if role == LOSS_ROLE:
                self.loss_chars += len(text)
                self.loss.update(text.encode("utf-8", "surrogatepass"))


_READ = (("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()))


def _read_back(key_type):
    def emit(done):
        values = [[k for k, _ in done], [d.n for _, d in done], [d.turns.hexdigest() for _, d in done], [d.loss_chars for _, d in done],
                  [d.loss.hexdigest() for _, d in done], [d.chars for _, d in done]]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, [key_type, *(t for _, t in _READ)])], names=["conv", *(n for n, _ in _READ)])

    def run(source):
        current, digest, done = None, None, []
        for batch in source:
            for conv, formatted in zip(batch.column("conv").to_pylist(), batch.column("formatted").to_pylist()):
                if digest is None or conv != current:
                    if digest is not None:
                        done.append((current, digest))
                    current, digest = conv, _Digest()
                    if len(done) >= 4096:
                        yield emit(done)
                        done = []
                digest.add(formatted)
        if digest is not None:
            yield emit([*done, (current, digest)])

    return run


def read_conversations(turns: DataFrame) -> DataFrame:
    """Parse what ``format_turns`` gives: one row per conversation with digests of its turns and of its loss text.

    A task streams through its sorted turns and holds one running digest, so a conversation of any length takes
    constant memory; SHA-256 over a whole conversation is sequential by definition. Turns with equal numbers go by
    their formatted text; NULL turns come first; rows with NULL conversation form one conversation.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    ordered = turns.repartition("conv").sortWithinPartitions("conv", "turn", "formatted")
    kind = turns.schema["conv"].dataType
    return ordered.select("conv", "formatted").mapInArrow(
        _read_back(to_arrow_type(kind)), f"conv {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
