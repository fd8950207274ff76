"""Chat formatting: a finite-state machine over roles and a declarative template.

Each turn becomes text segments with a loss flag. Control strings inside texts are escaped
so that they cannot be taken for the template's own, and reading the output gives every
text back.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What stands before and after a turn's text, by role; roles without an entry use ``other``.

    ``before`` of other roles names the role, so that it can be read back.
    """

    before: dict = field(default_factory=lambda: {"system": "<<SYS>>", "user": "[INST] ", "assistant": "<s>"})
    after: dict = field(default_factory=lambda: {"system": "<</SYS>>", "user": " [/INST]", "assistant": "</s>"})
    other: tuple = ("<<ROLE>>", "<</ROLE>>", "<</TURN>>")
    trained: tuple = ("assistant",)
    #: state -> role -> next state; a conversation is valid if it ends in ``final``.
    moves: dict = field(default_factory=lambda: {"start": {"system": "opened", "user": "asked"}, "opened": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}})
    final: tuple = ("answered",)

    @property
    def controls(self) -> list[str]:
        """Every control string, longest first."""
        return sorted({x.strip() for x in (*self.before.values(), *self.after.values(), *self.other)}, key=lambda x: (-len(x), x))


TEMPLATE = Template()


class Formatter:
    """Formats and reads turns by a template."""

    def __init__(self, template: Template = TEMPLATE):
        self.t = template
        self.controls = template.controls
        self._escape = re.compile("|".join(re.escape(x) for x in ("\\", *self.controls)))
        self._unescape = re.compile(r"\\(\\|\d+;)")

    def escape(self, text: str) -> str:
        """Backslashes doubled, control string k written as backslash, k, semicolon."""
        return self._escape.sub(lambda m: "\\\\" if m[0] == "\\" else f"\\{self.controls.index(m[0])};", text)

    def unescape(self, text: str) -> str:
        return self._unescape.sub(lambda m: "\\" if m[1] == "\\" else self.controls[int(m[1][:-1])], text)

    def step(self, state: str, role: str) -> str:
        return self.t.moves.get(state, {}).get(role, "invalid")

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, loss flag) pieces of one turn: opening, body, closing."""
        if role in self.t.before:
            opening, closing = self.t.before[role], self.t.after[role]
        else:
            opening, closing = self.t.other[0] + self.escape(role) + self.t.other[1], self.t.other[2]
        return [(opening, False), (self.escape(text), role in self.t.trained), (closing, False)]

    def read(self, formatted: str) -> tuple[str, str, int] | None:
        """Role and text of the turn that a formatted text begins with, and where it ends; none where it has no end yet.

        Texts hold no control strings, so the first closing after the opening is the turn's.
        """
        for role, opening in self.t.before.items():
            if formatted.startswith(opening):
                end = formatted.find(self.t.after[role], len(opening))
                return None if end < 0 else (role, self.unescape(formatted[len(opening) : end]), end + len(self.t.after[role]))
        first, second, last = self.t.other
        if not formatted.startswith(first):
            return None
        middle = formatted.find(second, len(first))
        end = formatted.find(last, middle + len(second)) if middle >= 0 else -1
        return None if end < 0 else (self.unescape(formatted[len(first) : middle]), self.unescape(formatted[middle + len(second) : end]), end + len(last))


SEGMENTS = "conv_id long, turn_no long, part int, text string, loss boolean, valid boolean"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def _format_rows(frames, template: Template):
    f, conv, no, state = Formatter(template), object(), 0, "start"
    for frame in frames:
        out = []
        for c, role, text in zip(frame["conv_id"].tolist(), frame["role"], frame["text"], strict=True):
            c = None if pd.isna(c) else int(c)
            if c != conv:
                conv, no, state = c, 0, "start"
            state, no = f.step(state, role), no + 1
            out += [(c, no, k, piece, loss, state != "invalid") for k, (piece, loss) in enumerate(f.segments(role, text))]
        yield pd.DataFrame(out, columns=["conv_id", "turn_no", "part", "text", "loss", "valid"]).astype({"conv_id": "Int64"})


def format_chats(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Segments (conv_id, turn_no, part, text, loss, valid) of all conversations, in order within each.

    Rows are dealt by conversation, sorted by turn and streamed, so a conversation of any
    length needs the memory of a batch. ``valid`` turns false where the role sequence leaves
    the machine; such turns are formatted all the same. Null texts and roles are empty; rows
    with the same turn follow role and text; null turns come first; rows with a null conv_id
    form one conversation; other columns are ignored; an empty table gives no rows.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInPandas(partial(_format_rows, template=template), SEGMENTS)


def _digest_rows(frames, template: Template):
    f, conv, now, held, masked = Formatter(template), object(), None, "", []

    def ended():
        if held:
            raise ValueError(f"conversation {conv} ends within a turn")
        n, turns, chars, loss, total, state = now
        return (conv, n, turns.hexdigest(), chars, loss.hexdigest(), total, state in f.t.final)

    def frame_of(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[x.split()[0] for x in DIGEST.split(", ")]).astype({"conv_id": "Int64"})

    for frame in frames:
        out = []
        for c, text, loss in zip(frame["conv_id"].tolist(), frame["text"], frame["loss"].tolist(), strict=True):
            c = None if pd.isna(c) else int(c)
            if c != conv:
                if now:
                    out.append(ended())
                conv, now = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, "start"]
            now[4] += len(text)
            if loss:
                masked.append((len(held), len(held) + len(text)))
            held += text
            turn = f.read(held)
            if turn:
                role, plain, end = turn
                now[0] += 1
                now[1].update(f"{role}\n{plain}\n".encode())
                now[5] = f.step(now[5], role)
                for low, high in masked:
                    said = f.unescape(held[low:high])
                    now[2] += len(said)
                    now[3].update(said.encode())
                held, masked = held[end:], []
        yield frame_of(out)
    if now:
        yield frame_of([ended()])


def chat_digests(segments: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """One row per conversation, read back from the formatted text - the segments of ``format_chats`` joined as they
    stream by, a turn at a time - and its loss mask: number of turns, digest of roles and
    unescaped texts, characters and digest of the text under the mask, characters formatted, and
    whether the roles ended in a final state. Text that is no whole number of turns is an error."""
    return segments.select("conv_id", "text", "loss").mapInPandas(partial(_digest_rows, template=template), DIGEST)
