"""Conversation structure repair: the cheapest edits that make roles alternate, by whole numbers alone.

Rows of a conversation are kept, given another role or deleted, and empty turns are inserted, until the role
initials read ``(s?(ua)+)?``. The edits are paths of a graph whose nodes are (rows read, state of that
pattern). A path's weight is one whole number: its high digits are the cost, its low digits - of fixed
width, one for each letter of the audit from the highest down - the letters in their ASCII order, with zeros
behind the last one. The least number is thus the least cost and, of that, the least audit; nothing else decides.

Letters on which the paths of all states agree are settled and leave the numbers, which so stay short in
conversations that alternate somewhere. Each path carries the digest of what it says, so no texts are held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of an audit in their ASCII order (a letter's digit is its place, from 1), the bits of a digit, and costs.
LETTERS, BITS = "DIKR", 3
DELETE, RENAME, INSERT, TRUNCATED = 2, 1, 5, 5
#: Digits of a number at first, and rows after which settled letters are looked for.
WIDTH, EVERY = 96, 32
# States of the pattern: nothing yet, after s, after u, after a.
NONE, S, U, A = range(4)
#: Where a role's initial leads from each state; none where it may not stand.
NAMES = {U: "user", A: "assistant"}
MOVES = {"s": {NONE: S}, "u": {NONE: U, S: U, A: U}, "a": {U: A}}


class Said:
    """Digest of the repaired ``role:text`` lines along one path."""

    def __init__(self, digest=None):
        self.digest = digest

    def and_(self, role: str, text: str) -> Said:
        out = self.digest.copy() if self.digest else hashlib.sha256()
        out.update(f"{chr(10) if self.digest else ''}{role}:{text}".encode())
        return Said(out)

    def hex(self) -> str:
        return (self.digest or hashlib.sha256()).hexdigest()


class Paths:
    """The least weight of each state after the rows read so far - as the letters after the settled ones - and what its path says."""

    def __init__(self, width: int = WIDTH):
        self.width = width
        self.best: dict[int, int] = {NONE: 0}
        self.said: dict[int, Said] = {NONE: Said()}
        self._insert()

    def _edge(self, weight: int, cost: int, letter: str) -> int:
        """The weight with one more letter. The lowest digit that is not zero is the last letter's."""
        return weight + (cost << BITS * self.width) + (LETTERS.index(letter) + 1 << BITS * (self._free(weight) - 1))

    def _digits(self, weight: int) -> int:
        return weight & ((1 << BITS * self.width) - 1)

    def _free(self, weight: int) -> int:
        """Digits behind the last letter's."""
        digits = self._digits(weight)
        return ((digits & -digits).bit_length() - 1) // BITS if digits else self.width

    def _insert(self) -> None:
        """Inserted turns: u from any state, a after u; more than two in a row would come back to a state."""
        had = self.best.get(A)
        for state, to in ((NONE, U), (S, U), (U, A), (A, U)):
            weight = had if state == A else self.best.get(state)
            if weight is not None and ((w := self._edge(weight, INSERT, "I")) < self.best.get(to, w + 1)):
                self.best[to], self.said[to] = w, self.said[state].and_(NAMES[to], "")

    def read(self, role: str, text: str, deleted: bool, truncated: bool) -> None:
        """One more row: its role and text, whether it has to go, whether leaving it costs extra."""
        self._room()
        extra, after = TRUNCATED if truncated else 0, {}
        for state, weight in self.best.items():
            edges = [(self._edge(weight, DELETE, "D"), state, None)]
            if not deleted:
                if state in MOVES.get(role[:1], {}):
                    edges.append((self._edge(weight, extra, "K"), MOVES[role[:1]][state], role))
                edges += [(self._edge(weight, RENAME + extra, "R"), MOVES[r][state], NAMES[MOVES[r][state]]) for r in "ua" if state in MOVES[r]]
            for w, to, name in edges:
                if to not in after or w < after[to][0]:
                    after[to] = (w, state, name)
        self.best = {to: w for to, (w, _, _) in after.items()}
        self.said = {to: self.said[state] if name is None else self.said[state].and_(name, text) for to, (_, state, name) in after.items()}
        self._insert()
        self._prune()

    def _prune(self) -> None:
        """Leaves out states from which every end costs more than from another: from a, whatever follows an unused s or
        nothing can follow at no more than one deletion's cost, and u and a are one insertion apart."""
        cost = {s: w >> BITS * self.width for s, w in self.best.items()}
        least = min(cost.get(A, 1 << 62), cost.get(U, 1 << 62) + INSERT)
        for state, slack in ((NONE, DELETE), (S, 0)):
            if cost.get(state, 0) > least + slack:
                del self.best[state], self.said[state]

    def _room(self) -> None:
        """Widens the numbers where the longest audit leaves no room for a row and two inserted turns."""
        if min(map(self._free, self.best.values())) < 4:
            more = self.width
            self.best = {s: (w >> BITS * self.width << BITS * (self.width + more)) | (self._digits(w) << BITS * more) for s, w in self.best.items()}
            self.width += more

    def letters(self, weight: int) -> str:
        """The audit in a weight: its digits to base 8."""
        return f"{self._digits(weight):0{self.width}o}".rstrip("0").translate({ord("1") + k: x for k, x in enumerate(LETTERS)})

    def settle(self) -> str:
        """Letters that all paths begin with; they leave the numbers."""
        one, *others = self.best.values()
        differ = max((self._digits(one ^ w).bit_length() for w in others), default=0)
        n = min(self.width - -(-differ // BITS), *(self.width - self._free(w) for w in self.best.values()), self.width)
        out = self.letters(one)[:n]
        self.best = {s: (w >> BITS * self.width << BITS * self.width) | self._digits(w << BITS * n) for s, w in self.best.items()}
        return out

    def end(self) -> tuple[int, str, Said]:
        """Cost, the letters after the settled ones, and what is said, of the least path to an end."""
        state = min((s for s in (NONE, A) if s in self.best), key=self.best.__getitem__)
        return self.best[state] >> BITS * self.width, self.letters(self.best[state]), self.said[state]


class Repaired:
    """One conversation, row by row in order."""

    def __init__(self, conv_id: int | None):
        self.id, self.paths = conv_id, Paths()
        self.low = self.high = self.turn = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.n = 0
        self.audit: list[str] = []

    def add(self, turn: int | None, role: str, text: str, seen: bool, blank: bool, cut: bool) -> None:
        if turn is not None and turn != self.turn:
            self.turns, self.turn, self.low, self.high = self.turns + 1, turn, turn if self.low is None else self.low, turn
        duplicate = not blank and (seen or self.last == (turn, role, text))
        truncated = cut and not blank and not duplicate
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        if self.last is not None:
            self.illegal += self.last[1][:1] + role[:1] not in ("su", "ua", "au")
        self.last = (turn, role, text)
        self.paths.read(role, text, blank or duplicate, truncated)
        self.n += 1
        if self.n % EVERY == 0:
            self.audit.append(self.paths.settle())

    def done(self) -> tuple:
        cost, letters, said = self.paths.end()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.audit) + letters, said.hex())


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TYPES = [pa.string() if x.endswith("string") else pa.int64() for x in RESULT.split(", ")]


def _table(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(_TYPES)
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], [x.split()[0] for x in RESULT.split(", ")])


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now = None
    for b in batches:
        out = []
        for conv, row, turn, role, text, seen, blank, cut in zip(*(b.column(c).to_pylist() for c in ("conv", "row", "turn", "role", "text", "seen", "blank", "cut")), strict=True):
            if now is None or now.id != conv:
                if now:
                    out.append(now.done())
                now = Repaired(conv)
            if row:
                now.add(turn, role, text, seen, blank, cut)
        yield _table(out)
    if now:
        yield _table([now.done()])


def repair_conversations(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row a conversation: faults, and the cheapest edits that give role initials ``(s?(ua)+)?``.

    Columns: conv_id, gaps (turns missing between the first and the last), blank, duplicate, truncated (rows by
    their first fault), illegal (adjacent initials other than su, ua, au), cost, audit (the edits' initials, D, I, K or
    R), repaired_sha256 (of the repaired ``role:text`` lines). Deleting costs 2 and is a must for blank and
    duplicate rows, a new role 1, an inserted turn 5, a truncated row that stays 5.

    Rows follow turn (nulls first), role and text. A null role or text is one space; a role's initial is its first
    character, and an empty role has none and is never kept. A row is a duplicate if an earlier row of the
    conversation has its role and text, so of repeated rows one is left. Rows with a null conv_id are
    one conversation; ``conversations`` (conv_id) adds those without rows: zeros and the digest of
    an empty text. Other columns are ignored; an empty table gives no rows.

    First occurrences are counted before rows meet, so no task gathers equal texts. A conversation is one stream
    in one task, as its digest needs its texts in order; what that holds is a row and four numbers of at most 3 bits an audit letter.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = rows.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), word("role").alias("role"), word("text").alias("text"))
    key = [F.coalesce(F.col("conv").cast("string"), F.lit("")).alias("k"), F.sha2(F.concat_ws("\n", F.length("role"), "role", "text"), 256).alias("h")]
    order = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    first = plain.select(*key, order.alias("o")).groupBy("k", "h").agg(F.min("o").alias("first"), F.max("o").alias("final")).where("first <> final").select("k", "h", "first")  # texts said in several turns
    keyed = plain.select("*", *key).join(first, ["k", "h"], "left")
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    flagged = keyed.select("conv", F.lit(True).alias("row"), "turn", "role", "text", F.coalesce(order > F.col("first"), F.lit(False)).alias("seen"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    if conversations is not None:
        none = lambda t: F.lit(None).cast(t)
        ids = conversations.select(F.col("conv_id").cast("long").alias("conv")).distinct()
        flagged = flagged.unionByName(ids.select("conv", F.lit(False).alias("row"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"), *[F.lit(False).alias(c) for c in ("seen", "blank", "cut")]))
    ordered = flagged.repartition("conv").sortWithinPartitions("conv", "row", "turn", "role", "text")
    return ordered.mapInArrow(_repair, RESULT)


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) damaged by the crc32 of ``conv_id:turn`` (a null is one space, as it is in roles and texts) modulo 20: 0 drops the row,
    1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 makes its role user. All else stays."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", word("conv_id"), word("turn"))) % 20
    cut = rows.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return cut.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")
