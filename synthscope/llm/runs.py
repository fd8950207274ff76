"""Periodic runs of words, found by catching squares over power-of-two blocks.

Once a block of L = 2^k words is complete, it is a catcher: after each of the words appended next, the last L
words are compared with it, until they lie 4 L - 2 words behind. A match at distance d is part
of a repetition of period d; it is carried on in both directions as far as words d apart are equal, and if
that gives a square (2 d words), it is reported and merged into the run of that extent.

A run of period q has q words or more that equal the word q further on, so it holds a whole block of L words with
2 L - 1 <= q, and the catchers of one level for each octave of periods catch every run. Suffixes
are compared by a rolling hash, for all catchers of a level and a stretch of appended words at once; what
is reported is compared word by word, so a collision costs time but no result.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from itertools import chain, compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Comparisons held at once, and words of texts that are searched together, about.
AT_ONCE, WORDS_AT_ONCE = 1 << 20, 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
LEAST = 12


def _mixed(x: np.ndarray) -> np.ndarray:
    """A random-looking 64-bit number for each word number."""
    x = (x.astype(np.uint64) + np.uint64(1)) * _BASE
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    """The first n powers of the base; arithmetic is modulo 2^64."""
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * (out[have - 1 : have] * _BASE)
        have += more
    return out


class Appended:
    """Words appended so far, as numbers, with hashes of all stretches of them. Texts follow one another; ``ends`` has the end of each."""

    def __init__(self, words: np.ndarray, ends: np.ndarray):
        self.words = words
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        self.starts, self.ends = starts, ends.astype(np.int64)
        self.text = np.repeat(np.arange(len(ends)), self.ends - starts)
        self.power = _powers(len(words) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(words) * self.power[: len(words)])])

    def equal(self, a: np.ndarray, d: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from a have the hash of the n words from a + d."""
        return (self.sums[a + n] - self.sums[a]) * self.power[d] == self.sums[a + d + n] - self.sums[a + d]

    def reach(self, a: np.ndarray, d: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words from a on (or before a) equal the words d further on; ``most`` at most."""
        low, high = np.zeros_like(most), most.copy()
        step = np.minimum(1, high)
        while True:  # gallop, then halve
            open_ = (step > low) & (step <= high)
            if not open_.any():
                break
            at = a - step if back else a
            ok = np.zeros(len(a), bool)
            ok[open_] = self.equal(at[open_], d[open_], step[open_])
            low, high = np.where(ok, step, low), np.where(open_ & ~ok, step - 1, high)
            step = np.where(ok, np.minimum(2 * step, high), step)
            step = np.where(ok | (step <= high), step, low)
            if not ok.any():
                break
        while (low < high).any():
            mid = (low + high + 1) // 2
            open_ = low < high
            ok = np.zeros(len(a), bool)
            at = a - mid if back else a
            ok[open_] = self.equal(at[open_], d[open_], mid[open_])
            low, high = np.where(ok, mid, low), np.where(open_ & ~ok, mid - 1, high)
        return low

    def caught(self, block: int, nearest: int, farthest: int, least_words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(start of a catcher, distance) of the suffixes that equal their catcher of ``block`` words, at the given distances, in texts of so many words."""
        n = (self.ends - self.starts) // block
        n[self.ends - self.starts < least_words] = 0
        if not n.sum():
            return
        first = np.repeat(np.cumsum(n) - n, n)
        own = np.repeat(self.starts, n) + (np.arange(n.sum()) - first) * block
        end = np.repeat(self.ends, n)
        hashes = self.sums[own + block] - self.sums[own]
        for low in range(nearest, farthest + 1, 4096):
            d = np.arange(low, min(low + 4096, farthest + 1))
            able = own + low + block <= end
            a, h, e = own[able], hashes[able], end[able]
            step = max(1, AT_ONCE // len(d))
            for i in range(0, len(a), step):
                at = a[i : i + step, None] + d[None, :]
                inside = at + block <= e[i : i + step, None]
                at = np.where(inside, at, a[i : i + step, None])
                r, c = np.nonzero((h[i : i + step, None] * self.power[d][None, :] == self.sums[at + block] - self.sums[at]) & inside)
                if len(r):
                    yield a[i + r], d[c]

    def exact(self, start: int, end: int, d: int) -> bool:
        """Whether words d apart are equal from start to end, and not beyond."""
        w, t = self.words, self.text[start]
        return bool((w[start : end - d] == w[start + d : end]).all()) and (start == self.starts[t] or w[start - 1] != w[start - 1 + d]) and (end == self.ends[t] or w[end] != w[end - d])

    def scanned(self, a: int, d: int, block: int) -> tuple[int, int] | None:
        """The extent of period d around a catcher, word by word."""
        w, t = self.words, self.text[a]
        if not (w[a : a + block] == w[a + d : a + d + block]).all():
            return None
        start, end = a, a + d + block
        while start > self.starts[t] and w[start - 1] == w[start - 1 + d]:
            start -= 1
        while end < self.ends[t] and w[end] == w[end - d]:
            end += 1
        return start, end

    def runs(self, least: int = LEAST) -> np.ndarray:
        """Rows (text, start, length, period) of all runs of ``least`` words or more, by start and period; starts are numbered within the text."""
        longest = int((self.ends - self.starts).max(initial=0))
        levels = []
        for q in range(1, 7):  # the words that repeat are at least least - q here, which may hold larger blocks
            block = 1
            while 2 * (2 * block) - 1 <= max(least - q, q):
                block *= 2
            levels.append((block, q, q))
        block = 4
        while 2 * block - 1 <= longest // 2:
            levels.append((block, max(7, 2 * block - 1), 4 * block - 2))
            block *= 2
        found = []
        for block, low, high in levels:
            for a, d in self.caught(block, low, high, max(least, 2 * low)):
                if found:  # a multiple of a known run's period gives that run again
                    found = [_merged(np.concatenate(found))]
                    new = ~_known(found[0], a, a + d + block, d)
                    a, d = a[new], d[new]
                t = self.text[a]
                start = a - self.reach(a, d, a - self.starts[t], True)
                end = a + d + block + self.reach(a + block, d, self.ends[t] - a - d - block, False)
                whole = end - start >= np.maximum(2 * d, least)
                found.append(np.unique(np.stack([start, end, d, a, np.full(len(a), block)], 1)[whole], axis=0))
        merged = _merged(np.concatenate(found)) if found else np.zeros((0, 5), np.int64)
        sure = np.array([self.exact(s, e, d) for s, e, d in merged[:, :3].tolist()], bool)
        if not sure.all():  # a collision: word by word, for all that was caught with the same extent or period
            again = []
            for block, low, high in levels:
                for a, d in self.caught(block, low, high, max(least, 2 * low)):
                    for x, y in zip(a.tolist(), d.tolist(), strict=True):
                        ends = self.scanned(x, y, block)
                        if ends and ends[1] - ends[0] >= max(2 * y, least):
                            again.append((*ends, y, x, block))
            merged = _merged(np.array(sorted(set(again)), np.int64).reshape(-1, 5))
        text = self.text[merged[:, 0]]
        out = np.stack([text, merged[:, 0] - self.starts[text], merged[:, 1] - merged[:, 0], merged[:, 2]], 1)
        return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _merged(rows: np.ndarray) -> np.ndarray:
    """Squares of one extent are one run: its period is the smallest, which divides the others."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])
    return rows[new]


def _known(runs: np.ndarray, start: np.ndarray, end: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Whether the run that reaches farthest, of those that begin by ``start``, holds the stretch and has a period that divides d."""
    if not len(runs):
        return np.zeros(len(d), bool)
    order = np.where(runs[:, 1] == np.maximum.accumulate(runs[:, 1]), np.arange(len(runs)), 0)
    farthest = runs[np.maximum.accumulate(order)]
    at = np.searchsorted(runs[:, 0], start, "right") - 1
    return (at >= 0) & (farthest[at, 1] >= end) & (d % farthest[at, 2] == 0)


def _together(texts: list[list[bytes]], least: int) -> list[np.ndarray]:
    """Runs (start, length, period) of each text."""
    out, at = [], 0
    while at < len(texts):
        n, size = at, 0
        while n < len(texts) and (n == at or size + len(texts[n]) <= WORDS_AT_ONCE):
            size += len(texts[n])
            n += 1
        part = texts[at:n]
        numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        words = np.fromiter(map(numbers.__getitem__, chain.from_iterable(part)), np.int64, size)
        runs = Appended(words, np.cumsum([len(t) for t in part], dtype=np.int64)).runs(least)
        ends = np.searchsorted(runs[:, 0], np.arange(len(part) + 1))
        out += [runs[s:e, 1:] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        at = n
    return out


def _found(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [(x or "").encode().split() for x in b.column("text").to_pylist()]
        runs, kept, n_runs = _together(texts, least), [], []
        for words, r in zip(texts, runs, strict=True):
            if len(r):
                keep = np.zeros(len(words) + 1, np.int64)
                np.add.at(keep, r[:, 0] + r[:, 2], 1)
                np.add.at(keep, r[:, 0] + r[:, 1], -1)
                words = compress(words, (np.cumsum(keep[:-1]) == 0).tolist())
            kept.append(b" ".join(words).decode())
            n_runs.append(len(r))
        ends = pa.array(np.concatenate([[0], np.cumsum(n_runs)]), pa.int32())
        every = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
        items = pa.StructArray.from_arrays([pa.array(every[:, j], pa.int64()) for j in range(3)], ["start", "length", "period"])
        yield pa.record_batch({"id": b.column("id"), "runs": pa.ListArray.from_arrays(ends, items), "collapsed": pa.array(kept)})


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(id_col, runs, collapsed): each text's runs - arrays of (start, length, period), by start, then period - and its text without their repeats.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text. A run is a stretch of ``least`` words or more, and of
    twice its smallest period q or more, in which words q apart are equal, and which cannot be made longer. A word
    is left out of ``collapsed`` if a run holds it after its first q words; the others are joined by one space.

    Each text is searched by itself where it lies; nothing is shuffled. A text's n words cost n log n
    comparisons, however repetitive they are, and about 100 bytes a word. A null text is an empty
    one; a text without words has no runs; null ids and repeated rows stay as they are; other columns
    are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = rows.mapInArrow(partial(_found, least=least), "id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return out.withColumnRenamed("id", id_col)


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per text: number of runs, the longest (ties: least start, then period; nulls without runs), and digests of the runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    best = found.select(id_col, F.size("runs").cast("long").alias("n_runs"), first.alias("b"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = -F.col("b.l"), F.col("b.period")
    return best.select(id_col, "n_runs", F.col("b.start").alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
