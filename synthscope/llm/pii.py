"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans.

The field scores whole candidate segments (runs of up to ``LONGEST`` tokens) with features
of the span as a whole - its shape, digits, separators and surroundings - and dynamic
programming over bounded segments picks boundaries and types together. Only tokens with a
digit or an at-sign can begin or end a segment; between runs of such tokens every labelling
is "outside", so the programme splits exactly into short windows and long texts cost linear time.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

KINDS = ("email", "ip", "card", "phone")
#: Tokens of a segment at most.
LONGEST = 5
#: What the field is fitted on at most: this many stretches of this many characters, each around the
#: first digit or at-sign of a document, taken in the order of a hash.
SAMPLE, STRETCH = 600, 100

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Walks from at-sign to at-sign, so a long run of letters is looked at once."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            end = m.end()
            out.append((begin, end))
        else:
            end = max(end, at + 1)
        at = text.find("@", max(end, at + 1))
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _NUMBERS.finditer(text):
        parts, begin = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = begin + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0")[:3] or 0) <= 255 for x in four):
                out.append((begin, end))
            begin = end + 1
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns' matches, in order of start and kind."""
    out = [(s, 0, e) for s, e in _emails(text)] + [(s, 1, e) for s, e in _ips(text)]
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- the field -------------------------------------------------------------------------

_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_ANCHOR = re.compile(r"[0-9@]")
_STRIP_LEFT, _STRIP_RIGHT = "\"'<[{|*#$%&!,;:=", "\"'>]}|*#$%&!,;:=.?"
SPAN_FEATURES = 24


def windows(text: str) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring tokens that hold a digit or an at-sign, as lists of (start, end).

    Each anchor is found by one search, and its token by widening, so text without anchors
    costs one scan.
    """
    out, run, m = [], [], _ANCHOR.search(text)
    while m:
        begin = m.start()
        low = run[-1][1] if run else (out[-1][-1][1] if out else 0)
        while begin > low and text[begin - 1] not in " \t\n\x0b\x0c\r":
            begin -= 1
        end = _TOKEN.match(text, begin).end()
        if run and text[run[-1][1] : begin].strip(" \t\n\x0b\x0c\r"):
            out.append(run)
            run = []
        run.append((begin, end))
        m = _ANCHOR.search(text, end)
    return [*out, run] if run else out


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A span without the punctuation around it."""
    while start < end and text[start] in _STRIP_LEFT:
        start += 1
    while end > start and text[end - 1] in _STRIP_RIGHT:
        end -= 1
    return start, end


def span_features(text: str, start: int, end: int, tokens: int) -> np.ndarray:
    """Whole-span features of a candidate segment."""
    start, end = trimmed(text, start, end)
    span = text[start:end]
    digits = sum("0" <= c <= "9" for c in span)
    letters = sum(c.isalpha() for c in span)
    parts = span.split(".")
    quad = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    groups = re.split(r"[ -]", span)
    plain = all(g.isascii() and g.isdigit() for g in groups)
    before = text[max(0, start - 12) : start].rstrip().lower()
    x = np.zeros(SPAN_FEATURES)
    x[:] = (
        1.0, tokens == 1, tokens == 2, tokens == 3, tokens >= 4,
        "@" in span and bool(re.fullmatch(r"[^@]+@[^@.]+(\.[^@.]+)+", span)), "@" in span, quad, len(parts) == 4 and letters == 0,
        plain and 14 <= digits <= 19, plain and digits < 10, plain and 10 <= digits <= 13, digits > 19, letters > 0 and "@" not in span,
        span.startswith("+"), "(" in span and ")" in span, 10 <= digits <= 15 and letters == 0 and bool(re.fullmatch(r"[+(]?[0-9][ ().0-9-]+[0-9]", span)), digits < 7,
        letters == 0 and "-" in span, "\n" in span, before.endswith(("=", ":")) , all(len(g) >= 2 for g in groups) and len(groups) > 1, span.count("(") != span.count(")"), not span,
    )
    return x


class SemiMarkovField:
    """Weights of span features by label (outside and the kinds) and of label pairs."""

    def __init__(self, weights: np.ndarray | None = None, pairs: np.ndarray | None = None):
        k = len(KINDS) + 1
        self.weights = np.zeros((k, SPAN_FEATURES)) if weights is None else weights
        self.pairs = np.zeros((k, k)) if pairs is None else pairs

    @staticmethod
    def lattice(text: str, window: list[tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
        """Features of every candidate segment (first token, token after the last)."""
        n = len(window)
        return {(i, j): span_features(text, window[i][0], window[j - 1][1], j - i) for i in range(n) for j in range(i + 1, min(n, i + LONGEST) + 1)}

    def _score(self, x: np.ndarray, tokens: int) -> np.ndarray:
        """Score of a segment by label; outside segments are single tokens."""
        s = self.weights @ x
        if tokens > 1:
            s[0] = -np.inf
        return s

    def _scores(self, lattice):
        return {(i, j): self._score(x, j - i) for (i, j), x in lattice.items()}

    def _decode(self, score, n: int) -> list[tuple[int, int, int]]:
        """(first, after, label) of the best labelling's entity segments, for a function that scores segments.
        Keeps a row of numbers a token, so a window of any length needs memory in proportion."""
        k = len(KINDS) + 1
        top = np.full((n + 1, k), -np.inf)
        top[0, 0] = 0.0
        back = np.zeros((n + 1, k, 2), np.int32)
        for j in range(1, n + 1):
            for i in range(max(0, j - LONGEST), j):
                ways = top[i][:, None] + self.pairs
                came = ways.argmax(axis=0)
                value = ways[came, np.arange(k)] + score(i, j)
                for y in np.flatnonzero(value > top[j]):
                    top[j, y] = value[y]
                    back[j, y] = (i, came[y])
        out, j, y = [], n, int(top[n].argmax())
        while j > 0:
            i, before = back[j, y].tolist()
            if y:
                out.append((i, j, y))
            j, y = i, before
        return out[::-1]

    def best(self, lattice, n: int) -> list[tuple[int, int, int]]:
        scores = self._scores(lattice)
        return self._decode(lambda i, j: scores[i, j], n)

    def gradient(self, lattice, n: int, gold: list[tuple[int, int, int]]):
        """Gradient of the log-likelihood: observed minus expected feature counts (forward-backward over segments)."""
        k = len(KINDS) + 1
        scores = self._scores(lattice)
        forward, backward = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf)
        forward[0, 0], backward[n] = 0.0, 0.0
        for j in range(1, n + 1):
            for i in range(max(0, j - LONGEST), j):
                forward[j] = np.logaddexp(forward[j], np.logaddexp.reduce(forward[i][:, None] + self.pairs, axis=0) + scores[i, j])
        for i in range(n - 1, -1, -1):
            for j in range(i + 1, min(n, i + LONGEST) + 1):
                backward[i] = np.logaddexp(backward[i], np.logaddexp.reduce(self.pairs + (scores[i, j] + backward[j])[None, :], axis=1))
        whole = np.logaddexp.reduce(forward[n])
        gw, gp = np.zeros_like(self.weights), np.zeros_like(self.pairs)
        for (i, j), x in lattice.items():
            p = np.exp(forward[i][:, None] + self.pairs + (scores[i, j] + backward[j])[None, :] - whole)
            gp -= p
            gw -= np.outer(p.sum(axis=0), x)
        before, at = 0, 0
        for i, j, y in [*gold, (n, n, -1)]:
            for t in range(at, i):  # outside tokens
                gw[0] += lattice[t, t + 1]
                gp[before, 0] += 1
                before = 0
            if y > 0:
                gw[y] += lattice[i, j]
                gp[before, y] += 1
                before, at = y, j
        return gw, gp

    def fit(self, examples, epochs: int = 40, rate: float = 0.5, decay: float = 1e-3) -> SemiMarkovField:
        """Gradient ascent with Adagrad steps over (lattice, n, gold), several at a time, in the order given."""
        past_w, past_p = np.full_like(self.weights, 1e-6), np.full_like(self.pairs, 1e-6)
        for _ in range(epochs):
            for at in range(0, len(examples), 32):
                grads = [self.gradient(*e) for e in examples[at : at + 32]]
                gw = sum(g[0] for g in grads) / len(grads) - decay * self.weights
                gp = sum(g[1] for g in grads) / len(grads) - decay * self.pairs
                past_w += gw**2
                past_p += gp**2
                self.weights = self.weights + rate * gw / np.sqrt(past_w)
                self.pairs = self.pairs + rate * gp / np.sqrt(past_p)
        return self

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind number, end) of the entities found in a text."""
        out = []
        for window in windows(text):
            score = lambda i, j, w=window: self._score(span_features(text, w[i][0], w[j - 1][1], j - i), j - i)
            for i, j, y in self._decode(score, len(window)):
                s, e = trimmed(text, window[i][0], window[j - 1][1])
                if s < e:
                    out.append((s, y - 1, e))
        return out


#: The field learns the base kinds, a card by its length alone (a mistyped number is as
#: private), and a phone number without its plus sign.
_LOCAL_PHONE = re.compile(r"\+?(?:[0-9]{1,3} )?\([0-9]{2,4}\) ?[0-9]{2,4}[ -][0-9]{3,5}")


def gold_segments(text: str, window: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Labelled segments of a training window: token runs whose trimmed text is a seed span."""
    out, i, n = [], 0, len(window)
    while i < n:
        for j in range(min(n, i + LONGEST), i, -1):
            s, e = trimmed(text, window[i][0], window[j - 1][1])
            span = text[s:e]
            digits = re.sub("[ -]", "", span)
            kind = None
            if j == i + 1 and _emails(span) == [(0, len(span))]:
                kind = 0
            elif j == i + 1 and _ips(span) == [(0, len(span))]:
                kind = 1
            elif _CARD.fullmatch(span) and 14 <= len(digits) <= 19:
                kind = 2
            elif (_PHONE.fullmatch(span) and 10 <= sum(c.isdigit() for c in span) <= 15) or _LOCAL_PHONE.fullmatch(span):
                kind = 3
            if kind is not None:
                out.append((i, j, kind + 1))
                i = j
                break
        else:
            i += 1
    return out


#: Windows that every fit sees besides the sample's, so that a sample without personal data gives
#: the same kind of field: fixed values, one per line.
PRIMER = """
ann.lee@mail.example.org
j_smith+news@shop.example.co.uk,
10.0.0.17
192.168.4.250!!
4111111111111111
5500 0000 0000 0004
4012-8888-8888-1881.
+1 (212) 555-0100
(212) 555-0199
+44 20 7946 0958
1999
4.0
2.0.
3.
404 pages
12,500
2024-01-31
1.2.3
300.400.500.600
a1b2c3d4e5f60718293a4b5c6d7e8f9012345678
"9233a8ecf7c5b09fe5949719b6b82bc439e9329b"
v2 7
1 2 3 4 5 6
@
name@
""".strip().split("\n")


def train(texts: list[str]) -> SemiMarkovField:
    """A field fitted on all windows of some texts and of the primer."""
    examples = [(SemiMarkovField.lattice(text, window), len(window), gold_segments(text, window)) for text in [*(f"of {x} the" for x in PRIMER), *texts] for window in windows(text)]
    return SemiMarkovField().fit(examples)


def training_texts(docs: DataFrame, rows: int = SAMPLE) -> list[str]:
    """At most ``rows`` stretches around the first digit or at-sign of a text: a bounded sample in
    the order of a hash. Each text is read up to that character, once."""
    text = F.col("text").cast("string")
    clear = F.length(F.regexp_extract(text, r"\A[^0-9@]*", 0))
    around = F.substring(text, F.greatest(clear - 19, F.lit(1)), F.lit(STRETCH))
    got = docs.where(clear < F.length(text)).select(around.alias("t")).orderBy(F.xxhash64("t"), "t").limit(rows).collect()
    return [r["t"] for r in got]


def covered(spans) -> list[tuple[int, int]]:
    """Maximal runs that sorted spans cover."""
    runs: list[tuple[int, int]] = []
    for s, _, e in spans:
        if runs and s < runs[-1][1]:
            runs[-1] = (runs[-1][0], max(e, runs[-1][1]))
        else:
            runs.append((s, e))
    return runs


def all_spans(text: str, field: SemiMarkovField) -> tuple[list, list]:
    """(base spans, base spans and those of the field that touch none of them), in order of start and kind."""
    base = base_spans(text)
    runs = covered(base)
    starts = [s for s, _ in runs]
    more = [m for m in field.spans(text) if (i := bisect_left(starts, m[2])) == 0 or runs[i - 1][1] <= m[0]] if _ANCHOR.search(text) else []
    return base, sorted([*base, *more])


def _spell(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def _find_batches(batches, field: SemiMarkovField):
    for batch in batches:
        out = []
        for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            base, every = all_spans(text or "", field)
            kinds = [k for _, k, _ in base]
            out.append((d, *(kinds.count(k) for k in range(4)), hashlib.sha256(_spell(base).encode()).hexdigest(), _spell(every), len(every)))
        cols = list(zip(*out, strict=True)) or [[]] * 8
        kinds = [pa.string() if i in (5, 6) else pa.int64() for i in range(8)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])


def find_pii(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per input row: counts by kind and digest of the base spans, and all spans.

    Offsets are code points of the whole text; spans of one start are listed in the order of kinds.
    Null texts are empty; texts of any length cost linear time; repeated rows and rows without an id
    each get their row; other columns are ignored; an empty table gives no rows.
    """
    field = train(training_texts(docs, sample))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(partial(_find_batches, field=field), RESULT)


def redacted(text: str, spans) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans are one, named after the first."""
    out, at = [], 0
    merged: list[list] = []
    for s, k, e in spans:
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(e, merged[-1][2])
        else:
            merged.append([s, k, e])
    for s, k, e in merged:
        out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = e
    return "".join(out) + text[at:]


def _redact_batches(batches, field: SemiMarkovField, names: list[str]):
    for batch in batches:
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        texts = [None if t is None else redacted(t, all_spans(t, field)[1]) for t in cols["text"].to_pylist()]
        cols["text"] = pa.array(texts, pa.string())
        if "n_chars" in cols:
            cols["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(cols["n_chars"].type)
        yield pa.RecordBatch.from_arrays([cols[n] for n in names], names=names)


def redact_pii(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by the kind's name, and ``n_chars`` (if there is one) counted anew.

    Null texts stay null; rows stay as they are otherwise, repeated ones and those without an id
    too; texts of any length cost linear time; an empty table gives no rows.
    """
    field = train(training_texts(docs, sample))
    return mapped(docs, partial(_redact_batches, field=field, names=docs.columns), docs.schema)
