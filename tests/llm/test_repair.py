import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from synthscope.llm import repair

COST = {"D": 2, "K": 0, "R": 1, "I": 5}


def least_edits(rows):
    """(cost, audit) by plain recursion over (rows left, state, turns inserted), and the repaired rows. ``rows``: (role, text, must go, truncated)."""

    def moves(state):
        return [(r, t) for r, t in (("s", "S"), ("u", "U"), ("a", "A")) if (state == "N" and r != "a") or (state in "SA" and r == "u") or (state == "U" and r == "a")]

    @cache
    def rest(i, state, put):
        ends = [(0, "", ())] if i == len(rows) and state in "NA" else []
        if put < 3:
            for r, t in moves(state):
                if r != "s":
                    c, a, said = rest(i, t, put + 1)
                    ends.append((c + 5, "I" + a, ((r, ""), *said)))
        if i < len(rows):
            role, text, gone, cut = rows[i]
            c, a, said = rest(i + 1, state, 0)
            ends.append((c + 2, "D" + a, said))
            if not gone:
                for r, t in moves(state):
                    c, a, said = rest(i + 1, t, 0)
                    if role[:1] == r:
                        ends.append((c + 5 * cut, "K" + a, ((role, text), *said)))
                    if r != "s":
                        ends.append((c + 5 * cut + 1, "R" + a, ((r, text), *said)))
        return min(ends, key=lambda e: e[:2], default=(10**9, "", ()))

    return rest(0, "N", 0)


NAMES = {"u": "user", "a": "assistant"}


def expected(rows):
    """Result columns of one conversation's rows (turn, role, text)."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, flagged, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        flagged.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, said = least_edits(flagged)
    text = "\n".join(f"{NAMES.get(r, r)}:{x}" for r, x in said)
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            out += [(conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)] * (2 if kind == 3 else 1)
    return out


def conversations(n=300):
    rng, out = random.Random(6), []
    for c in range(n):
        for t in range(rng.randrange(1, 9)):
            out.append((c, rng.choice([t, t, t, t + 1, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "unknown", ""]), rng.choice(["Yes.", "No!", "x. \n", "cut", "", " \t", None, f"It is {t}?", "。", "a. "])))
    out += [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), out[0], out[0], (9_999, 2**40, "user", "far."), (9_999, -(2**40), "user", "off.")]
    return out


SCHEMA = "conv_id long, turn long, role string, text string, row string, seen int, `a.b` int, conv int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 1, 1) for r in rows], SCHEMA).repartition(3)


def test_against_recursion(spark):
    rows = conversations()
    got = {r[0]: tuple(r)[1:] for r in repair.repair_conversations(frame(spark, rows)).collect()}
    want = {c: expected([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert got == want


def test_damage(spark):
    rows = conversations(400)
    hurt = repair.damage(frame(spark, rows))
    assert sorted((tuple(r) for r in hurt.collect()), key=repr) == sorted(damaged(rows), key=repr)
    got = {r[0]: tuple(r)[1:] for r in repair.repair_conversations(hurt, frame(spark, rows)).collect()}
    want = {c: expected([r[1:] for r in damaged(rows) if r[0] == c]) for c in {r[0] for r in rows}}
    assert got == want and any(r[6] == "" for r in got.values())


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repair_conversations(none).collect() == [] and repair.repair_conversations(repair.damage(none), none).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("uasx"), st.booleans(), st.booleans()), max_size=14), st.sampled_from([4, 8, 96]), st.sampled_from([1, 3, 32]))
def test_numbers_choose_the_least_edits(rows, width, every):
    paths, settled = repair.Paths(width), ""
    for i, (initial, gone, cut) in enumerate(rows):
        paths.read(initial, "", gone, cut)
        if i % every == 0:
            settled += paths.settle()
    cost, letters, _ = paths.end()
    assert (cost, settled + letters) == least_edits(tuple((r, "", gone, cut) for r, gone, cut in rows))[:2]


@pytest.mark.parametrize("pattern", ["ua", "uuaa", "sx", "aau", "u"])
def test_long_conversations(pattern):
    """Numbers stay short where roles alternate; where two ways stay open to the end, they grow, and all is well too."""
    one = repair.Repaired(1)
    for i in range(10_000):
        one.add(i, {"u": "user", "a": "assistant", "s": "system", "x": "tool"}[pattern[i % len(pattern)]], f"{i}.", False, False, False)
    assert len(one.done()[7]) >= 10_000 and (one.paths.width == repair.WIDTH) is (pattern == "ua")


def test_long_texts(spark):
    rows = [(1, 0, "user", "x" * 5_000_000 + "?"), (1, 1, "assistant", " \n" * 2_000_000 + "end. " + " " * 1_000_000)]
    got = repair.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert (got["cost"], got["audit"]) == (0, "KK") and got["repaired_sha256"] == hashlib.sha256("\n".join(f"{r}:{x}" for _, _, r, x in rows).encode()).hexdigest()
