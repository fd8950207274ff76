import hashlib
import random

import pytest

from synthscope.llm import suffix

from .conftest import SCHEMA, documents


def slow(rows):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49) if d is not None else ():
            first[b[i : i + 50]] = min(d, first.get(b[i : i + 50], d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49) if d is not None else ():
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_matches_brute_force(docs):
    for sort_rows in (suffix.SORT_ROWS, 1):  # strings of several contexts sorted, or split by windows
        got = sorted((tuple(r) for r in suffix.remove_repeats(docs, sort_rows).collect()), key=str)
        assert got == slow([r[:2] for r in documents()])


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force_on_repetitive_texts(spark, seed):
    rng = random.Random(seed)
    pieces = ["".join(rng.choice("abc é") for _ in range(rng.randrange(20, 90))) for _ in range(12)] + ["a" * 70, "ab" * 40]
    rows = [(rng.randrange(40), "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 8)))) for _ in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in suffix.remove_repeats(frame, 40_000 if seed == 1 else 3).collect()), key=str) == slow(rows)


def test_deep_shallow_order_sorts():
    rng = random.Random(4)
    for n in (1, 2, 30, 500):
        strings = [bytes(rng.choice(b"ab\0\xff") for _ in range(40)) for _ in range(n)]
        strings += [s[:30] + b"z" * 10 for s in strings[: n // 2]] + strings[: n // 3]
        assert [strings[i] for i in suffix.deep_shallow_order(strings)] == sorted(strings)


def test_empty(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_text(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    text = "".join(f"line {i}\n" for i in range(200_000)) + passage  # about 2 MB
    got = {r["doc_id"]: r for r in suffix.remove_repeats(spark.createDataFrame([(1, passage), (2, text)], "doc_id long, text string")).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] >= len(passage) and got[2]["n_bytes"] == len(text)
