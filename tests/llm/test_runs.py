import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from synthscope.llm import queries, runs


def brute(w, least=12):
    """All runs, by the stretches in which words q apart are equal, for every q."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - start >= max(least, 2 * q) and i > start:
                found.setdefault((start, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def tuples(found):
    return sorted(tuple(r) for r in found.tolist())


def word_list(text):
    return (text or "").encode().split()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60), st.integers(1, 9), st.lists(st.sampled_from([b"a", b"d"]), max_size=5)), min_size=1, max_size=4), st.sampled_from([2, 12]))
def test_runs_of_several_texts(parts, least):
    texts = [w * k + tail for w, k, tail in parts]
    assert [tuples(r) for r in runs._together(texts, least)] == [brute(t, least) for t in texts]


def test_words_of_theory():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 800:
        a, b = b, b + a
    thue_morse = [b"ab"[i.bit_count() % 2 :][:1] for i in range(2048)]  # its hashes collide, and it has no cubes
    assert [tuples(r) for r in runs._together([b, thue_morse, [b"x"] * 700], 12)] == [brute(b), brute(thue_morse), [(0, 700, 1)]]


def test_collisions_cost_no_result(monkeypatch):
    monkeypatch.setattr(runs, "_mixed", lambda x: (x % 2).astype(np.uint64))
    rng = random.Random(3)
    texts = [[b"%d" % rng.randrange(4) for _ in range(60)] for _ in range(40)]
    texts += [t[:15] * 3 for t in texts]
    assert [tuples(r) for r in runs._together(texts, 12)] == [brute(t) for t in texts]


def test_long_texts():
    rng = random.Random(4)
    words = [b"w%d" % rng.randrange(50_000) for _ in range(400_000)]
    words[300_000:] = (words[300_000:310_007] * 10)[:100_000]
    assert tuples(runs._together([words], 12)[0]) == [(300_000, 100_000, 10_007)]
    assert tuples(runs._together([[b"x", b"y"] * 200_000], 12)[0]) == [(0, 400_000, 2)]


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone).decode()


def test_texts(spark, docs, no_docs):
    more = docs.limit(0).unionByName(spark.createDataFrame([(900, "to be " * 9 + "x", "en", "s", 0, 1, 1, 1, 1, 1), (901, " a\tb\n" * 40, "en", "s", 0, 1, 1, 1, 1, 1)], docs.schema))
    frame = docs.unionByName(more).withColumn("runs", F.lit(1)).withColumn("a.b", F.lit(1)).withColumn("id", F.lit(2))
    want = sorted(((r["doc_id"], brute(word_list(r["text"])), collapsed(word_list(r["text"]), brute(word_list(r["text"])))) for r in frame.collect() if len(word_list(r["text"])) < 1000), key=repr)
    got = sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.periodic_runs(frame).collect() if len(r["collapsed"]) < 8000 or r["doc_id"] != 46), key=repr)
    assert [g for g in got if g[:2] in [w[:2] for w in want]] == want and len(got) >= len(want)
    assert runs.periodic_runs(no_docs).collect() == []


def test_query(spark, tmp_path):
    import zlib

    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(0, 90)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "one"), (None, "a b " * 20), (503, "x y z " * 30), (504, "é 中  \x0b q" * 9), (505, "\u0085 w" * 20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc_id, text in rows:
        w = word_list(text)
        h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h is not None and h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        found = brute(w)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        found.sort(key=lambda r: (r[0], r[2]))
        want.append((doc_id, len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(collapsed(w, found))))
    got = [tuple(r) for r in queries.QUERIES["op12_runs"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in want) > 8


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_query_on_nothing(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r["n_runs"] for r in queries.QUERIES["op12_runs"](spark, str(tmp_path)).collect()] == [0] * len(rows)
