import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from synthscope.llm import editembed as e

from .conftest import documents
from .test_simhash import slow_components


def slow(rows):
    """Brute force with a hash for ties left out: tied rows are compared as a set below."""
    order = sorted(((d, t or "") for d, t in rows if d is not None), key=lambda r: -r[0])
    return order


def test_rows_and_successors(spark):
    rows = [(i * 7 % 101, f"text {i} " * (i % 9) + "é\U0001f600" * (i % 4)) for i in range(101)]
    got = {r["doc_id"]: r for r in e.edit_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    order = slow(rows)
    assert len(got) == len(order)
    for k, (d, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        new, r = e.edited(t, after), got[d]
        want = (len(t), hashlib.sha256(new.encode()).hexdigest(), e.fingerprint(t), e.fingerprint(new), e.likeness(e.fingerprint(t), e.fingerprint(new)), e.likeness(e.fingerprint(t), e.fingerprint(after)))
        assert tuple(r)[1:] == want


def test_awkward_rows(spark, docs, no_docs):
    rows = documents()
    got = e.edit_fingerprints(docs).collect()
    assert sorted((r["doc_id"], r["n_chars"], r["fingerprint"]) for r in got if r["doc_id"] is not None) == sorted((d, len(t or ""), e.fingerprint(t or "")) for d, t, *_ in rows if d is not None)
    assert len(got) == len(rows) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert e.edit_fingerprints(no_docs).collect() == []
    (one,) = e.edit_fingerprints(spark.createDataFrame([(4, "abcd")], "doc_id long, text string")).collect()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one["near_next"] == 1.0
    assert len(e.edit_fingerprints(spark.createDataFrame([(None, "ab"), (None, "ab"), (None, None)], "doc_id long, text string")).collect()) == 3


def test_likeness_follows_edits():
    text = " ".join(f"word{i * 37 % 1009}" for i in range(800))
    near, far = text[:3000] + "x" + text[3000:], " ".join(f"other{i * 53 % 997}" for i in range(800))
    f = e.fingerprint(text)
    assert e.likeness(f, e.fingerprint(text)) == 1.0
    assert e.likeness(f, e.fingerprint(near)) > 0.5 > 0.3 > e.likeness(f, e.fingerprint(far))
    assert e.likeness(e.fingerprint(""), e.fingerprint("")) == 1.0 and e.likeness(e.fingerprint(""), f) == 0.0


def test_walks_agree_with_one_walk():
    texts = [bytes((i * k) % 251 for i in range(k * 13)) for k in range(40)]
    starts = [k * 11 for k in range(40)]
    assert all((a == e.walk(t, s)).all() for a, t, s in zip(e.walks(texts, starts), texts, starts, strict=True))


def slow_fingerprint(text):
    """The walk a step at a time, from the shared random bits themselves."""
    rng = np.random.default_rng(e.SEED)
    steps = rng.integers(0, 2, (256, e.PERIOD)).astype(bool)
    steps[:, -1] = True
    keep = rng.integers(0, 2, (e.PERIOD, 256))
    seen = []
    for c in text:
        p = ord(c)
        p = (p ^ p >> 7 ^ p >> 14) & 255
        while True:
            seen.append(p)
            if steps[p, (len(seen) - 1) % e.PERIOD]:
                break
    octaves = 1
    while e.FIRST << (octaves - 1) < len(seen):
        octaves += 1
    bits = "".join(str(keep[t % e.PERIOD, seen[t]]) if t < len(seen) else "0" for o in range(octaves) for t in e._times(o).tolist())
    return f"{len(seen):x}:{int(bits, 2):0{len(bits) // 4}x}"


def slow_likeness(a, b):
    if a == b:
        return 1.0
    ends, digits = zip(*((int(x.split(":")[0], 16), x.split(":")[1]) for x in (a, b)), strict=True)
    total = covered = 0.0
    for o in range(max(map(len, digits)) // 16):
        begin, size = (0, e.FIRST) if o == 0 else (e.FIRST << (o - 1), e.FIRST << (o - 1))
        times = [t for t in e._times(o).tolist() if t < max(ends)]
        bits = [f"{int(d[16 * o : 16 * o + 16] or '0', 16):064b}" for d in digits]
        score = sum((1 if bits[0][i] == bits[1][i] else -1) for i, t in enumerate(times) if t < min(ends))
        span = min(begin + size, max(ends)) - begin
        total, covered = total + span, covered + span * score / max(len(times), 1)
    return min(1.0, max(0.0, covered / total)) if min(ends) else 0.0


def test_fingerprints_and_likeness_match_brute_force():
    rng = random.Random(4)
    texts = ["", "a", "é中\U0001f600", "x" * 300] + ["".join(rng.choice("abc de\n\u4e2d") for _ in range(rng.randrange(1500))) for _ in range(25)]
    texts += [t[:40] + "!" + t[40:] for t in texts]
    prints = [slow_fingerprint(t) for t in texts]
    assert prints == [e.fingerprint(t) for t in texts]
    for a in prints[:12]:
        for b in prints:
            assert e.likeness(a, b) == pytest.approx(slow_likeness(a, b), abs=1e-12)


def test_ranges_keep_the_order():
    rng = np.random.default_rng(1)
    ids = [None] * 50 + [7] * 300 + rng.integers(-5, 30, 200).tolist() + [-(2**63), 2**63 - 1]
    ties = rng.integers(-(2**63), 2**63 - 1, len(ids))
    cuts = np.sort(~np.array([7, 7, 7, 7, 20, 3, 0], np.int64))
    place = e.buckets(pa.array(ids, pa.int64()), ties, cuts, 4)
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, -(ids[i] or 0), ties[i]))
    assert (np.diff(place[order]) >= 0).all() and len(set(place[50:350].tolist())) >= 4 and len(set(place[:50].tolist())) == 4


def test_extreme_ids(spark):
    rows = [(-(2**63), "least"), (2**63 - 1, "greatest"), (0, "zero"), (None, "none")]
    got = {r["doc_id"]: r["edited_sha256"] for r in e.edit_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = ["greatest", "zero", "least", "none"]
    assert got == {d: hashlib.sha256(e.edited(t, order[(order.index(t) + 1) % 4]).encode()).hexdigest() for d, t in rows}


def test_long_text(spark):
    text = "".join(f"line {i}\n" for i in range(400_000))  # about 5 MB
    got = {r["doc_id"]: r for r in e.edit_fingerprints(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")).collect()}
    assert got[1]["n_chars"] == len(text) and got[1]["edited_sha256"] == hashlib.sha256(e.edited(text, "short").encode()).hexdigest()


def test_groups(spark):
    base = " ".join(f"word{i * 37 % 1009}" for i in range(900))
    texts = [base, base + " end", "the start " + base, " ".join(f"other{i * 53 % 997}" for i in range(900))]
    prints = spark.createDataFrame([(e.fingerprint(t),) for t in texts], "fingerprint string")
    groups = {r["fingerprint"]: r["group"] for r in e.similar_groups(prints, 0.7).collect()}
    assert {groups[e.fingerprint(t)] for t in texts[:2]} != {groups[e.fingerprint(texts[3])]}
    assert groups[e.fingerprint(texts[0])] == groups[e.fingerprint(texts[1])] != groups[e.fingerprint(texts[3])]


def edited_copies(rng, n, size):
    """A text and copies with a few characters changed, added or dropped near their ends."""
    base = "".join(rng.choice("abcdefgh ij") for _ in range(size))
    out = [base]
    for _ in range(n - 1):
        at = rng.randrange(size * 8 // 10, size)
        out.append(base[:at] + rng.choice(["", "x", "new "]) + base[at + rng.randrange(3) :])
    return out


def test_groups_hold_the_like_pairs(spark):
    """At least nine of ten pairs that a comparison of all finds, also where lengths lie on both sides of an octave's end."""
    rng = random.Random(12)
    texts = [t for k in range(60) for t in edited_copies(rng, 5, 200 + 40 * k)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = e.grouped_fingerprints(frame).collect()
    group, prints = {r["doc_id"]: r["group_id"] for r in rows}, {r["doc_id"]: r["fingerprint"] for r in rows}
    pairs = [(a, b) for a, b in itertools.combinations(prints, 2) if e.likeness(prints[a], prints[b]) >= e.ALIKE]
    assert len(pairs) > 200
    assert sum(group[a] == group[b] for a, b in pairs) >= 0.9 * len(pairs)
    root = slow_components(prints, pairs)
    assert all(root[d] == root[g] for d, g in group.items())  # nothing else is linked


def test_groups_in_a_crowd(spark):
    rng = random.Random(13)
    texts = edited_copies(rng, 2000, 900)
    rows = e.grouped_fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)).collect()
    base = next(r["fingerprint"] for r in rows if r["doc_id"] == 0)
    alike = [r["group_id"] for r in rows if e.likeness(base, r["fingerprint"]) >= e.ALIKE]
    assert len(alike) > 500 and alike.count(0) >= 0.9 * len(alike)


def test_members_of_a_bucket_that_stay_apart_all_meet(spark, monkeypatch):
    """Members that hub and pick leave in different groups meet each other, whatever the bucket's size, and no others do."""
    monkeypatch.setattr(e, "BLOCK", 16)
    keyed = spark.createDataFrame([(7, i) for i in range(100)] + [(8, i) for i in (3, 4)], "key long, id long")
    hubs = spark.createDataFrame([(7, 0, 1), (8, 3, 4)], "key long, hub long, pick long")
    groups = spark.createDataFrame([(i, i % 2 + 10) for i in range(10, 30)], "node long, root long")
    root = {i: i % 2 + 10 if 10 <= i < 30 else i for i in range(100)}
    want = sorted((a, b) for a in range(2, 100) for b in range(a + 1, 100) if root[a] != root[b])
    assert sorted(map(tuple, e.pairs_apart(keyed, hubs, groups).collect())) == want
