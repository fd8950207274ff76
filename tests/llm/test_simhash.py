import itertools
import random
import re

import pytest
import xxhash

from synthscope.llm import simhash
from synthscope.llm.graph import connected_components

from .conftest import documents


def slow_fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, links):
    root = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def test_components_match_brute_force(docs):
    rows = [(r[0], slow_fingerprint(r[1])) for r in documents()]
    prints = {p for _, p in rows}
    root = slow_components(prints, [(a, b) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= 2])
    least = {}
    for d, p in rows:
        if d is not None:
            least[root[p]] = min(d, least.get(root[p], d))
    want = sorted(((d, f"{p:016x}", least.get(root[p])) for d, p in rows), key=str)
    got = sorted((tuple(r) for r in simhash.simhash_components(docs).collect()), key=str)
    assert got == want


@pytest.mark.parametrize("dense", [1, 3, 64])
def test_links_match_brute_force_whatever_is_crowded(spark, dense):
    rng = random.Random(dense)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        prints |= {centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (2**64 - 1) for _ in range(12)}
    signed = [(simhash._signed(p),) for p in prints]
    got = {frozenset(r) for r in simhash.hamming_links(spark.createDataFrame(signed, "fp long"), 2, dense).collect()}
    want = {frozenset(map(simhash._signed, p)) for p in itertools.combinations(prints, 2) if (p[0] ^ p[1]).bit_count() <= 2}
    assert got == want


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    assert {r["node"]: r["root"] for r in connected_components(edges).collect()} == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_empty(no_docs):
    assert simhash.simhash_components(no_docs).collect() == []
