import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from synthscope.llm import neardup

from .conftest import documents
from .test_simhash import slow_components


def test_near_duplicates(spark):
    rng = random.Random(9)
    rows, group = [], {}
    for g in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        for k in range(6):
            own = list(words)
            for _ in range(0 if k == 1 else k):
                own[rng.randrange(300)] = f"new{rng.randrange(10**6)}"
            rows.append((100 * g + k, " ".join(own)))
            group[100 * g + k] = 100 * g
    frame = spark.createDataFrame([*rows, (None, "a text without a number"), (5000, None), (5001, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["group_id"] for r in neardup.near_duplicate_groups(frame).collect()}
    assert got == group | {5000: 5000, 5001: 5000}
    kept = [r["doc_id"] for r in neardup.drop_near_duplicates(frame).collect()]
    assert sorted(kept, key=str) == sorted([*set(group.values()), None, 5000], key=str)


def test_empty(no_docs):
    assert neardup.near_duplicate_groups(no_docs).collect() == []
    assert neardup.drop_near_duplicates(no_docs).collect() == []


def exact_shingles(text, n=5):
    words = text.lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def exact_jaccard(a, b):
    one, two = exact_shingles(a), exact_shingles(b)
    return len(one & two) / len(one | two)


def exact_pairs(texts):
    sets = {d: exact_shingles(t) for d, t in texts.items()}
    return [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]


def test_near_duplicates_of_every_kind_of_edit(spark):
    rng = random.Random(31)
    make = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    rows, pairs = [], []
    for k in range(60):
        words = make(200 + 20 * k)
        n = len(words)
        edits = [words + make(n * 22 // 100), make(n * 22 // 100) + words, words[: n * 83 // 100], words[n * 17 // 100 :], words[: n // 2] + make(n * 20 // 100) + words[n // 2 :]]
        rows.append((10 * k, " ".join(words)))
        for j, edit in enumerate(edits, 1):
            if exact_jaccard(" ".join(words), " ".join(edit)) >= 0.8:
                rows.append((10 * k + j, " ".join(edit)))
                pairs.append((10 * k, 10 * k + j))
    assert len(pairs) > 250
    got = {r["doc_id"]: r["group_id"] for r in neardup.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [p for p in pairs if got[p[1]] != got[p[0]]] == []
    assert len(set(got.values())) == 60


def test_crowded_buckets_are_searched_in_full(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(200)]
    template, rows = [f"t{k}" for k in range(60)], []
    for k in range(150):  # one template, one vocabulary
        own = vocabulary[:]
        rng.shuffle(own)
        rows.append((k, " ".join(template + own[:25])))
    for k in range(10):
        words = rows[k][1].split()
        rows.append((1000 + k, " ".join([*words[:-1], "changed"])))
    words = vocabulary[:150]
    for k in range(2000, 2300):  # one set of words
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        if k < 2010:
            rows.append((k + 1000, " ".join([*words[:-2], words[-1], words[-2]])))
    texts = dict(rows)
    want = exact_pairs(texts)
    assert len(want) >= 20
    root = slow_components(texts, want)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["group_id"] for r in neardup.near_duplicate_groups(frame).collect()}
    assert [p for p in want if got[p[0]] != got[p[1]]] == []
    assert got == root


def test_only_texts_within_the_limit_are_linked(spark):
    rng = random.Random(8)
    rows = []
    for k in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        own = list(words)
        for at in rng.sample(range(10, 290), 9):
            own[at] = f"new{rng.randrange(10**6)}"
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(own))]
    rows += [(2000, "a line that comes again and again " * 300 + " ".join(f"x{i}" for i in range(40))), (2001, "a line that comes again and again " * 300 + " ".join(f"y{i}" for i in range(40)))]
    texts = dict(rows)
    root = slow_components(texts, exact_pairs(texts))
    got = neardup.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["group_id"] for r in got} == root


def test_unrelated_texts_of_one_id_are_judged_each(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(50)) for c in "ab")
    frame = spark.createDataFrame([(1, a), (2, a), (2, b), (2, b), (3, b), (4, a)], "doc_id long, text string")
    assert sorted(tuple(r) for r in neardup.drop_near_duplicates(frame).collect()) == [(1, a), (2, b)]


def test_awkward_rows(docs):
    rows = documents()
    kept = neardup.drop_near_duplicates(docs).collect()
    assert {len(r) for r in kept} == {10}
    texts = {i: r for i, r in enumerate(rows) if r[0] is not None}
    root = slow_components(texts, exact_pairs({i: r[1] or "" for i, r in texts.items()}))
    want = {min((texts[j][0], j) for j in texts if root[j] == g)[0] for g in set(root.values())}
    assert {r["doc_id"] for r in kept if r["doc_id"] is not None} == want
    assert len([r for r in kept if r["doc_id"] is None]) == 2
    again = neardup.drop_near_duplicates(docs.repartition(3)).collect()
    assert sorted(map(str, kept)) == sorted(map(str, again))


def test_sixty_pairs_in_one_bucket(spark):
    """Pairs of texts that share a long passage, so that all meet, and are alike only in twos."""
    rng = random.Random(60)
    make = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    passage, rows = make(80), []
    for k in range(60):
        words = passage + make(60)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:-2], "new"]))]
    got = {r["doc_id"]: r["group_id"] for r in neardup.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k - k % 2 for k in range(120)}


def test_crowd_of_edited_copies(spark):
    """Copies of one text, most of which are alike with it but not with each other, cost no pair of copies each."""
    rng = random.Random(10)
    words = [f"w{rng.randrange(9000)}" for _ in range(120)]
    rows = [(0, " ".join(words))]
    for k in range(1, 3000):
        own = list(words)
        for at in rng.sample(range(5, 115), rng.choice((1, 2, 3))):
            own[at] = f"new{rng.randrange(10**9)}"
        rows.append((k, " ".join(own)))
    base = exact_shingles(rows[0][1])
    alike = {d for d, t in rows if len(base & exact_shingles(t)) >= 0.8 * len(base | exact_shingles(t))}
    assert 1500 < len(alike) < 3000
    got = {r["doc_id"]: r["group_id"] for r in neardup.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert {d for d, g in got.items() if g == 0} >= alike


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 400), min_size=1, max_size=120), st.randoms(use_true_random=False))
def test_similar_sets_share_a_finer_key(a, rng):
    b = set(a)
    for _ in range(rng.randrange(0, 1 + len(a) // 4)):
        b.discard(rng.choice(sorted(a))) if rng.random() < 0.5 else b.add(rng.randrange(1000, 2000))
    if b and len(a & b) >= 0.8 * len(a | b):
        one, two = ({k: place for k, _, place in neardup.prefix_keys(len(x), sorted(x, key=lambda v: (v * 7919 % 1009, v)), 0.8)} for x in (a, b))
        assert any(min(len(a) - one[k], len(b) - two[k]) >= (len(a) + len(b)) * 0.8 / 1.8 - 1e-9 for k in one.keys() & two.keys())


def test_crowd_below_the_limit_costs_no_pair_each(spark, monkeypatch):
    """Texts that share 86 % of their words meet hardly any other; the pairs among them that are alike are found all the same."""
    rng = random.Random(12)
    template = [f"w{rng.randrange(9000)}" for _ in range(215)]
    texts = {k: template + [f"x{rng.randrange(10**9)}" for _ in range(35)] for k in range(1500)}
    texts |= {10_000 + k: [*texts[7 * k][:-3], "new", "end", f"y{k}"] for k in range(20)}
    keys, finer = [], neardup._finer_keys
    monkeypatch.setattr(neardup, "_finer_keys", lambda *a: keys.append(finer(*a)) or keys[-1])
    frame = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["group_id"] for r in neardup.near_duplicate_groups(frame).collect()}
    assert all(got[10_000 + k] == got[7 * k] for k in range(20)) and len(set(got.values())) == 1500
    met = keys[0].groupBy("key").pivot("role", [0, 1, 2]).count().fillna(0).selectExpr("sum(`0` * (`0` - 1) / 2 + `1` * `2`)").first()[0]
    assert (met or 0) < 20 * len(texts)


def test_sets_are_searched_by_simhash(spark, monkeypatch):
    """Sets meet the least set of their own fingerprint, and those of fingerprints that differ in up to two bits; only similar sets are linked."""
    rng = random.Random(21)
    texts = {100 * g: [f"w{rng.randrange(5000)}" for _ in range(400)] for g in range(8)}
    texts |= {g + k: [*texts[g][:-k], *[f"end{g}"] * k] for g in list(texts) for k in (1, 2, 3)}
    texts |= {9000 + k: [f"a{k}", *("b c d e f g h".split())] for k in range(6)}
    found, links, search, hamming = [], [], neardup._fingerprint_pairs, neardup.hamming_links
    monkeypatch.setattr(neardup, "_fingerprint_pairs", lambda *a: found.append(search(*a)) or found[-1])
    monkeypatch.setattr(neardup, "hamming_links", lambda *a: links.append(hamming(*a)) or links[-1])
    rows = [(k, " ".join(w)) for k, w in texts.items()]
    got = {r["doc_id"]: r["group_id"] for r in neardup.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {k: neardup.shingles(t.encode()) for k, t in rows}
    prints = {neardup.set_id(s): neardup.set_fingerprint(s) for s in sets.values()}
    size = {neardup.set_id(s): len(s) for s in sets.values()}
    able = lambda a, b: min(size[a], size[b]) >= 0.8 * max(size[a], size[b])
    least = {f: min(n for n in prints if prints[n] == f) for f in prints.values()}
    bits = lambda a, b: ((prints[a] ^ prints[b]) % (1 << 64)).bit_count()
    close = {(a, b) for a, b in itertools.combinations(sorted(prints), 2) if able(a, b) and least[prints[a]] == a and (not bits(a, b) or bits(a, b) <= 2 and least[prints[b]] == b)}
    assert close and {tuple(r) for r in found[0].collect()} == close and len(links) == 1
    alike = [(a, b) for a, b in itertools.combinations(sets, 2) if len(set(sets[a].tolist()) & set(sets[b].tolist())) >= 0.8 * len(set(sets[a].tolist()) | set(sets[b].tolist()))]
    assert got == slow_components(list(sets), alike)


def broadcasts(spark, job):
    """What ``job`` gives, and (rows, keys) of all relations that went through the driver meanwhile."""
    store, out = spark._jsparkSession.sharedState().statusStore(), []
    items = lambda seq: (seq.apply(i) for i in range(seq.size()))
    since = max((run.executionId() for run in items(store.executionsList())), default=-1)
    result = job()
    for run in items(store.executionsList()):
        if run.executionId() > since:
            values = store.executionMetrics(run.executionId())
            for node in items(store.planGraph(run.executionId()).allNodes()):
                if node.name() == "BroadcastExchange":
                    of = {m.name(): values.apply(m.accumulatorId()) for m in items(node.metrics()) if values.contains(m.accumulatorId())}
                    out.append((int(of.get("number of output rows", "0").replace(",", "")), node.desc().count("input[")))
    return result, out


def test_no_wide_or_exploded_rows_go_through_the_driver(spark):
    """Members of finer buckets with their keys and tallies, and the balls around fingerprints, are merged; both were broadcast before."""
    rng = random.Random(14)
    rows = []
    for g in range(30):
        parts = [[[f"w{rng.randrange(10**6)}" for _ in range(12)] for _ in range(4)] for _ in range(20)]
        rows += [(100 * g + k, " ".join(w for p in parts for w in p[rng.randrange(1, 4) if rng.random() < 0.08 else 0])) for k in range(40)]
    groups, sent = broadcasts(spark, lambda: neardup.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert len(groups) == len(rows) and sent  # those with two keys: by segment and value, by key and role
    assert max((n for n, keys in sent if keys == 2), default=0) < 4 * len(rows)


def test_long_text(spark):
    text = " ".join(f"w{i % 99991}" for i in range(700_000))  # about 5 MB
    frame = spark.createDataFrame([(1, text), (2, text + " and more"), (3, "short")], "doc_id long, text string")
    assert {r["doc_id"]: r["group_id"] for r in neardup.near_duplicate_groups(frame).collect()} == {1: 1, 2: 1, 3: 3}
