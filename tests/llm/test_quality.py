import random
import zlib

import numpy as np

from synthscope.llm import quality

from .conftest import documents, prose


def corpus():
    rng = random.Random(3)
    rows = []
    for i in range(600):
        good = i % 3 != 0
        text = ". ".join(prose(rng, 12).capitalize() for _ in range(rng.randrange(2, 9)))
        if not good:
            text = [text.upper().replace(" ", "!! "), " | ".join(text.split()), text[:20] * 20, text.replace(" ", "### ")][i % 4]
        rows.append((i, text, int(good)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i]["score"] <= 1 and got[i]["predicted"] == (got[i]["score"] >= 0.5) for i, _, _ in rows)
    held = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert sum(p == y for p, y in held) > 0.95 * len(held)
    flipped = spark.createDataFrame([(r[0], 1 - r[2] if got[r[0]]["held_out"] else r[2], 0) for r in rows], "doc_id long, quality int, toxic int")
    again = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, flipped).collect()}
    assert all(abs(again[i] - got[i]["score"]) < 1e-9 for i in again)  # held-out labels teach nothing
    kept = {r["doc_id"] for r in quality.keep_good(docs, labels).collect()}
    assert kept == {i for i in got if got[i]["predicted"] == 1}


def test_scores_are_those_of_the_densities(spark):
    rng = np.random.default_rng(0)
    d = len(quality.FEATURES)
    x = {c: rng.normal(size=(60 + 40 * c, d)) * (1 + c) + c for c in (0, 1)}
    frame = spark.createDataFrame([(c, *map(float, r)) for c in x for r in x[c]], "quality int, " + ", ".join(f"{f} double" for f in quality.FEATURES))
    model = quality.fit(frame)
    n = {c: len(x[c]) for c in x}
    own = {c: np.cov(x[c].T) for c in x}
    common = sum(own[c] * (n[c] - 1) for c in x) / (sum(n.values()) - 2)
    logs = []
    point = rng.normal(size=(5, d))
    for c in x:
        share = max(quality.SHRINK_POOLED, d / (n[c] + d))
        cov = (1 - quality.SHRINK_SCALE) * ((1 - share) * own[c] + share * common) + quality.SHRINK_SCALE * np.diag(np.diag(common)) + 1e-9 * np.eye(d)
        z = point - x[c].mean(axis=0)
        logs.append(np.log(n[c] / sum(n.values())) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ni,ij,nj->n", z, np.linalg.inv(cov), z))
    assert np.allclose(model.score(point), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_awkward_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (2, 1), (None, 1), (3, None), (4, 7), (999, 0)], "doc_id long, quality int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(documents()) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.quality_scores(no_docs, labels).collect() == []
    assert {r["score"] for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in quality.quality_scores(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert quality.keep_good(docs, labels.where("quality = 1")).columns == docs.columns


def slow_statistics(text):
    """Each statistic by its definition, a character and a word at a time."""
    t = text or ""
    b = t.encode()
    n, words = max(len(b), 1), b.split()
    k = max(len(words), 1)
    lines = [x for x in b.split(b"\n") if x]
    share = lambda keep: (sum(1 for c in t if keep(c)) / n) ** 0.5
    return [
        np.log(1 + len(words)), np.log(1 + len(b) / k), share(lambda c: "A" <= c <= "Z"), share(lambda c: "0" <= c <= "9"), share(lambda c: c == "!"), share(lambda c: c == "|"), share(lambda c: c in "#$%&*^~_=+<>@\\"), share(lambda c: c in ".,;:'\"()[]{}-/?"),
        len(set(words)) / k, np.log(1 + len(lines)), (len([x for x in lines if len(x) < 40]) / max(len(lines), 1)) ** 0.5, np.log((len(zlib.compress(b, 1)) / n if b else 1.0) + 0.02),
    ]


def test_statistics_match_their_definitions():
    texts = [None, "", " \n ", "One", "A line!\n\nand | another, 12 #x", "é中\U0001f600 UPPER" * 50, "x" * 100_000] + [r[1] for r in documents()]
    for t in texts:
        assert np.allclose(quality.statistics(None if t is None else t.encode()), slow_statistics(t))
