import random

from pyspark.sql import functions as F

from synthscope.llm import decontam

from .conftest import SCHEMA, prose


def slow(docs, items, n=5, t=0.8):
    out = set()
    for d, text in docs:
        words = (text or "").lower().split()
        for i, item in items:
            test = (item or "").lower().split()
            k = min(n, len(test))
            runs = lambda w: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if k else set()  # noqa: B023, E731
            own, held = runs(test), runs(words)
            shared = len(own & held)
            if i is not None and own and shared >= t * len(own) - 1e-9:
                out.add((d, i, shared, len(own)))
    return out


def cases():
    rng = random.Random(2)
    items = [(i, prose(rng, 10 + 3 * i)) for i in range(20)] + [(50, "only three words"), (51, None), (52, ""), (None, "no number at all here now"), (53, prose(rng, 6)), (54, "a a a a a a a a"), (55, "Name the capital city"), (56, "unheardof")]
    docs = []
    for k in range(120):
        words = prose(rng, rng.randrange(0, 200)).split()
        item = (items[k % 20][1]).split()
        for _ in range(k % 5):
            item[rng.randrange(len(item))] = "swapped"
        at = rng.randrange(len(words) + 1)
        docs.append((k, " ".join(words[:at] + item + words[at:]).upper() if k % 9 == 0 else "\n".join([" ".join(words[:at]), "\t ".join(item), " ".join(words[at:])])))
    return docs + [(200, "only three words"), (201, "only three words more"), (202, None), (203, ""), (None, items[3][1]), (204, items[4][1]), (204, items[4][1]), (205, "a " * 9), (206, "please name the capital city of france"), (207, "an unheardof word"), (208, "name the\tcapital\ncity"), (None, "a clean text without a number"), (209, "w " * 9)], items


def test_matches_brute_force(spark):
    docs, items = cases()
    d = spark.createDataFrame([(*x, "s", 1) for x in docs], "doc_id long, text string, source string, item_id long").withColumn("__leak", F.lit(1)).withColumn("leak", F.lit(1)).repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = slow(docs, items)
    got = decontam.find_leaks(d, b).collect()
    assert {tuple(r)[:4] for r in got} == want and len(got) == len(want)
    kept = decontam.decontaminate(d, b)
    assert kept.columns == d.columns
    clean = [x for x in docs if not slow([x], items)]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(clean, key=str)


def test_empty(spark, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert decontam.find_leaks(no_docs, some).collect() == []
    full = spark.createDataFrame([(1, "x y")], "doc_id long, text string")
    assert decontam.find_leaks(full, none).collect() == [] and decontam.decontaminate(full, none).count() == 1
    assert decontam.decontaminate(spark.createDataFrame([], SCHEMA), none).collect() == []


def test_many_items_cost_one_scan_of_the_documents(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, 12, 5000)) for i in range(9000)]
    docs = [(i, f"{prose(rng, 50, 5000)} {items[i * 7][1]} {prose(rng, 50, 5000)}") for i in range(300)]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), b)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(i, i * 7) for i in range(300)}


def test_long_text(spark):
    rng = random.Random(7)
    text = " ".join(f"w{i % 70001}" for i in range(700_000))  # about 5 MB
    item = prose(rng, 30)
    got = decontam.find_leaks(spark.createDataFrame([(1, f"{text} {item} {text}"), (2, text)], "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert [tuple(r)[:2] for r in got] == [(1, 5)]
