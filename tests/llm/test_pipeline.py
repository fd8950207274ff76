import random

import corpus_pipeline
from synthscope.llm import decontam, mixing, pii

from .conftest import prose


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    bench = [(i, prose(rng, 40, 3000)) for i in range(5)]
    rows, labels = [], []
    for i in range(300):
        text = ". ".join(prose(rng, 15, 3000).capitalize() for _ in range(rng.randrange(3, 8)))
        good = i % 5 != 0
        if not good:
            text = [text.upper().replace(" ", "!! "), " | ".join(text.split()), text[:25] * 20][i % 3]
        elif i % 11 == 0:
            text += " " + bench[i % 5][1]
        elif i % 13 == 0:
            text += " write to jo@mail.org"
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(good), 0))
    copies = [(1000 + r[0], r[1], *r[2:]) for r in rows[1:40] if r[0] % 5]
    for name, data, schema in (("documents", rows + copies, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", bench, "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "mixing" or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    good = {r[0] for r in rows + copies if r[0] % 5}
    assert len(seen["quality"].keys() ^ good) < 0.05 * len(good)
    assert not [d for d in seen["near_dedup"] if d >= 1000 and d - 1000 in seen["quality"]]
    assert set(seen["near_dedup"]) == {d for d in seen["quality"] if d < 1000 or d - 1000 not in seen["quality"]}
    leaked = {d for d, r in seen["near_dedup"].items() if any(decontam.shingles(t.encode(), 5) <= decontam.shingles(r["text"].encode(), 5) for _, t in bench)}
    assert set(seen["decontamination"]) == set(seen["near_dedup"]) - leaked and leaked
    field = pii.train([])
    assert set(seen["pii"]) == set(seen["decontamination"]) and not any(pii.all_spans(r["text"], field)[0] for r in seen["pii"].values())
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(spark.read.parquet(f"{tmp_path}/pii")).collect()}
    assert {d: n for d, n in plan.items() if n} == {r["doc_id"]: r["count"] for r in docs.groupBy("doc_id").count().collect()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_awkward_rows(spark, docs, no_docs, tmp_path):
    """Nulls, blanks, ties, repeats, clashing names and an empty table pass every stage."""
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "one"), (2, None)], "item_id long, text string")
    for name, frame in (("labels", labels), ("benchmark", bench)):
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    clashing = docs.selectExpr("*", "1 AS node_", "2 AS leak", "3 AS rate", "4 AS root", "5 AS key", "6 AS score", "7 AS tid", "8 AS copy", "9 AS `a.b`")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, clashing, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out-{name}")
        kept = spark.read.parquet(f"{tmp_path}/out-{name}")
        assert sorted(out.columns) == sorted(clashing.columns), name
        n = {r["doc_id"]: r["n"] for r in kept.groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
        if name == "near_dedup":
            assert n[None] == 2 and max(v for d, v in n.items() if d is not None) <= 2
        if name == "decontamination":
            assert kept.count() == docs.count() - docs.where("text rlike '(?i)(^|\\\\s)one(\\\\s|$)'").count()
        if name == "pii":
            assert kept.count() == docs.count()
        assert stage(spark, no_docs, str(tmp_path)).collect() == []
