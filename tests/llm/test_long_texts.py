"""Texts of 5 MB, read whole: what stands at their ends counts."""

import hashlib
import random

import pytest

from synthscope.llm import chat, licenses, quality, simhash, urls


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(2)
    return " ".join(f"w{rng.randrange(50_000)}" for _ in range(750_000))


def test_simhash(spark, long_text):
    frame = spark.createDataFrame([(1, long_text), (2, long_text + " x"), (3, "short")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in simhash.simhash_components(frame).collect()}
    assert got[2]["component_id"] == 1 and got[3]["component_id"] == 3
    assert got[1]["fingerprint"] == f"{simhash.fingerprint(long_text.encode()) % 2**64:016x}"


def test_urls(spark, long_text):
    page = f"<p>{long_text}</p><a href='http://liked.org/x'>x</a>"
    frame = spark.createDataFrame([(1, "http://org/fr/", page), (2, "http://a.com/" + "p" * 5_000_000 + "?q", None)], "page_id long, url string, html string")
    assert [(r["src"], r["dst"]) for r in urls.host_links(frame.selectExpr("*", "'org' AS host")).collect() if r["src"] == "org"] == [("org", "liked.org")]
    got = {r["page_id"]: r for r in urls.judge_urls(frame).collect()}
    assert len(got[2]["path"]) == 5_000_001 and (got[1]["verdict"], got[2]["verdict"]) == ("allow", "allow")


def test_licenses(spark, long_text):
    lines = "\n".join(long_text[i : i + 80] for i in range(0, len(long_text), 80))
    name, (notice, *_) = sorted(licenses.TEMPLATES.items())[0]
    found = licenses.scan_licenses(spark.createDataFrame([(1, f"{lines}\n{notice}")], "doc_id long, text string")).collect()
    assert [(r["start_word"], r["license"]) for r in found] == [(len(licenses.normal_words(lines)), name)]


def test_chat(spark, long_text):
    frame = spark.createDataFrame([(1, 0, "user", long_text), (1, 1, "assistant", long_text + "</s>")], "conv_id long, turn long, role string, text string")
    row = chat.chat_digests(chat.format_chats(frame)).first()
    assert row["loss_sha256"] == hashlib.sha256(f"{long_text}</s>".encode()).hexdigest() and row["n_turns"] == 2 and row["valid"]


def test_quality(spark, long_text):
    docs = spark.createDataFrame([(i, "Fine words. " * 20 if i % 2 else "## || " * 30) for i in range(60)] + [(100, long_text)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, labels).collect()}
    assert len(got) == 61 and 0 <= got[100] <= 1
