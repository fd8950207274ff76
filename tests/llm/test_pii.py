import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from synthscope.llm import pii

from .conftest import documents

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def slow(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 2 and not (14 <= len(digits) <= 19 and pii.luhn(digits)) or k == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


PIECES = ["a", "é", "@", ".", "-", "+", " ", "%", "(", ")", "1", "25", "256", "00", "4111111111111111", "a@b.c", "+1 (212) 555-0100", "10.0.0.1", "\n"]


@settings(max_examples=500)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_base_spans_match_the_patterns(text):
    assert pii.base_spans(text) == slow(text)


@pytest.fixture(scope="module")
def field():
    return pii.train([])


@pytest.mark.parametrize(("text", "kind"), [("call (212) 555-0100 now", "phone"), ("card 9807915762804490 here", "card"), ("paid with 5500 1234 5678 9012, ok", "card"), ("write to jo@mail.org soon", "email"), ("from 10.20.30.40.", "ip")])
def test_field_finds(field, text, kind):
    (s, k, e) = pii.all_spans(text, field)[1][0]
    assert pii.KINDS[k] == kind and text[s:e].strip(" .,") == text[s:e]


@pytest.mark.parametrize("text", ["Licensed under CC BY-NC 4.0.", "version 3.", 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"', "in 1999 there were 12 of 15,300", "plain words only", "", "@ @@"])
def test_field_leaves_alone(field, text):
    assert pii.all_spans(text, field) == ([], [])


def test_best_labelling_is_the_best_of_all(field):
    text = "a1 +1 (212) 555-0100 4111111111111111 7"
    window = pii.windows(text)[0]
    lattice = field.lattice(text, window)
    scores, n = field._scores(lattice), len(window)

    def every(at, before, total, path):
        if at == n:
            yield total, path
            return
        for j in range(at + 1, min(n, at + pii.LONGEST) + 1):
            for y in range(len(pii.KINDS) + 1):
                if scores[at, j][y] > -1e300:
                    yield from every(j, y, total + field.pairs[before, y] + scores[at, j][y], [*path, (at, j, y)] if y else path)

    assert max(every(0, 0, 0.0, []))[1] == field.best(lattice, n)


def test_long_texts_take_linear_time(field):
    for text in ("a" * 300_000, "1" * 200_000, "a." * 100_000, "+1" * 100_000, "@" * 50_000, "1 " * 20_000, "1." * 100_000):
        pii.base_spans(text)
    assert pii.all_spans("x9 " * 5_000, field)[0] == []


def test_many_spans_take_linear_time(field):
    """Base spans and the field's are merged in one pass: eight times the addresses cost about eight times as much."""
    times = []
    for n in (1_000, 8_000):
        text = "jo@mail.org and " * n
        began = time.process_time()
        base, every = pii.all_spans(text, field)
        times.append(time.process_time() - began)
        assert len(base) == len(every) == n
    assert times[1] < 24 * times[0]


def test_merged_spans_touch_no_base_span(field):
    text = "mail jo@mail.org, (212) 555-0100 or 5500 1234 5678 9012 and 4111111111111111 at 10.0.0.1 " * 5
    base, every = pii.all_spans(text, field)
    assert every == sorted([*base, *[m for m in field.spans(text) if not any(m[0] < e and s < m[2] for s, _, e in base)]])
    assert len(every) > len(base) > 0


def test_rows(spark, docs, no_docs):
    rows = [(1, "mail jo@mail.org, or +1 (212) 555-0100 or 4111111111111111 at 10.0.0.1"), (2, None), (3, ""), (None, "é\U0001f600 jo@x.yz"), (1, "mail jo@mail.org")]
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    one = next(r for r in got if r["n_phone"])
    spans = slow(rows[0][1])
    spelled = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
    assert (one["n_email"], one["n_ip"], one["n_card"], one["n_phone"]) == (1, 1, 1, 1) and one["base_sha256"] == hashlib.sha256(spelled.encode()).hexdigest() and one["spans"] == spelled
    assert next(r for r in got if r["doc_id"] is None)["spans"] == "email:3:10"
    assert len(pii.find_pii(docs).collect()) == len(documents()) and pii.find_pii(no_docs).collect() == []


def test_redaction(spark):
    frame = spark.createDataFrame([(1, "mail jo@mail.org now", 20, "x"), (2, None, None, "y"), (3, "clean", 5, "z")], "doc_id long, text string, n_chars int, spans string")
    out = {r["doc_id"]: r for r in pii.redact_pii(frame).collect()}
    assert pii.redact_pii(frame).columns == frame.columns
    assert out[1]["text"] == "mail [EMAIL] now" and out[1]["n_chars"] == 16 and out[2]["text"] is None and out[3]["text"] == "clean"
