import hashlib
from collections import defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from synthscope.llm import chat

ROWS = [
    (1, 1, "assistant", "fine </s> \\ [INST]"), (1, 0, "user", "hi"), (2, 0, "user", None), (2, 1, "assistant", ""), (3, 0, "assistant", "first"), (3, 0, "assistant", "first"),
    (4, 0, None, "no role"), (4, 1, "tool <</ROLE>>", "x\\0;y"), (None, 0, "user", "lost"), (None, None, "assistant", "found"), (5, 0, "system", "s"), (5, 1, "user", "u"), (5, 2, "assistant", "a" * 100_000),
]


def test_digests(spark):
    frame = spark.createDataFrame([(*r, "x", 1, True) for r in ROWS], "conv_id long, turn long, role string, text string, part string, turn_no int, loss boolean").repartition(3)
    got = {r["conv_id"]: r for r in chat.chat_digests(chat.format_chats(frame)).collect()}
    turns = defaultdict(list)
    for c, t, r, x in ROWS:
        turns[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(turns)
    for c, rows in turns.items():
        rows.sort()
        loss = "".join(x for _, r, x in rows if r == "assistant")
        want = (len(rows), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in rows).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert tuple(got[c])[1:5] == want
        assert got[c]["formatted_chars"] >= sum(len(x) for _, _, x in rows)
    assert [c for c in got if got[c]["valid"]] and got[1]["valid"] and got[5]["valid"] and not got[3]["valid"] and not got[4]["valid"]


def test_empty(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(frame).collect() == [] and chat.chat_digests(chat.format_chats(frame)).collect() == []


@given(st.lists(st.sampled_from([*chat.TEMPLATE.controls, "\\", "0;", "[", "</", "a", "S>"]), max_size=12).map("".join), st.sampled_from(["user", "assistant", "tool", "", "<<ROLE>>"]))
def test_escape_is_reversible_and_hides_controls(text, role):
    f = chat.Formatter()
    assert not any(c in f.escape(text) for c in f.controls)
    whole = "".join(x for x, _ in f.segments(role, text))
    assert f.read(whole + "<s>next</s>") == (role, text, len(whole)) and all(f.read(whole[:k]) is None for k in range(len(whole)))


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "<</TURN>>"]), st.lists(st.sampled_from([*chat.TEMPLATE.controls, "<", " ", "[", "\\"]), max_size=6).map("".join)), max_size=6))
def test_turns_are_found_in_the_formatted_text(turns):
    f = chat.Formatter()
    whole, got = "".join(x for t in turns for x, _ in f.segments(*t)), []
    while whole:
        role, text, end = f.read(whole)
        got.append((role, text))
        whole = whole[end:]
    assert got == turns


@pytest.mark.parametrize(("roles", "valid"), [(["user", "assistant"], True), (["system", "user", "assistant", "user", "assistant"], True), (["user"], False), (["user", "user"], False), (["assistant"], False)])
def test_machine(roles, valid):
    f, state = chat.Formatter(), "start"
    for r in roles:
        state = f.step(state, r)
    assert (state in f.t.final) is valid
