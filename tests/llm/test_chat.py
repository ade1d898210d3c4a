import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import chat
from folioscope.llm.queries import op10_chat

T = chat.INSTRUCT
PIECES = st.sampled_from([*T.marks, "\\", "[", "<", "]", "/", "[\\INST]", "a", "é", "\n", " ", "|"])
TEXT = st.lists(PIECES, max_size=6).map("".join)
TURNS = st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), TEXT), TEXT), max_size=5)


@settings(max_examples=400, deadline=None)
@given(TURNS)
def test_round_trip(turns):
    text, segments, _ = T.write(turns)
    assert T.read(text) == turns
    assert [s[:2] for s in segments] == list(zip([0, *[s[1] for s in segments]], [s[1] for s in segments]))
    assert "".join(T.show(text[a:b]) for a, b, loss in segments if loss) == "".join(t for r, t in turns if r == "assistant")


def test_order_of_turns():
    problem = lambda *roles: T.write([(r, "x") for r in roles])[2]
    assert problem("user", "assistant") is None and problem("system", "user", "assistant", "user", "assistant") is None
    assert problem("assistant") == "turn 0: assistant after the start"
    assert problem("user", "user") == "turn 1: user after user"
    assert problem("user") == "ends after user" and problem() == "ends after the start"


def test_overlapping_marks_are_refused():
    with pytest.raises(ValueError):
        chat.Template(turns={"user": chat.Turn("<u>", ">x")}, order={}, last=())


def digests(turns):
    learned = "".join(t for r, t in turns if r == "assistant")
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()


def told(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_conversations(spark, small):
    want = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{small}/conversations.parquet").orderBy("conv_id", "turn").collect():
        want.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    assert told(op10_chat(spark, small)) == {k: digests(v) for k, v in want.items()}


def test_odd_tables(spark):
    rows = [(1, 2, "assistant", "b", 0), (1, 1, "user", None, 0), (1, 1, "user", None, 0), (2, None, None, "x", 0), (None, 0, "user", "y" * 100_000, 0), (3, 0, "tool", "[/INST]", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    made = chat.format_chats(df)
    assert told(chat.read_back(made)) == {
        1: digests([("user", ""), ("user", ""), ("assistant", "b")]), 2: digests([("", "x")]),
        None: digests([("user", "y" * 100_000)]), 3: digests([("tool", "[/INST]")]),
    }
    assert {r.conv_id: r.problem for r in made.collect()}[1] == "turn 1: user after user"
    assert chat.format_chats(df.limit(0)).count() == 0
