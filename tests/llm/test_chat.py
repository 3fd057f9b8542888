import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tallywatch.llm import chat

PARTS = st.lists(st.sampled_from(["<", "[", "\\", "s>", "/s>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[TEXT]", "SYS>>", "TEXT]", "a"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(PARTS)
def test_escape_is_reversible_and_leaves_no_control_string(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text
    assert not any(c in safe for c in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[TEXT]"))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(PARTS, PARTS), max_size=5))
def test_parse_reads_back(turns):
    text = "".join(chat.OPEN + chat.escape(r) + chat.MIDDLE + chat.escape(t) + chat.CLOSE for r, t in turns)
    assert chat.parse(text) == turns


def test_examples(spark):
    rows = [(1, 0, "user", "hi", "x"), (1, 1, "assistant", "<s>yes", "x"), (1, 2, "user", None, "x"), (1, 3, "assistant", "no", "x"), (1, 4, None, "bye", "x"),
            (2, 0, "user", "alone", "x"), (3, 1, "assistant", "b", "x"), (3, 1, "assistant", "a", "x"), (3, 1, "assistant", "a", "x"), (None, 0, "user", "n", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, example string")
    made = chat.written(turns)
    one = sorted((r for r in made.collect() if r.conv_id == 1), key=lambda r: r.example)
    assert [r.formatted[r.loss_start : r.loss_end] for r in one] == [chat.escape("<s>yes"), "no", ""]
    assert one[1].formatted.startswith(one[0].formatted) and one[2].formatted.startswith(one[1].formatted)
    assert [r.last for r in one] == [False, False, True]
    got = {r.conv_id: r for r in chat.read_conversations(made).collect()}
    assert len(got) == 4 and got[1].n_turns == 5 and got[1].loss_chars == 8
    assert got[1].loss_sha256 == hashlib.sha256(b"<s>yesno").hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nhi\nassistant\n<s>yes\nuser\n\nassistant\nno\n\nbye\n").hexdigest()
    assert got[2].loss_chars == 0 and got[2].loss_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[3].loss_sha256 == hashlib.sha256(b"aab").hexdigest() and got[None].n_turns == 1
    assert chat.read_conversations(chat.written(turns.limit(0))).count() == 0
