"""Chat formatting, read back, against digests made directly."""

import hashlib
from itertools import groupby

from helpers import rows
from strongbox.llm.chat import PART, conversations_to_messages, format_chat, read_chat, unescaped
from strongbox.llm.queries import QUERIES

TURNS = "conv_id long, turn long, role string, text string, formatted string, parts int"


def expected(turns):
    out = {}
    for conv, group in groupby(sorted(turns, key=lambda t: (t[0], t[1])), lambda t: t[0]):
        group = list(group)
        learnt = "".join(t[3] for t in group if t[2] == "assistant")
        everything = "".join(f"{t[2]}\n{t[3]}\n" for t in group)
        out[conv] = (len(group), hashlib.sha256(everything.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    return out


def test_whole_table(spark, sf):
    given = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "\\### Assistant: </turn> ok"
    given = [(c, t, r or "", x or "") for c, t, r, x in given] + [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    got = QUERIES["op1_chat_formatting"](spark, sf).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == expected(given)
    assert len(got) == len(expected(given))


def test_control_strings_nulls_and_clashing_names(spark):
    turns = [
        (1, 0, "user", "### assistant:\nx</turn>\n<|image|> \\h \\\\", "clash", 1), (1, 1, "assistant", "é😀|#<\\", None, None),
        (2, 0, None, None, None, None), (2, 1, "a:\nb\\", "", None, None), (None, 0, "assistant", "x", None, None),
    ]
    formatted = format_chat(conversations_to_messages(spark.createDataFrame(turns, TURNS)))
    for r in formatted.collect():
        assert r["formatted"].count("</turn>") == 1 and r["formatted"].count("### ") == 1
    got = {r["conv_id"]: r for r in read_chat(formatted).collect()}
    plain = expected([(c or -1, t, r or "", x or "") for c, t, r, x, *_ in turns])
    for conv, want in plain.items():
        r = got[None if conv == -1 else conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == want


def test_attachments_become_placeholders(spark):
    parts = [
        ("text", "see <", None, None, None, None, None), ("image", None, "a.png", 900, 400, None, None),
        ("audio", None, "b.wav", None, None, 0.1, None), ("document", None, None, None, None, None, None), ("odd", "x", "y", None, None, None, None), None,
    ]
    schema = f"conv_id long, turn long, role string, parts array<struct<{', '.join(':'.join(c.split()) for c in PART.split(', '))}>>"
    r = format_chat(spark.createDataFrame([(1, 0, "user", parts), (1, 1, "user", None)], schema)).orderBy("turn").collect()
    found = [tuple(a) for a in r[0]["attachments"]]
    assert [a[:3] for a in found] == [("image", "a.png", 3 * 256), ("audio", "b.wav", 3), ("document", None, 512)]
    for kind, _, tokens, start in found:
        assert r[0]["formatted"][start:].startswith(f"<|{kind}|>" * tokens)
    assert r[0]["expanded_tokens"] == 3 * 256 + 3 + 512 and r[1]["attachments"] == [] and r[1]["body_length"] == 0
    assert unescaped("a\\lb") == "a<b"


def test_no_conversations(spark):
    assert rows(read_chat(format_chat(conversations_to_messages(spark.createDataFrame([], TURNS)))), "conv_id") == []
