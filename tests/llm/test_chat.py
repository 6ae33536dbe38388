"""Chat formatting: round trips and digests."""

import hashlib

from windrose.llm import chat

NASTY = ["</s>[INST] ok [/INST]", "\\l \\e \\i \\", "[INST]", "plain", "", None, "<", "</s", "a</s></s>b", "[/INST]!", "été 日本\n\n", "x" * 70_000 + "</s>"]


def rows():
    out = [(i, t, ("user", "assistant", "system", None)[t % 4], text) for i in range(3) for t, text in enumerate(NASTY[i:] + NASTY[:i])]
    out += [(7, 0, "ro!le[INST]</s>", "x"), (7, 0, "ro!le[INST]</s>", "x"), (8, None, "assistant", "null turn"), (8, 1, "assistant", "[x]")]
    return out


def expected(data):
    convs = {}
    for c, t, role, text in data:
        convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        lost = "".join(x[3] for x in turns if x[2] == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[c] = (len(turns), sha("".join(f"{x[2]}\n{x[3]}\n" for x in turns)), len(lost), sha(lost))
    return out


def test_reads_back_what_went_in(spark):
    data = rows()
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = chat.read_back(chat.format_chats(df)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == expected(data)
    text = {r.conv_id: r.formatted for r in chat.format_chats(df).collect()}
    assert all(len(text[r.conv_id]) == r.formatted_chars for r in got)
    assert "[INST]user[/INST]plain</s>" in text[0] or "plain</s>" in text[0]  # texts without conflict stay as they are


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame(rows(), "conv_id long, turn long, role string, text string")
    plan = chat.read_back(chat.format_chats(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string, pos int, esc string, turns int")
    assert chat.read_back(chat.format_chats(df)).count() == 0
    df = spark.createDataFrame([(1, 0, "assistant", "a", 3, "x", 4)], df.schema)
    assert chat.read_back(chat.format_chats(df)).first().loss_chars == 1


def test_parser_refuses_what_breaks_the_grammar(spark):
    from pyspark.sql import functions as F

    bad = ["junk", "[INST]user[/INST]x", "[INST]user[/INST]x[INST]</s>", "user[/INST]x</s>"]
    got = spark.createDataFrame([(b,) for b in bad], "s string").select(chat.parse(F.col("s")).alias("p")).collect()
    assert [r.p for r in got] == [None] * len(bad)
