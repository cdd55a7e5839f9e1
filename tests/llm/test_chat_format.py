import hashlib

from helpers import stored_tables

from paperloom.llm import chat_format as D

SCHEMA = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 1, "assistant", "b]\\l <s>[/assistant]\n"), (1, 0, "user", "a\\[<x"), (1, 2, "assistant", None), (2, 0, None, "ä"), (3, 0, "user", ""), (3, 0, "user", ""),
    (3, 0, "assistant", "tie"), (None, 0, "assistant", "none"), (4, None, "system", "first"), (4, 5, "assistant", "</s>[INST]"), (4, 5, "assistant", "</s>[INST]"),
]


def brute(rows):
    out = []
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        chars = [9 + sum(len(x or "") + sum((x or "").count(m) for m in "\\<[]") for x in (r[2], r[2], r[3])) for r in own]
        prefixes = [sum(chars[: k + 1]) for k, r in enumerate(own) if r[2] == "assistant"]
        out.append((c, len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(chars), len(prefixes), sum(prefixes)))
    return sorted(out, key=str)


def test_query_against_brute_force(spark, tmp_path):
    d = stored_tables(spark, tmp_path, conversations=(ROWS, SCHEMA))
    odd = "</s>[INST] ok [/INST]"
    got = D.op5_chat_formatting(spark, d).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute([*ROWS, (-1, 0, "user", odd), (-1, 1, "assistant", odd)])
    assert all(r.formatted_chars > r.loss_chars for r in got)


def test_examples_are_prefixes_with_one_trainable_reply(spark):
    turns = D.format_turns(spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 AS place", "'x' AS formatted"))
    texts = {(r.conv_id, r.example): r for r in D.expand_examples(turns).collect()}
    assert {k for k in texts if k[0] == 1} == {(1, 1), (1, 2)}
    assert texts[1, 2].text.startswith(texts[1, 1].text)
    one = texts[1, 1]
    assert D.unescape(one.text[one.loss_start : one.loss_end]) == ROWS[0][3]
    assert len(texts[4, 2].text) == [r.chars for r in D.examples(turns).where("conv_id = 4 AND example = 2").collect()][0]


def test_no_marker_inside_texts(spark):
    for r in D.format_turns(spark.createDataFrame(ROWS, SCHEMA)).collect():
        assert r.formatted.count("<s>[") == 1 and r.formatted.count("[/") == 1
    assert D.format_turns(spark.createDataFrame([], SCHEMA)).count() == 0


def test_each_assistant_turn_is_trained_once(spark):
    """Every assistant turn is the target of one example, in whose context all turns before it are; a long text is one target."""
    rows = [(1, k, "assistant" if k % 2 else "user", f"<s>[{k}]" + "x" * (300_000 if k == 5 else 1)) for k in range(8)]
    turns = D.format_turns(spark.createDataFrame(rows, SCHEMA))
    texts = [r.formatted for r in turns.orderBy("place").collect()]
    found = D.expand_examples(turns).orderBy("example").collect()
    assert [D.unescape(r.text[r.loss_start : r.loss_end]) for r in found] == [r[3] for r in rows if r[2] == "assistant"]
    assert [r.text for r in found] == ["".join(texts[:k]) for k in (2, 4, 6, 8)]
