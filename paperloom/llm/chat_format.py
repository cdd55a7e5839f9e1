"""Operator 5: chat formatting with prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are its context, and only its reply is trainable.
As n turns would make text in proportion to the square of n, a conversation is written once, turn by turn, and an example
is a prefix of it: how many turns and characters it has and where its trainable characters are. expand_examples() writes the
prefixes out, where they are wanted.

A turn is `<s>[ROLE]text[/ROLE]\\n`; the text is escaped so that no marker can occur inside: `\\` is `\\\\`, `<` is `\\l`, `[` is
`\\b`, `]` is `\\e`. ROLE is the role, escaped likewise. Turns are formatted one by one; the offsets come from sums over the earlier turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The control strings of the template.
OPEN, ROLE_END, CLOSE, TURN_END = "<s>[", "]", "[/", "]\n"


def _escaped(column):
    out = F.coalesce(column.cast("string"), F.lit(""))
    for mark, code in (("\\", "\\\\"), ("<", "\\l"), ("[", "\\b"), ("]", "\\e")):
        out = F.replace(out, F.lit(mark), F.lit(code))
    return out


def unescape(text: str) -> str:
    """The inverse of the template's escapes."""
    if "\\" not in text:
        return text
    code = {"\\": "\\", "l": "<", "b": "[", "e": "]"}
    parts, k = [], 0
    while (at := text.find("\\", k)) >= 0:
        parts += [text[k:at], code[text[at + 1]]]
        k = at + 2
    return "".join([*parts, text[k:]])


def format_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each turn: conv_id, place (from 1), formatted, start (characters before it), loss_start, loss_end, trainable.

    The formatted conversation is the concatenation of its rows by place. Assistant turns are trainable: example e of a
    conversation is the prefix that ends with its e-th assistant turn, and characters loss_start to loss_end of it are its
    target. Turns are ordered by turn, ties by role and text, nulls first; a null role or text counts as empty; a null
    conversation is a conversation like any other; repeated rows are repeated turns; an empty table gives an empty result; ids
    are of any type; other columns, whatever their names, are ignored. A text is held whole in one task.
    """
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    role, text = _escaped(F.col("role")), _escaped(F.col("text"))
    head = F.concat(F.lit(OPEN), role, F.lit(ROLE_END))
    rows = rows.withColumns({"formatted": F.concat(head, text, F.lit(CLOSE), role, F.lit(TURN_END)), "__head": F.length(head), "__body": F.length(text)})
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    start = F.coalesce(F.sum(F.length("formatted").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.select("conv_id", F.row_number().over(order).alias("place"), "formatted", start.alias("start"), "__head", "__body", (F.coalesce("role", F.lit("")) == "assistant").alias("trainable"))
    loss = F.col("start") + F.col("__head")
    return rows.select("conv_id", "place", "formatted", "start", loss.alias("loss_start"), (loss + F.col("__body")).alias("loss_end"), "trainable")


def examples(turns: DataFrame) -> DataFrame:
    """The examples of format_turns(): conv_id, example (from 1), turns, chars (of the prefix), loss_start, loss_end."""
    own = turns.where("trainable")
    order = Window.partitionBy("conv_id").orderBy("place")
    return own.select("conv_id", F.row_number().over(order).alias("example"), F.col("place").alias("turns"), (F.col("start") + F.length("formatted")).alias("chars"), "loss_start", "loss_end")


def expand_examples(turns: DataFrame) -> DataFrame:
    """conv_id, example, text, loss_start, loss_end: the prefixes written out. The text grows as the square of the turns."""
    prefix = turns.select(F.col("conv_id").alias("__conv"), "place", "formatted")
    joined = examples(turns).join(prefix, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("place") <= F.col("turns")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "formatted"))), lambda x: x["formatted"]), "")
    return joined.groupBy("conv_id", "example", "loss_start", "loss_end").agg(text.alias("text"))


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    role, _, rest = formatted.removeprefix(OPEN).partition(ROLE_END)
    return unescape(role), unescape(rest[: rest.rindex(CLOSE)])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose turns arrive in order, each before the example that it closes; only the open
    conversation's hash states and last turn are kept. What is trainable is read from the examples alone."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples", "example_chars"]
    begun, open_, last, done = False, None, ("", 0), []
    for batch in batches:
        for conv, formatted, start, chars, loss_start, loss_end in zip(*[batch.column(k).to_pylist() for k in range(6)], strict=True):
            if not begun or conv != open_[0]:
                if begun:
                    done.append(open_)
                begun, open_ = True, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            if formatted is None:  # an example: its target is in the last turn of its prefix
                target = unescape(last[0][loss_start - last[1] : loss_end - last[1]])
                open_[3] += len(target)
                open_[4].update(target.encode())
                open_[6] += 1
                open_[7] += chars
                continue
            role, text = read_turn(formatted)
            last = formatted, start
            open_[1] += 1
            open_[2].update(f"{role}\n{text}\n".encode())
            open_[5] += len(formatted)
        if done:
            yield _digests(done, names)
            done = []
    if begun:
        yield _digests([open_], names)


def _digests(rows: list, names: list) -> pa.RecordBatch:
    columns = list(zip(*[(a, b, c.hexdigest(), d, e.hexdigest(), f, g, h) for a, b, c, d, e, f, g, h in rows], strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if "sha256" in n else pa.int64()) for c, n in zip(columns, names, strict=True)], names=names)


def op5_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """The digests of each conversation, read back from its written turns and from the examples that they expand to.

    formatted_chars counts the conversation as it is written, once; n_examples its examples, and example_chars the characters of
    all their prefixes, written out.
    """
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    turns = format_turns(rows.unionByName(extra))
    none = F.lit(None).cast("long")
    written = turns.select("conv_id", "place", F.lit(0).alias("kind"), "formatted", "start", none.alias("chars"), none.alias("loss_start"), none.alias("loss_end"))
    expanded = examples(turns).select("conv_id", F.col("turns").alias("place"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("formatted"), none.alias("start"), "chars", "loss_start", "loss_end")
    ordered = written.unionByName(expanded).repartition("conv_id").sortWithinPartitions("conv_id", "place", "kind")
    out = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, example_chars long"
    return ordered.select("conv_id", "formatted", "start", "chars", "loss_start", "loss_end").mapInArrow(_digest, out)
