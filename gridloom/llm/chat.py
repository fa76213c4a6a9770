"""Relational chat formatting: sorted turn structs become one marked string per conversation.

The template, for each run of adjacent turns of one role::

    <|turn|>ROLE<|text|>TEXT<|next|>TEXT<|end|>

Adjacent turns of one role share a header; ``<|next|>`` keeps their border, so the output can be read
back into the very turns that went in. All marks begin with ``<|``. Inside roles and texts a backslash is
doubled and ``<|`` becomes ``<\\|``, so no text can hold a mark and unescaping is exact. The loss mask is
all text of ``assistant`` runs, between ``<|text|>`` and ``<|end|>`` without ``<|next|>``.

Only Spark expressions are used. A conversation is one row of the result, so its turns meet in one
task by nature; nothing else does.

Cases: a null text is empty, a null role is the empty role. Turns are ordered by turn (null first), then
role, then text; repeated rows are turns of their own. A null conv_id is a conversation of its own. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed marks of the template.
TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted) from rows of conv_id, turn, role, text."""
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("turn"))
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    # Array aggregation: each turn adds what stands between its text and the text before it.
    at = lambda i, field: F.element_at("turns", i + 1)[field]
    border = lambda turn, i: F.when((i > 0) & (at(F.greatest(i - 1, F.lit(0)), "role") == turn["role"]), F.lit(NEXT)).otherwise(
        F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), F.lit(TURN), escape(turn["role"]), F.lit(TEXT))
    )
    pieces = F.transform("turns", lambda turn, i: F.concat(border(turn, i), escape(turn["text"])))
    return sorted_turns.select("conv_id", F.concat(F.array_join(pieces, ""), F.lit(END)).alias("formatted"))


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss_text, formatted_chars) parsed from the formatted strings alone."""
    literal = lambda mark: "\\Q" + mark + "\\E"
    body = F.expr(f"substring(formatted, {len(TURN) + 1}, length(formatted) - {len(TURN) + len(END)})")
    runs = F.split(body, literal(END + TURN))
    head = lambda run: F.element_at(F.split(run, literal(TEXT)), 1)
    tail = lambda run: F.element_at(F.split(run, literal(TEXT)), 2)
    texts = lambda run: F.transform(F.split(tail(run), literal(NEXT)), unescape)
    turns = F.flatten(F.transform(runs, lambda run: F.transform(texts(run), lambda x: F.struct(unescape(head(run)).alias("role"), x.alias("text")))))
    return chats.select("conv_id", turns.alias("turns"), F.length("formatted").cast("long").alias("formatted_chars")).select(
        "*", F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "").alias("loss_text")
    )


def chat_report(turns: DataFrame) -> DataFrame:
    """Counts and digests of the formatted conversations, taken from what is read back."""
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(format_chats(turns)).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )
