"""Chat formatting with DataFrame expressions only.

Method: relational formatting. The turns of a conversation are collected as
structs and sorted, adjacent turns of one role are merged into one block with
array functions, and the blocks are concatenated.

Template, with ``{role}`` and ``{text}`` escaped::

    <|im_start|>{role}\\n{text}[<|im_sep|>{text}...]<|im_end|>\\n   (per block)

``<|im_sep|>`` stands between the texts of turns that were merged, so that the
original turns can be read back. Escaping puts one backslash behind the "<" of
every ``<\\...\\|`` in a text, so no text can hold a control string; unescaping
takes one away. Roles are further percent-escaped for "%" and line feed.

Defined results: a null text or role is empty; turns sort by (turn, role, text)
with null turns first; repeated rows are turns of their own; rows with a null
conv_id form one conversation; an empty table gives no rows; other input columns
are ignored. One conversation becomes one row: its turns meet in one task, as
the output string itself does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, SEP = "<|im_start|>", "<|im_end|>", "<|im_sep|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_chats(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans.

    loss_spans: array of (start, end) in code points of `formatted`, one for each
    text of `trained_role`, in order; control strings are never inside.
    """
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    # Merge: a block starts where the role differs from the turn before.
    last = F.size("ts") - 1
    chats = chats.withColumn(
        "starts",
        F.filter(
            F.sequence(F.lit(0), last),
            lambda i: (i == 0) | (F.col("ts")[i]["role"] != F.col("ts")[F.greatest(i - 1, F.lit(0))]["role"]),
        ),
    )
    blocks = F.transform(
        "starts",
        lambda s, k: F.struct(
            F.col("ts")[s]["role"].alias("role"),
            F.concat(F.lit(START), _escape_role(F.col("ts")[s]["role"]), F.lit("\n")).alias("head"),
            F.transform(
                F.slice(
                    "ts",
                    s + 1,
                    F.when(k + 1 < F.size("starts"), F.col("starts")[F.least(k + 1, F.size("starts") - 1)]).otherwise(F.size("ts")) - s,
                ),
                lambda t: escape(t["text"]),
            ).alias("texts"),
        ),
    )
    chats = chats.select("conv_id", blocks.alias("blocks"))
    # Pieces in order: (piece, whether it is trained on). Their lengths give the spans.
    pieces = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.concat(
                F.array(F.struct(b["head"].alias("s"), F.lit(False).alias("on"))),
                F.flatten(
                    F.transform(
                        b["texts"],
                        lambda x, i: F.array(
                            F.struct(F.when(i == 0, F.lit("")).otherwise(F.lit(SEP)).alias("s"), F.lit(False).alias("on")),
                            F.struct(x.alias("s"), (b["role"] == F.lit(trained_role)).alias("on")),
                        ),
                    )
                ),
                F.array(F.struct(F.lit(END + "\n").alias("s"), F.lit(False).alias("on"))),
            ),
        )
    )
    chats = chats.select("conv_id", pieces.alias("pieces"))
    span = "struct<start:bigint,end:bigint>"
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{span}>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["s"])).cast("bigint").alias("at"),
            F.when(
                p["on"],
                F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(p["s"])).cast("bigint").alias("end")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return chats.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"),
        spans["spans"].alias("loss_spans"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """Parse `formatted` again: conv_id, turns (array of role, text), loss_text, formatted."""
    block = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda b: b != "")
    turns = F.flatten(
        F.transform(
            block,
            lambda b: F.transform(
                F.split(F.substring(b, F.position(F.lit("\n"), b) + 1, F.length(b)), r"<\|im_sep\|>"),
                lambda x: F.struct(
                    _unescape_role(F.substring(b, F.lit(len(START) + 1), F.position(F.lit("\n"), b) - len(START) - 1)).alias("role"),
                    unescape(x).alias("text"),
                ),
            ),
        )
    )
    loss = F.array_join(
        F.transform(
            "loss_spans",
            lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))),
        ),
        "",
    )
    return chats.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), "formatted")


def chat_digests(turns: DataFrame) -> DataFrame:
    """The digest columns of op8, all read back from the formatted output."""
    back = read_back(format_chats(turns))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
