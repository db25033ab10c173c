"""Operator 4, chat formatting: every assistant turn becomes an example of its own. DataFrame functions only.

A turn is ``<|turn|>role<|body|>text<|end|>``. In roles and texts a backslash
is doubled and one is put behind the first character of every control string,
so that no control string of this or of a common other template is left in
them, and dropping each backslash that stands before a character restores them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Strings that templates give a meaning; "<|" opens those of this one.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_AT_CONTROL = "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROL)


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _AT_CONTROL, r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_examples(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    *,
    trained_role: str = "assistant",
) -> DataFrame:
    """One row per example: ``(conv_id, example, formatted, loss_start, loss_end, target_turn)``.

    Each turn of ``trained_role`` gives an example: all turns before it as
    context, then that turn. Only its text, from ``loss_start`` up to
    ``loss_end`` (in code points of ``formatted``), is trained on. A
    conversation whose last turn is another's ends with one more example that
    holds all turns and trains on nothing (its bounds are equal), so that no
    turn is lost; ``target_turn`` is null there.

    Turns are ordered by turn number, nulls first; of equal numbers by role,
    then text. Null roles and texts are empty strings; a null conversation id
    is a conversation like others; repeated rows are turns of their own; an
    empty table gives none. A conversation must fit in a row, as its examples do.
    """
    one = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    gathered = turns.select(F.col(conv_col).alias("conv_id"), one.alias("t")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("t")).alias("turns")
    )
    parts = gathered.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.struct(
                t["turn"].alias("turn"),
                (t["role"] == trained_role).alias("trained"),
                F.concat(F.lit(TURN), escape(t["role"]), F.lit(BODY)).alias("head"),
                escape(t["text"]).alias("body"),
            ),
        ).alias("parts"),
    )
    with_last = F.transform(
        "parts",
        lambda p, i: F.when(p["trained"] | (i == F.size("parts") - 1), i),
    )
    examples = parts.select(
        "conv_id", "parts", F.posexplode(F.array_compact(with_last)).alias("example", "upto")
    ).withColumn("last", F.get("parts", F.col("upto")))
    whole = F.transform(F.slice("parts", F.lit(1), F.col("upto") + 1), lambda p: F.concat(p["head"], p["body"], F.lit(END)))
    stop = F.char_length("formatted") - len(END)
    return examples.withColumn("formatted", F.array_join(whole, "")).select(
        "conv_id",
        "example",
        "formatted",
        F.when(F.col("last.trained"), stop - F.char_length("last.body")).otherwise(stop).alias("loss_start"),
        stop.alias("loss_end"),
        F.when(F.col("last.trained"), F.col("last.turn")).alias("target_turn"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Digest of each conversation, parsed from the examples alone; groups as ``format_examples`` dealt them."""
    loss = unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    held = examples.select(
        "conv_id", "formatted", F.col("example").alias("i"), F.struct("example", loss.alias("loss")).alias("trained")
    ).groupBy("conv_id").agg(
        F.max_by("formatted", "i").alias("last"),
        F.sort_array(F.collect_list("trained")).alias("trained"),
        F.sum(F.char_length("formatted")).alias("formatted_chars"),
    )
    marked = F.slice(F.split("last", re.escape(TURN), -1), 2, F.size(F.split("last", re.escape(TURN), -1)))

    def turn(s: Column) -> Column:
        pair = F.split(s, re.escape(BODY), -1)
        body = F.get(pair, F.lit(1))
        text = F.substring(body, F.lit(1), F.char_length(body) - len(END))
        return F.concat(unescape(F.get(pair, F.lit(0))), F.lit("\n"), unescape(text), F.lit("\n"))

    text = F.array_join(F.transform("trained", lambda t: t["loss"]), "")
    return held.select("conv_id", "formatted_chars", F.transform(marked, turn).alias("turns"), text.alias("loss")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(F.array_join("turns", ""), "UTF-8"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
