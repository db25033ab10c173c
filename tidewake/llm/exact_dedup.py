"""Operator 1, exact dedup: 128-bit hash groups, bytes compared inside them. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm._shared import ascii_lower, small, written


def mark_exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    normalise: Callable[[Column], Column] = ascii_lower,
    digest: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` added.

    Texts are equal when their normalised bytes are; a null text counts as an
    empty one. Of equal texts the row with the largest id stays. Columns of
    ``docs`` that have one of the four names are replaced.

    * A null id is smaller than any other: such a row stays only if no row of
      its group has an id, and then ``keep_id`` is null.
    * Rows that repeat an id and a text are one document: all have the same marks.
    * An empty table gives an empty table.

    ``digest`` maps normalised text to its hash. Only hashes that occur twice
    are looked at again: their rows are grouped by hash and text, so bytes and
    not hashes decide, and equal texts are merged before the shuffle. A text
    that has no equal is never shuffled. What returns to the rows is one small
    row for each repeated text.
    """
    kept_columns = [F.col(c) for c in docs.columns if c not in ("keep_id", "group_size", "kept", "text_sha256")]
    rows = docs.select(
        F.struct(*kept_columns).alias("row"), F.col(id_col).alias("id"), normalise(F.coalesce(F.col(text_col), F.lit(""))).alias("norm")
    ).withColumn("h", digest(F.col("norm")))

    twice = written(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    texts = rows.select("id", "norm", "h").join(small(twice), "h", "left_semi").groupBy("h", "norm").agg(
        F.max("id").alias("keep"), F.count("*").alias("n")
    )
    by_hash = written(
        texts.groupBy("h").agg(F.count("*").alias("texts"), F.max("keep").alias("keep"), F.max("n").alias("n"))
    )
    # Usually all; a hash of several texts is a collision and is joined by the text itself.
    plain = written(by_hash.where("texts = 1 AND n > 1").select("h", "keep", "n"))
    collided = by_hash.where("texts > 1").select("h")
    if collided.isEmpty():
        marked = rows.join(small(plain), "h", "left")
    else:
        collided = small(written(collided))
        apart = written(texts.join(collided, "h", "left_semi"))
        marked = rows.join(collided, "h", "left_anti").join(small(plain), "h", "left").unionByName(
            rows.join(collided, "h", "left_semi").join(apart, ["h", "norm"], "left")
        )
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep"))
    out = marked.select(
        "row",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        keep.eqNullSafe(F.col("id")).alias("kept"),
        F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256"),
    )
    return out.select("row.*", *out.columns[1:])


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each different text, with the columns of ``docs``.

    Of rows that repeat an id and a text, any one stays.
    """
    own = docs.select(F.struct(*docs.columns).alias("all"), F.col(id_col).alias("of"), F.col(text_col).alias("with"))
    marked = mark_exact_duplicates(own, "of", "with").where("kept")
    alone = marked.where("group_size = 1")
    one = marked.where("group_size > 1").dropDuplicates(["text_sha256"])
    return alone.unionByName(one).select("all.*")
