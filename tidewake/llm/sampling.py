"""Bounded samples of labelled rows, to fit classifiers on."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm._shared import small, written

#: Texts with more bytes are not fitted on (they are still scored).
MAX_TEXT_BYTES = 1_000_000
#: A sample has at most about this many times the rows that were asked for.
MOST_TIMES = 2


def held_out(id_col: str, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % modulus == remainder, F.lit(False))


def labelled_sample(labels: DataFrame, docs: DataFrame | None, per_class: int) -> tuple[pa.Table, dict]:
    """Some ``per_class`` rows of each label with their texts, ordered by id, and the numbers of all rows by label.

    ``labels`` has ``(id, label)``, with ``text`` too if ``docs``, of ``(id, text)``, is None.
    A row is in the sample if a hash of its id is below the class's share, so
    the sample doesn't depend on partitions. Rows that repeat an id, a label and
    a text are in it once. If many texts of one id make it more than
    ``MOST_TIMES`` what was asked for, a hash of the texts thins it, so what
    reaches the driver is bounded by the number of classes, ``per_class`` and
    ``MAX_TEXT_BYTES``. Rows with a null id or label are left out.
    """
    known = labels.where("id IS NOT NULL AND label IS NOT NULL")
    sizes = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return pa.table({"id": pa.array([], pa.int64()), "label": [], "text": pa.array([], pa.string())}), {}
    share = F.lit(0.0)
    for label, n in sizes.items():
        share = F.when(F.col("label") == F.lit(label), F.lit(per_class / n)).otherwise(share)
    chosen = known.where(_place("id") < share)
    if docs is not None:
        chosen = docs.join(small(written(chosen.select("id", "label").distinct())), "id")
    chosen = chosen.where(F.octet_length(F.coalesce("text", F.lit(""))) <= MAX_TEXT_BYTES)
    chosen = written(chosen.select("id", "label", "text").distinct())
    count, most = chosen.count(), MOST_TIMES * per_class * len(sizes)
    if count > most:
        chosen = chosen.where(_place("id", "text") < most / count)
    table = chosen.toArrow()
    return table.sort_by([("id", "ascending"), ("label", "ascending"), ("text", "ascending")]), sizes


def _place(*columns: str) -> Column:
    """A number in [0, 1) by the hash of some columns."""
    return F.pmod(F.xxhash64(*columns, F.lit("sample")), F.lit(1 << 40)) / F.lit(float(1 << 40))
