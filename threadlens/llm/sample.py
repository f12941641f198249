"""Bounded samples of labelled texts, to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_sample(rows: DataFrame, label: str, key: str, per_label: int, max_labels: int) -> DataFrame:
    """About ``2 * per_label`` rows of each of the ``max_labels`` commonest labels, by a hash of ``key``.

    The rate follows the label's count, so the sample's size does not grow with the table; a limit over
    the hash order makes the bound ``3 * per_label * max_labels`` hold exactly.
    """
    rows = rows.where(F.col(label).isNotNull()).withColumn("_h", F.xxhash64(F.col(key), F.lit(17)))
    counts = rows.groupBy(label).count().orderBy(F.desc("count"), label).limit(max_labels).collect()
    rate = F.lit(None).cast("double")
    for r in counts:
        rate = F.when(F.col(label) == F.lit(r[label]), F.lit(min(1.0, 2.0 * per_label / r["count"]))).otherwise(rate)
    unit = F.pmod(F.col("_h"), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(unit < rate).orderBy("_h", key, label).limit(3 * per_label * max(1, len(counts))).drop("_h")


def first_of_each(rows: list, label: str, per_label: int) -> list:
    """The first ``per_label`` rows of each label, in the given order."""
    seen: dict = {}
    out = []
    for r in rows:
        seen[r[label]] = seen.get(r[label], 0) + 1
        if seen[r[label]] <= per_label:
            out.append(r)
    return out
