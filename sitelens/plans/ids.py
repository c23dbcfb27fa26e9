"""Distributed dense ids (0..n-1 in a given order) without a single-partition window.

Plan: range-partition on the (group, order) key and sort within partitions;
tag rows with ``monotonically_increasing_id`` (partition index in the high
bits, row index in the low 33 bits); materialise that once with a reliable
checkpoint so every consumer sees identical tags; count rows per
(partition, group) - at most partitions + groups rows, since a partition holds
a contiguous key range - and turn the counts into offsets with a window over
that small table; id = offset + position inside the partition's run.

With ``group_by`` the ids restart at 0 in each group (a per-group row number
that never puts a hot group into one task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.session import cut_lineage

_ROW_BITS = 33


def dense_ids(df: DataFrame, order_by, name: str = "id", group_by=None) -> DataFrame:
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    groups = [] if group_by is None else ([group_by] if isinstance(group_by, str) else list(group_by))
    keys = groups + order
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    tagged = ranged.withColumn("_mid", F.monotonically_increasing_id())
    tagged = cut_lineage(
        tagged.withColumn("_pid", F.shiftright("_mid", _ROW_BITS))
        .withColumn("_row", F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
    )
    runs = tagged.groupBy("_pid", *groups).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    w = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).select("_pid", *groups, "_off", "_first")
    if not groups:
        offsets = F.broadcast(offsets)  # one row per partition
    return (
        tagged.join(offsets, ["_pid", *groups])
        .withColumn(name, (F.col("_off") + F.col("_row") - F.col("_first")).cast("long"))
        .drop("_mid", "_pid", "_row", "_off", "_first")
    )
