"""Row numbers and short lists that hold when one group has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelens.session import checkpoint


def number_rows(df: DataFrame, group: list[str], order: list[Column], name: str = "row_no") -> DataFrame:
    """``row_number() over (partition by group order by order)`` without putting a group into one task.

    A range sort spreads every group over the cluster; the sorted rows are checkpointed so that their positions stay
    fixed, each partition counts its rows per group, and the running totals of these few counts give the offsets.
    """
    placed = df.orderBy(*group, *order).withColumn("_at", F.monotonically_increasing_id())
    placed = checkpoint(placed).withColumn("_part", F.shiftright("_at", 33))
    # One row per (partition, group that touches it): at most partitions + groups rows.
    chunks = placed.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = placed.join(offsets, [*group, "_part"])
    return joined.withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_at", "_part", "_first", "_before")


def running_count(df: DataFrame, group: list[str], order: list[Column], flag: Column, name: str) -> DataFrame:
    """How many rows of the group up to and with each row have ``flag``; ranges and offsets as in :func:`number_rows`, so no group lies in one task."""
    placed = df.orderBy(*group, *order).withColumn("_at", F.monotonically_increasing_id())
    placed = checkpoint(placed).withColumn("_part", F.shiftright("_at", 33)).withColumn("_flag", flag.cast("long"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    chunks = placed.groupBy(*group, "_part").agg(F.sum("_flag").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.sum("_flag").over(Window.partitionBy(*group, "_part").orderBy("_at"))
    return placed.withColumn("_within", within).join(chunks, [*group, "_part"]).withColumn(name, F.col("_before") + F.col("_within")).drop(
        "_at", "_part", "_flag", "_before", "_within"
    )


def first_per_group(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group, as an ordered minimum (combines before the shuffle, no window)."""
    rest = [c for c in df.columns if c not in group]
    picked = df.groupBy(*group).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*group, *[F.col("_row")[c].alias(c) for c in rest])


def capped(df: DataFrame, group: list[str], order: list[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows of each group with ``item_no``, and in ``more`` how many the group has beyond them.

    The rank filter is a limit Spark also applies before the shuffle, so a hot group sends ``cap`` rows per task.
    """
    ranked = df.withColumn("item_no", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    shown = ranked.where(F.col("item_no") <= cap)
    sizes = df.groupBy(*group).agg(F.greatest(F.count(F.lit(1)) - cap, F.lit(0)).alias("more"))
    return shown.join(sizes, group)


def preview(df: DataFrame, group: list[str], item: str, name: str) -> DataFrame:
    """Per group the distinct items' count and a short list: all of up to three, else two and ``(+n more)``."""
    distinct = df.select(*group, item).distinct()
    top = distinct.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(item))).where(F.col("_r") <= 3)
    listed = top.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("_items"))  # three items at most
    sizes = distinct.groupBy(*group).agg(F.count(F.lit(1)).alias(f"{name}_count"))
    rest = F.concat(F.array_join(F.slice("_items", 1, 2), ", "), F.lit(" (+"), (F.col(f"{name}_count") - 2).cast("string"), F.lit(" more)"))
    text = F.when(F.col(f"{name}_count") <= 3, F.array_join("_items", ", ")).otherwise(rest)
    return sizes.join(listed, group).withColumn(f"{name}_list", text).drop("_items")
