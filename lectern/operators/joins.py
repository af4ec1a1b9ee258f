"""Look-ups in tables that may be small or large, by keys that may be hot, and numbers in an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.sources.stored import staged

#: Rows up to which a looked-up table is broadcast.
BROADCAST_ROWS = 200_000
#: Rows of a task in :func:`dealt`.
TASK_ROWS = 100_000
#: Rows of a partition that ``monotonically_increasing_id`` can tell apart.
_ROWS = (1 << 33) - 1


def look_up(asking: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", bound: int | None = None) -> DataFrame:
    """``asking`` joined to ``table`` of one short row per key.

    By broadcast while the table has at most ``bound`` rows, which is counted.
    Beyond, both sides are shuffled once and merged, whatever size the table's
    files state; where a word in every text makes a part of the asking side
    long, Spark splits that part and reads the table's beside each (skew join).
    """
    bound = BROADCAST_ROWS if bound is None else bound
    if table.limit(bound + 1).count() <= bound:
        return asking.join(F.broadcast(table), keys, how)
    return asking.join(table.hint("merge"), keys, how)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by some columns over so many tasks that each has about ``TASK_ROWS`` rows, which are counted.

    Shuffled rows that repeat each other are small when written and large when
    sorted; tasks merged by written size would hold the more, the larger the table.
    """
    return df.repartition(max(1, -(-df.count() // TASK_ROWS)), *keys)


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` written in ranges of the order, with ``__range`` and the place ``__at`` in it; nulls come first."""
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return staged(ranges.withColumns({"__range": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit(_ROWS))}), "ranges")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with its rows' numbers from 0 in the order of some columns; nulls come first.

    Ranges of the order are dealt over all tasks and written; a range's numbers
    begin after the rows of those before it, of which only the counts, one a
    range, meet in a window.  No task holds a group of rows.
    """
    made = _ranged(df, order)
    before = F.sum("rows").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    skip = made.groupBy("__range").agg(F.count(F.lit(1)).alias("rows")).select("__range", F.coalesce(before, F.lit(0)).alias("__skip"))
    return made.join(F.broadcast(skip), "__range").withColumn(name, F.col("__at") + F.col("__skip")).drop("__range", "__at", "__skip")


def _over_ranges(df: DataFrame, group: str, order: list[str], within: Column, of_range: Column, before: Column, both: Column, into: str) -> DataFrame:
    """A window over each group in an order, without a task that holds a group: within ranges, and over what each range gives to those after it."""
    made = _ranged(df, [group, *order]).withColumn("__within", within)
    each = made.groupBy("__range", group).agg(of_range.alias("__gives")).withColumn("__before", before)
    told = made.alias("m").join(each.select("__range", group, "__before").alias("e"), (F.col("m.__range") == F.col("e.__range")) & F.col(f"m.{group}").eqNullSafe(F.col(f"e.{group}")))
    return told.withColumn("__both", both).select(*[f"m.`{c}`" for c in df.columns], F.col("__both").alias(into))


def carried(df: DataFrame, group: str, order: list[str], value: str, into: str) -> DataFrame:
    """The last ``value`` that is not null of the rows before, in each group's order."""
    upto = Window.partitionBy("__range", group).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.col("__at")))
    return _over_ranges(df, group, order, F.last(value, True).over(upto), last, F.last("__gives", True).over(ranges), F.coalesce("__within", "__before"), into)


def running(df: DataFrame, group: str, order: list[str], value: Column, into: str) -> DataFrame:
    """The sum of ``value`` up to each row, in each group's order."""
    upto = Window.partitionBy("__range", group).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    ranges = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return _over_ranges(df, group, order, F.sum(value).over(upto), F.sum(value), F.sum("__gives").over(ranges), F.col("__within") + F.coalesce("__before", F.lit(0)), into)


def upto(df: DataFrame, group: str, order: list[str], last: dict[str, Column] | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with columns of the rows up to each one in its group's order: the last values that are not null, and sums (0 of nulls).

    Ranges of the order are dealt over all tasks; what each gives to those
    after it is one row a range and group.
    """
    last, sums = last or {}, {k: F.coalesce(v.cast("long"), F.lit(0)) for k, v in (sums or {}).items()}
    made = _ranged(df, [group, *order])
    within = Window.partitionBy("__range", group).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    ranges = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # The last of a range and group has what the whole gives.
    own = made.select("*", *[F.last(v, True).over(within).alias(f"__v_{k}") for k, v in last.items()], *[F.sum(v).over(within).alias(f"__v_{k}") for k, v in sums.items()])
    gives = made.groupBy("__range", group).agg(*[F.max_by(v, F.when(v.isNotNull(), F.col("__at"))).alias(f"__g_{k}") for k, v in last.items()], *[F.sum(v).alias(f"__g_{k}") for k, v in sums.items()])
    before = gives.select(F.col("__range").alias("__r"), F.col(group).alias("__group"), *[F.last(f"__g_{k}", True).over(ranges).alias(f"__b_{k}") for k in last], *[F.sum(f"__g_{k}").over(ranges).alias(f"__b_{k}") for k in sums])
    told = own.join(before, (F.col("__range") == F.col("__r")) & F.col(group).eqNullSafe(F.col("__group")))
    return told.select(
        *[F.col(f"`{c}`") for c in df.columns], *[F.coalesce(f"__v_{k}", f"__b_{k}").alias(k) for k in last], *[(F.col(f"__v_{k}") + F.coalesce(f"__b_{k}", F.lit(0))).alias(k) for k in sums]
    )
