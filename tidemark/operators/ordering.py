"""Dense numbers in a total order, without a window over all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import stored

#: Spark's own layout of monotonically_increasing_id: the partition above these bits, the row's place in it below.
PLACE_BITS = 33


def numbered(rows: DataFrame, *order: Column | str, name: str = "at") -> DataFrame:
    """rows with a column of their places (from 0, without gaps) in the order.

    Rows are dealt to ranges of the order and sorted in each; a row's number is
    its place there after the counts of the ranges before. Counts, one for each
    task, are all that the driver sees. Rows that are equal in the whole order
    stand next to each other in any order. Rows should be at rest: they are read twice.
    """
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())
    ranges = stored(ranges, "numbered")
    part = F.shiftright(name, PLACE_BITS).cast("int")
    counts = sorted(map(tuple, ranges.groupBy(part.alias("part")).count().collect()))
    before = accumulate((n for _, n in counts), initial=0)
    firsts = [(p, b) for (p, _), b in zip(counts, before)]
    firsts = rows.sparkSession.createDataFrame(firsts, "numbered_part int, numbered_first long")
    both = ranges.join(F.broadcast(firsts), part == F.col("numbered_part"))
    place = F.col(name) - F.shiftleft(F.col("numbered_part").cast("long"), PLACE_BITS)
    return both.withColumn(name, F.col("numbered_first") + place).drop("numbered_part", "numbered_first")


def running_sums(rows: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """key, order and, for each column of values, its sum over the rows of the key up to this one.

    Rows (at rest) are dealt to ranges of key and order, and summed along each
    range; the sums of a key in a range are added to its ranges that follow.
    Those are a row for each key and range, plus one for each key that lies within a range.
    """
    ranges = rows.select(key, order, *values).repartitionByRange(key, order).sortWithinPartitions(key, order)
    ranges = stored(ranges.withColumn("part", F.spark_partition_id()), "ranges")
    totals = ranges.groupBy(key, "part").agg(*(F.sum(v).alias(f"all_{v}") for v in values))
    # Only keys in several ranges carry anything over; each range boundary lies in one key at most.
    several = totals.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    carried = totals.join(several, key, "left_semi")
    past = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select(key, "part", *(F.coalesce(F.sum(f"all_{v}").over(past), F.lit(0)).alias(f"all_{v}") for v in values))
    local = Window.partitionBy(key, "part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranges.select(key, order, "part", *(F.sum(v).over(local).alias(v) for v in values))
    both = summed.join(stored(carried, "carried"), [key, "part"], "left")
    return both.select(key, order, *((F.col(v) + F.coalesce(F.col(f"all_{v}"), F.lit(0))).alias(v) for v in values))
