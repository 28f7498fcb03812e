"""Running values over a global order, without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut_lineage

AGGREGATES = {"sum": F.sum, "min": F.min, "max": F.max}


def running(df: DataFrame, order: list[Column], values: dict[str, tuple[str, str]]) -> DataFrame:
    """Add running values up to and with each row of a total order.

    values: new column -> (sum | min | max, column).  Rows are range-partitioned by the order;
    each range is scanned on its own, and one row per range carries its total to later ranges.
    """
    ranges = cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    local = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy("_range").agg(*(AGGREGATES[how](col).alias(f"_{new}") for new, (how, col) in values.items()))
    earlier = totals.select("_range", *(AGGREGATES[how](f"_{new}").over(before).alias(f"_{new}") for new, (how, _) in values.items()))
    joined = ranges.join(F.broadcast(earlier), "_range")  # a row per range
    for new, (how, col) in values.items():
        here = AGGREGATES[how](col).over(local)
        both = {"sum": F.coalesce(here, F.lit(0)) + F.coalesce(f"_{new}", F.lit(0)), "min": F.least(here, f"_{new}"), "max": F.greatest(here, f"_{new}")}
        joined = joined.withColumn(new, both[how])
    return joined.drop("_range", *(f"_{new}" for new in values))


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Number the rows of a total order from 1."""
    return running(df.withColumn("_one", F.lit(1).cast("long")), order, {name: ("sum", "_one")}).drop("_one")
