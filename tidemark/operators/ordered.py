"""What comes before a row in a long order, without the whole of a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialized

COUNT, MAX, LAST = "count", "max", "last"


def before(rows: DataFrame, by: list[str], order: list[str], adds: dict[str, tuple[str, str | None]]) -> DataFrame:
    """``rows`` with, by name, what the rows before each in its group say: (COUNT, None) how many, (MAX, c) the largest c, (LAST, c) the c of the one before.

    One range exchange deals the rows out in order and is written, so that all sides see the
    same ranges; within a range they are counted, and the totals of earlier ranges, one row a
    range and group, are added. A group of any length spans as many tasks as it needs.
    Rows must differ in ``order`` within a group; before the first row: 0 or null.
    """
    ranged = rows.repartitionByRange(*by, *order).withColumn("part_", F.spark_partition_id())
    ranged = materialized(ranged)
    inside = Window.partitionBy("part_", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)

    def of(kind: str, column: str | None, window) -> Column:
        if kind == COUNT:
            return F.count("*").over(window)
        return (F.max(column) if kind == MAX else F.last(column)).over(window)

    whole = {COUNT: lambda c: F.count("*"), MAX: F.max, LAST: lambda c: F.max_by(c, F.struct(*order))}
    totals = ranged.groupBy("part_", *by).agg(*[whole[kind](c).alias(f"{name}_all") for name, (kind, c) in adds.items()])
    ahead = {
        COUNT: lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0)), MAX: lambda c: F.max(c).over(earlier),
        LAST: lambda c: F.last(c).over(earlier),
    }
    totals = totals.select("part_", *by, *[ahead[kind](f"{name}_all").alias(f"{name}_ahead") for name, (kind, _) in adds.items()])
    within = ranged.select(
        "*", F.count("*").over(inside).alias("place_"),
        *[of(kind, c, inside).alias(f"{name}_here") for name, (kind, c) in adds.items()],
    )
    join = {
        COUNT: lambda here, far: here + far,
        MAX: lambda here, far: F.greatest(here, far),
        LAST: lambda here, far: F.when(F.col("place_") > 0, here).otherwise(far),
    }
    made = [join[kind](F.col(f"{name}_here"), F.col(f"{name}_ahead")).alias(name) for name, (kind, _) in adds.items()]
    return within.join(totals, ["part_", *by]).select(*rows.columns, *made)
