"""Running sums over a whole table's order, without bringing it into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.sources.store import settled

PARTITION = "range_partition"


def with_running_sums(df: DataFrame, order: Sequence[Column | str], sums: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """``df`` with columns of running sums in an order, up to and with each row; ``by`` starts them anew per value.

    Rows are dealt by ranges of the order and written down, so that a row keeps its range; sums run within a range, and
    what the ranges before hold is added, which is a row per range and value of ``by``.  The order should be total.
    """
    spark = df.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = settled(df.repartitionByRange(ranges, *order).withColumn(PARTITION, F.spark_partition_id()), "ranges")
    inside = Window.partitionBy(PARTITION, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy(PARTITION).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(PARTITION, *by).agg(*[F.sum(c).alias(f"{n}_here") for n, c in sums.items()])
    totals = totals.select(PARTITION, *by, *[F.coalesce(F.sum(f"{n}_here").over(before), F.lit(0)).alias(f"{n}_before") for n in sums])
    run = dealt.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()})
    on = F.lit(True)
    totals = totals.withColumnsRenamed({c: f"{c}_of" for c in (PARTITION, *by)})
    for c in (PARTITION, *by):
        on = on & F.col(c).eqNullSafe(F.col(f"{c}_of"))
    # A row per range and value of `by`: small however large the table is.
    joined = run.join(totals, on).withColumns({n: F.col(n) + F.col(f"{n}_before") for n in sums})
    return joined.drop(PARTITION, *[f"{c}_of" for c in (PARTITION, *by)], *[f"{n}_before" for n in sums])
