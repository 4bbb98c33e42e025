"""Places and running totals in a given order, for groups of any size.

Rows are cut into ranges of the whole order, numbered inside each range, and shifted by what stands in
the ranges before: no task holds a group, however large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteaudit.session import checkpoint_dir


def running(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """``df`` with ``place`` (1, 2, ... within ``key``) and ``before`` (sum of ``value`` over the rows before).

    ``order`` must tell the rows of a group apart. Window groups are those of one range; offsets have one row for
    each group and range.
    """
    checkpoint_dir(df.sparkSession)
    cut = df.repartitionByRange(*key, *order).withColumn("_range", F.spark_partition_id()).checkpoint(eager=True)
    inside = Window.partitionBy("_range", *key).orderBy(*order)
    earlier = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    sums = cut.groupBy(*key, "_range").agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"))
    offsets = sums.withColumns({"_n0": F.coalesce(F.sum("_n").over(earlier), zero),
                                "_s0": F.coalesce(F.sum("_s").over(earlier), zero)}).drop("_n", "_s")
    rows = cut.withColumns({"place": F.row_number().over(inside).cast("bigint"),
                            "before": F.coalesce(F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), zero)})
    joined = rows.join(offsets, [*key, "_range"])
    return joined.withColumns({"place": F.col("place") + F.col("_n0"), "before": F.col("before") + F.col("_s0")}) \
        .select(*df.columns, "place", "before")
