"""Prefix sums and ranks within groups of any size: no task orders a whole group."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def banded(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """df in bands, written: rows with _band, a number that rises with (keys, order). The bounds come from a sample, so
    bands hold about equally many rows however the values lie; rows equal in keys and order share a band."""
    return written(df.repartitionByRange(*keys, *order).withColumn("_band", F.spark_partition_id()), "banded")


def running_sums(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with a running sum of each of the named columns among the rows with equal keys (null equal to null), in the given
    order, itself included.

    Rows are dealt into bands by range of (keys, order). A band's sums are few rows; what all bands before it hold is
    added to the sums inside the band. So a group that holds any part of all rows is shared by many tasks. The order should
    be total: of rows that are equal in it, any may come first.
    """
    names = df.columns
    values = {f"_v{i}": c for i, c in enumerate(sums.values())}
    rows = banded(df.withColumns(values), keys, order)
    # a row for each band and key
    bands = rows.groupBy(*keys, "_band").agg(*[F.sum(v).alias("_s" + v) for v in values])
    earlier = Window.partitionBy(*keys).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_band").alias("_b"), *[F.coalesce(F.sum("_s" + v).over(earlier), F.lit(0)).alias("_o" + v) for v in values])
    inside = Window.partitionBy(*keys, "_band").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_i" + v: F.sum(v).over(inside) for v in values})
    same = F.col("_band") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(bands, same).select(*names, *[(F.col("_i" + v) + F.col("_o" + v)).alias(n) for n, v in zip(sums, values, strict=True)])


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """df with the place of each row, from 1, among the rows with equal keys; the order should be total."""
    return running_sums(df, keys, order, {name: F.lit(1).cast("long")})
