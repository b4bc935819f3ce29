"""Per-method metric tables with an AVERAGE row, and the summary over methods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_average(rows: DataFrame, metrics: list[str], keys: tuple[str, ...] = ("Model",), name: str = "ImageName") -> DataFrame:
    """Rows of each method plus its mean over images without NaN, in one pass by grouping sets."""
    mean = [F.avg(F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double"))).alias(m) for m in metrics]
    out = rows.groupingSets([[*map(F.col, keys), F.col(name)], [*map(F.col, keys)]], *keys, name).agg(F.grouping(name).alias("_avg"), *mean)
    return out.withColumn(name, F.when(F.col("_avg") == 1, F.lit("AVERAGE")).otherwise(F.col(name))).drop("_avg")


def summary(rows: DataFrame, metrics: list[str], keys: tuple[str, ...] = ("Model",)) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.avg(F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double"))).alias(m) for m in metrics])


def write_reports(rows: DataFrame, metrics: list[str], path: str, name: str = "ImageName") -> None:
    """A CSV folder per method (AVERAGE last) and, for more than one method, a summary."""
    rows = rows.persist()  # scored once for all tables; what a lost executor held is scored again
    try:
        full = with_average(rows, metrics, name=name)
        full.repartition("Model").sortWithinPartitions("Model", F.col(name) == "AVERAGE", name).write.partitionBy("Model").option("header", True).csv(f"{path}/methods")
        if rows.select("Model").distinct().limit(2).count() > 1:
            summary(rows, metrics).orderBy("Model").coalesce(1).write.option("header", True).csv(f"{path}/summary")  # one row a method
    finally:
        rows.unpersist()
