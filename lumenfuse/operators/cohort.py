"""Matching of two cohort tables by subject and date band."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def match_by_date(mri: DataFrame, pet: DataFrame, days: int = 7, same_visit: bool = True, optional: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of one subject whose dates differ by at most ``days``; one equi-join with the band as its residual condition.

    Columns that both have get the suffixes _mri and _pet; columns of ``optional`` are kept where they exist.
    """
    left = mri.select("subject_id", *[F.col(c).alias(f"{c}_mri" if c in pet.columns else c) for c in mri.columns if c != "subject_id"]).alias("m")
    right = pet.select(F.col("subject_id").alias("_subject"), *[F.col(c).alias(f"{c}_pet" if c in mri.columns else c) for c in pet.columns if c != "subject_id"]).alias("p")
    days_between = F.abs(F.datediff("image_date_mri", "image_date_pet"))
    out = left.join(right, F.col("subject_id").eqNullSafe(F.col("_subject")) & (days_between <= days)).withColumn("date_diff_days", days_between).drop("_subject")
    out = out.withColumn("visit_match", F.col("image_visit_mri") == F.col("image_visit_pet"))
    out = out.where("visit_match") if same_visit else out
    base = ["subject_id", "image_date_mri", "image_date_pet", "date_diff_days", "visit_match"]
    return out.select(*[c for c in [*base, *[x for x in out.columns if x not in base and (not optional or x in optional)]] if c in out.columns])


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def read_cohort(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A cohort table from CSV with a header; ``image_date`` becomes a date.  Without a schema types are inferred."""
    reader = spark.read.option("header", True)
    rows = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    return rows.withColumn("image_date", F.to_date("image_date")) if "image_date" in rows.columns else rows


def write_cohort(matched: DataFrame, path: str) -> None:
    matched.write.option("header", True).csv(path)
