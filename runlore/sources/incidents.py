"""Incidents to diagnose and labelled incidents to evaluate on; result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlore import schemas
from runlore.functions import text as tx


def read_incidents(spark: SparkSession, path: str) -> DataFrame:
    """All incidents of the files, JSON arrays."""
    return spark.read.schema(schemas.INCIDENTS).option("multiLine", True).json(path)


def read_eval_samples(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(schemas.EVAL_SAMPLES).option("multiLine", True).json(path)
    return with_sample_defaults(rows)


def with_sample_defaults(rows: DataFrame) -> DataFrame:
    # Defaults of missing keys.
    return rows.withColumns(
        {
            "service": tx.or_default(F.col("service"), ""),
            "priority": tx.or_default(F.col("priority"), "P3"),
            "error_message": tx.or_default(F.col("error_message"), ""),
        }
    )


def validate_incidents(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): id, title and description must be present; rejected rows say what is missing."""
    reasons = F.filter(
        F.array(
            *[
                F.when(F.col(c).isNull(), F.lit(f"{c} is required"))
                for c in ("incident_id", "title", "description")
            ]
        ),
        lambda r: r.isNotNull(),
    )
    checked = rows.withColumn("reasons", reasons)
    return checked.where(F.size("reasons") == 0).drop("reasons"), checked.where(F.size("reasons") > 0)


def write_results(df: DataFrame, path: str, fmt: str = "json") -> None:
    if fmt not in ("json", "parquet"):
        raise ValueError(f"unknown result format: {fmt}")
    df.write.mode("overwrite").format(fmt).save(path)
