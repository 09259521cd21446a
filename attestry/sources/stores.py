"""Sinks and loaders: JSON lines, Parquet with bounded files, tasks, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions.answers import forbidden_fields

TASK = "task_id string, person_name_raw string, anchor_issuer_cik string, anchor_issuer_name string, anchor_title_class string, anchor_date date, target_date date, person_cik string, truth_issuer_cik string, truth_issuer_name string, truth_title_class string, truth_period date, truth_filed date, truth_accession string, collision_degree int, strict_degree int"


def _refuse_contacts(df: DataFrame) -> None:
    if bad := forbidden_fields(df.schema):
        raise ValueError(f"contact fields: {bad}")


def write_lines(df: DataFrame, path: str) -> None:
    _refuse_contacts(df)
    df.write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str, rows_per_file: int = 250_000) -> None:
    _refuse_contacts(df)
    df.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report of a few rows as one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Tasks from JSON lines under the fixed schema; an absent strict degree is 1."""
    return spark.read.schema(TASK).json(path).withColumn("strict_degree", F.coalesce("strict_degree", F.lit(1)))
