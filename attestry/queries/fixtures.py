"""Inputs that several queries share: attested records with keys by value, and answers drawn by hash from the tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions.keys import digits, hash_draw, number
from attestry.operators.collision import band
from attestry.queries.sqlparts import hex_int
from attestry.session import table

ARMS = ("alpha", "beta", "gamma")


def people(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "attested_tuple")
    return a.select("row_id", digits("accession").alias("acc"), number("person_cik").alias("person_cik"), number("issuer_cik").alias("issuer_cik"), "person_name_raw", "issuer_name_raw", "issuer_ticker", "role_class", "title_raw", "title_class", "period", "filed")


def tasks(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "task")
    keys = [number(c).alias(c) for c in ("person_cik", "anchor_issuer_cik", "truth_issuer_cik")]
    return t.select("task_id", "person_name_raw", "anchor_issuer_name", "anchor_title_class", "anchor_date", "target_date", "truth_issuer_name", "truth_title_class", "truth_period", "truth_filed", "collision_degree", "strict_degree", *keys)


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Per task and arm one answer, of every kind that judging tells apart."""
    t = tasks(spark, d)
    other = t.agg(F.max("person_name_raw").alias("other_name"))  # one row
    rows = t.crossJoin(F.broadcast(other)).withColumn("arm", F.explode(F.array(*[F.lit(a) for a in ARMS]))).withColumn("h", F.sha2(F.concat_ws("|", "task_id", "arm"), 256))
    rows = rows.withColumn("u", hash_draw(F.col("h")) % 100).withColumn("v", F.conv(F.substring("h", 9, 8), 16, 10).cast("bigint") % 101).withColumn("w", F.conv(F.substring("h", 17, 8), 16, 10).cast("bigint") % 3)
    name = F.when(F.col("u") < 60, F.col("person_name_raw")).when(F.col("u") < 72, F.col("other_name")).when(F.col("u") >= 90, F.col("person_name_raw"))
    employer = F.when(F.col("u") < 45, F.col("truth_issuer_name")).when(F.col("u") < 60, F.col("anchor_issuer_name")).when(F.col("u") < 72, F.col("truth_issuer_name")).when(F.col("u") >= 90, F.lit("Nowhere Dynamics"))
    start = F.when(F.col("w") > 0, F.date_sub("truth_period", (F.col("u") * 10).cast("int")))
    end = F.when(F.col("v") % 2 == 1, F.date_add("truth_period", (F.col("u") - 40).cast("int")))
    return rows.select("*", name.alias("person_name"), employer.alias("employer_name"), F.when(F.col("u") < 45, F.col("truth_title_class")).alias("answer_title"), F.col("u").between(82, 89).alias("abstained"), (F.col("v") / 100.0).alias("confidence"), (0.005 * (1 + F.col("w"))).alias("spend_usd"), start.alias("employment_start"), end.alias("employment_end"), band(F.col("collision_degree")).alias("band"))


_K = ", ".join(f"try_cast(trim({c}) AS BIGINT) AS {c}" for c in ("person_cik", "anchor_issuer_cik", "truth_issuer_cik"))
TASKS_SQL = f"tasks AS (SELECT task_id, person_name_raw, anchor_issuer_name, anchor_title_class, anchor_date, target_date, truth_issuer_name, truth_title_class, truth_period, truth_filed, collision_degree, strict_degree, {_K} FROM task)"
ANSWERS_SQL = (
    TASKS_SQL
    + f""",
drawn AS (SELECT *, {hex_int('h')} % 100 AS u, {hex_int('h', 9)} % 101 AS v, {hex_int('h', 17)} % 3 AS w FROM (
  SELECT t.*, a.arm, (SELECT max(person_name_raw) FROM tasks) AS other_name, sha256(t.task_id || '|' || a.arm) AS h FROM tasks t, (SELECT unnest(['alpha', 'beta', 'gamma']) AS arm) a)),
answers AS (SELECT *, CASE WHEN u < 60 THEN person_name_raw WHEN u < 72 THEN other_name WHEN u >= 90 THEN person_name_raw END AS person_name,
  CASE WHEN u < 45 THEN truth_issuer_name WHEN u < 60 THEN anchor_issuer_name WHEN u < 72 THEN truth_issuer_name WHEN u >= 90 THEN 'Nowhere Dynamics' END AS employer_name,
  CASE WHEN u < 45 THEN truth_title_class END AS answer_title, u BETWEEN 82 AND 89 AS abstained, v / 100.0::DOUBLE AS confidence, 0.005::DOUBLE * (1 + w) AS spend_usd,
  CASE WHEN w > 0 THEN truth_period - (u * 10)::INT END AS employment_start, CASE WHEN v % 2 = 1 THEN truth_period + (u - 40)::INT END AS employment_end,
  CASE WHEN collision_degree <= 1 THEN 'unique' WHEN collision_degree <= 3 THEN 'low' WHEN collision_degree <= 9 THEN 'medium' ELSE 'high' END AS band FROM drawn)"""
)
