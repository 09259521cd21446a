"""Queries of problems 2 and 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions.keys import number
from attestry.llm import names, titles
from attestry.llm.components import components
from attestry.queries import Registry
from attestry.session import table

REG = Registry()

# --- 2: variant spellings of names --------------------------------------------------------------------------------


def _named(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "attested_tuple").select(number("person_cik").alias("person"), number("issuer_cik").alias("issuer"), F.col("person_name_raw").alias("name"))


@REG.add("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return names.same_filers(_named(spark, d))


@REG.add("p2_filers")
def p2_filers(spark: SparkSession, d: str) -> DataFrame:
    """Every person_cik with the smallest person_cik of the same filer."""
    found = components(names.same_filers(_named(spark, d)).select(F.col("person_a").alias("a"), F.col("person_b").alias("b")))
    people = _named(spark, d).where("person IS NOT NULL").select("person").distinct()
    return people.join(found, F.col("person") == F.col("node"), "left").select(F.col("person").alias("person_cik"), F.coalesce("label", "person").alias("filer_cik"))


# --- 7: mapping free-entered titles -------------------------------------------------------------------------------


def _titled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "attested_tuple").select("row_id", "title_raw", "title_class")


@REG.add("p7_found")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    ref = table(spark, d, "title_ref")
    canon = F.broadcast(ref.select(F.col("canonical_title").alias("title_raw"), F.lit(True).alias("canonical")).distinct())  # the reference list
    got = titles.map_rows(_titled(spark, d), ref).where(F.col("title_id").isNotNull())
    return got.join(canon, "title_raw", "left_anti").select("row_id", "title_id")


@REG.add("p7_unmatched")
def p7_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Non-blank values that denote no entry, with the rows that hold them."""
    got = titles.map_rows(_titled(spark, d), table(spark, d, "title_ref"))
    return got.where(F.col("title_id").isNull() & (F.trim("title_raw") != "")).groupBy("title_raw").agg(F.count(F.lit(1)).alias("n_rows"))


@REG.add("p7_classes")
def p7_classes(spark: SparkSession, d: str) -> DataFrame:
    """Rows by stored class and the class that the mapping gives."""
    ref = table(spark, d, "title_ref")
    got = titles.map_rows(_titled(spark, d), ref).withColumnRenamed("title_class", "stored_class")
    by = got.groupBy("stored_class", "title_id").agg(F.count(F.lit(1)).alias("n_rows"))
    named = by.join(F.broadcast(ref.select("title_id", "title_class")), "title_id", "left")
    return named.groupBy("stored_class", F.coalesce("title_class", F.lit("UNKNOWN")).alias("title_class")).agg(F.sum("n_rows").alias("n_rows"))
