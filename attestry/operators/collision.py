"""How many ids share a name: indices, bands, the bound on one human under two ids, repeated facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.names import company_name, presented_name, strict_name


def band(degree: Column) -> Column:
    return F.when(degree <= 1, "unique").when(degree <= 3, "low").when(degree <= 9, "medium").otherwise("high")


def name_index(rows: DataFrame, form: Column) -> DataFrame:
    """(name, cik) once each; empty names are left out."""
    return rows.select(form.alias("name"), F.col("person_cik").alias("cik")).where((F.col("name") != "") & F.col("cik").isNotNull()).distinct()


def strict_index(rows: DataFrame) -> DataFrame:
    return name_index(rows, strict_name("person_name_raw"))


def presented_index(rows: DataFrame) -> DataFrame:
    return name_index(rows, presented_name("person_name_raw"))


def degrees(index: DataFrame) -> DataFrame:
    """(name, degree): ids under a name. The index is distinct already, so a plain count does."""
    return index.groupBy("name").agg(F.count(F.lit(1)).alias("degree"))


def issuers_of(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("person_cik").alias("cik"), F.col("issuer_cik").alias("issuer")).where("cik IS NOT NULL AND issuer IS NOT NULL").distinct()


def issuer_index(rows: DataFrame) -> DataFrame:
    """(company, issuer) once each."""
    return rows.select(company_name("issuer_name_raw").alias("company"), F.col("issuer_cik").alias("issuer")).where("company <> '' AND issuer IS NOT NULL").distinct()


def with_degrees(rows: DataFrame) -> DataFrame:
    """rows with presented degree, strict degree and band; a name no index has counts 0."""
    p = degrees(presented_index(rows)).select(F.col("name").alias("__p"), F.col("degree").alias("collision_degree"))
    s = degrees(strict_index(rows)).select(F.col("name").alias("__s"), F.col("degree").alias("strict_degree"))
    out = rows.join(p, presented_name("person_name_raw") == F.col("__p"), "left").join(s, strict_name("person_name_raw") == F.col("__s"), "left")
    out = out.withColumn("collision_degree", F.coalesce("collision_degree", F.lit(0))).withColumn("strict_degree", F.coalesce("strict_degree", F.lit(0)))
    return out.drop("__p", "__s").withColumn("band", band(F.col("collision_degree")))


def suspect_pairs(index: DataFrame, issuers: DataFrame) -> DataFrame:
    """(name, a, b): ids a < b under one name with an issuer in common.

    Ids meet under name and issuer together, so the join grows with ids that share both, not with a name's ids squared.
    """
    held = index.join(issuers, "cik").select("name", "issuer", "cik")
    other = held.withColumnRenamed("cik", "b")
    return held.withColumnRenamed("cik", "a").join(other, ["name", "issuer"]).where("a < b").select("name", "a", "b").distinct()


def contamination_bound(index: DataFrame, issuers: DataFrame) -> DataFrame:
    """One row: names with several ids, such names with a suspect pair, the pairs, and the share of suspect names."""
    colliding = degrees(index).where("degree > 1").agg(F.count(F.lit(1)).alias("colliding_names"))
    pairs = suspect_pairs(index, issuers).groupBy("name").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("suspect_names"), F.coalesce(F.sum("n"), F.lit(0)).alias("suspect_pairs"))
    both = colliding.crossJoin(F.broadcast(pairs))  # one row each
    return both.withColumn("suspect_name_rate", F.coalesce(F.round(F.try_divide(F.col("suspect_names").cast("double"), F.col("colliding_names").cast("double")), 6), F.lit(0.0)))


def duplication_rates(rows: DataFrame) -> DataFrame:
    """One row: the share of rows that repeat a fact (person, issuer, period), and of new periods of a known relation.

    Counts of distinct facts and relations give both without an order: n - facts and facts - relations."""
    facts = rows.groupBy("person_cik", "issuer_cik", "period").agg(F.count(F.lit(1)).alias("n"))
    relations = facts.groupBy("person_cik", "issuer_cik").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("facts"))
    total = relations.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("facts"), F.lit(0)).alias("facts"), F.count(F.lit(1)).alias("relations"))
    share = lambda x: F.coalesce(F.round(F.try_divide(x.cast("double"), F.col("n").cast("double")), 6), F.lit(0.0))
    return total.select(share(F.col("n") - F.col("facts")).alias("repeat_filing_rate"), share(F.col("facts") - F.col("relations")).alias("near_duplicate_rate"))
