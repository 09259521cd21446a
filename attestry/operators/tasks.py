"""One task per person who moved: the first record, and the first later one at another issuer after the person was
last seen at the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.keys import sha_key

MIN_GAP_DAYS = 180
#: Total order of a person's records.
ORDER = ("period", "filed", "acc", "issuer_cik", "row_id")


def task_id(person: Column, anchor: Column, truth: Column, target: Column) -> Column:
    return F.substring(sha_key(person, anchor, truth, F.date_format(target, "yyyy-MM-dd")), 1, 16)


def movers(rows: DataFrame, min_gap_days: int = MIN_GAP_DAYS) -> DataFrame:
    """One row per person who moved, with the anchor's and the target's record as structs a and t.

    Three folds and two joins on the person instead of a sort of each person's records: the anchor is a minimum of
    structs, the last period at its issuer a maximum, the target again a minimum over the rows that qualify. All of them
    fold map-side, so a person with a third of all rows is no burden; both joins have one row per person on one side.
    """
    rec = F.struct(*ORDER, *[c for c in rows.columns if c not in ORDER])
    known = rows.where("person_cik IS NOT NULL AND issuer_cik IS NOT NULL AND period IS NOT NULL")
    anchor = known.groupBy("person_cik").agg(F.min(rec).alias("a"), F.max("period").alias("last_period"))
    at = known.join(anchor.select("person_cik", F.col("a.issuer_cik").alias("__i"), F.col("a.period").alias("__p")), "person_cik")
    last = at.groupBy("person_cik", "__p", "__i").agg(F.max(F.when(F.col("issuer_cik") == F.col("__i"), F.col("period"))).alias("__last"))
    later = known.join(last, "person_cik").where((F.col("issuer_cik") != F.col("__i")) & (F.date_diff("period", "__p") >= min_gap_days) & (F.col("period") > F.col("__last")))
    target = later.groupBy("person_cik").agg(F.min(rec).alias("t"))
    newest = known.groupBy("person_cik").agg(F.max(F.struct(*ORDER)).alias("newest"))
    return anchor.select("person_cik", "a").join(target, "person_cik").join(newest, "person_cik")


def as_tasks(moved: DataFrame) -> DataFrame:
    """Movers in the shape of tasks, without degrees."""
    return moved.select(
        task_id(F.col("person_cik"), F.col("a.issuer_cik"), F.col("t.issuer_cik"), F.col("t.period")).alias("task_id"),
        F.col("a.person_name_raw").alias("person_name_raw"), F.col("a.issuer_cik").alias("anchor_issuer_cik"), F.col("a.issuer_name_raw").alias("anchor_issuer_name"),
        F.col("a.title_class").alias("anchor_title_class"), F.col("a.period").alias("anchor_date"), F.col("t.period").alias("target_date"), "person_cik",
        F.col("t.issuer_cik").alias("truth_issuer_cik"), F.col("t.issuer_name_raw").alias("truth_issuer_name"), F.col("t.title_class").alias("truth_title_class"),
        F.col("t.period").alias("truth_period"), F.col("t.filed").alias("truth_filed"), F.col("t.acc").alias("truth_accession"),
        (F.col("t.issuer_cik") == F.col("newest.issuer_cik")).alias("target_is_last_employer"), F.col("newest.filed").alias("last_filed"),
    )


def restricted(tasks: DataFrame, as_of: Column, max_age_days: float, entity: Column) -> DataFrame:
    """Tasks whose target is the last employer, whose person filed within max_age_days of as_of, and is no entity."""
    fresh = F.date_diff(as_of, F.col("last_filed")) <= max_age_days
    return tasks.where(F.col("target_is_last_employer") & fresh & ~entity)


def elapsed_days(as_of: Column, filed: Column) -> Column:
    """Days since the fact could be known, which is when it was filed."""
    return F.date_diff(as_of, filed)
