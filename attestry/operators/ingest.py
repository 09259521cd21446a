"""From filing rows to attested records: last arrival wins, one join, an ordered cascade of exclusions, and counts that
must add up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.dates import parse_date
from attestry.functions.keys import digits
from attestry.functions.titles import title_class

# Relationship tokens and their roles; the earliest quarter; contact columns that are never read on.
ROLES = {"director": "DIRECTOR", "officer": "OFFICER", "tenpercentowner": "TEN_PERCENT_OWNER", "other": "OTHER"}
FLOOR = (2003, 3)
CONTACT_COLUMNS = ("rptowner_street1", "rptowner_street2", "rptowner_city", "rptowner_state", "rptowner_zipcode", "rptowner_state_desc")
DROPS = ("unjoined_accession", "ten_percent_owner_only", "no_officer_or_director", "bad_person_cik", "unparseable_date", "period_after_filed", "quarter_before_2003q3")


def roles(c: Column | str) -> Column:
    """Sorted set of known roles in a comma-joined relationship; blanks, hyphens and case do not count."""
    c = F.col(c) if isinstance(c, str) else c
    tokens = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda t: F.regexp_replace(F.lower(t), r"[\s-]", ""))
    named = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.array_sort(F.array_distinct(F.filter(F.transform(tokens, lambda t: F.element_at(named, t)), lambda r: r.isNotNull())))


def last_arrival(submissions: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """One row per key: the last by order. A max of structs, folded map-side."""
    kept = [c for c in submissions.columns if c not in order]
    best = submissions.where(key.isNotNull()).groupBy(key.alias("__key")).agg(F.max(F.struct(*order, *kept)).alias("s"))
    return best.select("__key", "s.*")


def judged(owners: DataFrame, submissions: DataFrame, floor: tuple[int, int] = FLOOR) -> DataFrame:
    """Every owner row with its disposition: kept, or the first rule of the cascade that drops it.

    The order is part of the meaning: unjoined, roles, id, dates, period after filing, floor. Only the columns that are
    used reach the join; contact columns are never among them. An owner row without an accession is unjoined.
    """
    sub = last_arrival(submissions.select("arrived_at", "sub_id", "accession_number", "period_of_report", "filing_date", "issuercik", "issuername", "issuertradingsymbol"), digits("accession_number"), ["arrived_at", "sub_id"])
    dates = [parse_date("period_of_report").alias("period"), parse_date("filing_date").alias("filed")]
    sub = sub.select(F.col("__key"), F.lit(True).alias("__joined"), *dates, *[F.col(c).alias(f"s_{c}") for c in ("issuercik", "issuername", "issuertradingsymbol")])
    own = owners.select("owner_id", "archive", F.trim("accession_number").alias("accession"), digits("accession_number").alias("__k"), F.trim("rptownercik").alias("person_cik"), F.trim("rptownername").alias("person_name_raw"), "rptowner_relationship", roles("rptowner_relationship").alias("role_class"), F.trim(F.coalesce("rptowner_title", F.lit(""))).alias("title_raw"))
    rows = own.join(sub, F.col("__k") == F.col("__key"), "left").withColumn("title_class", title_class("title_raw"))
    has = lambda r: F.array_contains("role_class", r)
    quarter = F.struct(F.year("filed").alias("y"), F.quarter("filed").alias("q"))
    early = quarter < F.struct(F.lit(floor[0]).alias("y"), F.lit(floor[1]).alias("q"))
    disposition = (
        F.when(F.col("__joined").isNull(), "unjoined_accession")
        .when(~(has("OFFICER") | has("DIRECTOR")) & (F.col("role_class") == F.array(F.lit("TEN_PERCENT_OWNER"))), "ten_percent_owner_only")
        .when(~(has("OFFICER") | has("DIRECTOR")), "no_officer_or_director")
        .when(~F.coalesce(F.col("person_cik").rlike("^[0-9]+$"), F.lit(False)), "bad_person_cik")
        .when(F.col("period").isNull() | F.col("filed").isNull(), "unparseable_date")
        .when(F.col("period") > F.col("filed"), "period_after_filed")
        .when(early, "quarter_before_2003q3")
        .otherwise("kept")
    )
    return rows.withColumn("disposition", disposition)


def attested(rows: DataFrame) -> DataFrame:
    """Kept rows as attested records."""
    kept = rows.where("disposition = 'kept'")
    return kept.select("owner_id", "accession", "person_cik", "person_name_raw", F.trim("s_issuercik").alias("issuer_cik"), F.trim("s_issuername").alias("issuer_name_raw"), F.trim("s_issuertradingsymbol").alias("issuer_ticker"), "role_class", "title_raw", "title_class", "period", "filed")


def exclusion_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counters per group. input_rows = kept + the drops, which reconciles() asserts; unknown tokens are counted among
    joined rows and unknown titles among kept ones, and exclude nothing."""
    blank = F.trim(F.coalesce("rptowner_relationship", F.lit(""))) == ""
    token = (F.col("disposition") != "unjoined_accession") & (F.size("role_class") == 0) & ~blank
    title = (F.col("disposition") == "kept") & (F.col("title_class") == "UNKNOWN")
    folded = rows.groupBy(*by, "disposition", token.alias("__token"), title.alias("__title")).agg(F.count(F.lit(1)).alias("__n"))
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("__n"))), F.lit(0))
    each = [n(F.col("disposition") == d).alias(d) for d in ("kept", *DROPS)]
    return folded.groupBy(*by).agg(F.sum("__n").alias("input_rows"), *each, n(F.col("__token")).alias("unknown_relationship_token"), n(F.col("__title")).alias("title_unknown"))


def reconciles(counts: DataFrame) -> DataFrame:
    """counts, failing on any row whose kept and dropped rows are not its input."""
    total = F.col("kept") + sum((F.col(d) for d in DROPS), F.lit(0))
    return counts.where(F.assert_true(total == F.col("input_rows"), F.lit("kept and dropped rows do not add up")).isNull())
