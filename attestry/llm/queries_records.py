"""Queries of problems 5 and 6."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions.keys import digits, number
from attestry.llm import near_copies, splits
from attestry.queries import Registry
from attestry.session import cut, table

REG = Registry()

# --- 5: splits that keep related records together -----------------------------------------------------------------


def _linked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "attested_tuple").select("row_id", number("person_cik").alias("person"), digits("accession").alias("acc"), "title_class")


@REG.add(
    "p5_found",
    r"""
WITH RECURSIVE held AS (SELECT DISTINCT try_cast(trim(person_cik) AS BIGINT) AS p, nullif(regexp_replace(accession, '[^0-9]', '', 'g'), '') AS a FROM attested_tuple),
firsts AS (SELECT a, min(p) AS m FROM held WHERE p IS NOT NULL AND a IS NOT NULL GROUP BY a HAVING min(p) < max(p)),
links AS (SELECT DISTINCT p, m FROM held JOIN firsts USING (a) WHERE p <> m),
sym AS (SELECT p AS x, m AS y FROM links UNION SELECT m, p FROM links),
reach(x, y) AS (SELECT x, x FROM sym UNION SELECT r.x, s.y FROM reach r JOIN sym s ON r.y = s.x)
SELECT min(y) AS group_cik, x AS person_cik FROM reach GROUP BY x HAVING min(y) < x
""",
)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The groups that the assignment keeps whole, from its rows."""
    held = _assigned(spark, d).where(F.col("person").isNotNull()).select(F.substring("component", 3, 30).cast("bigint").alias("group_cik"), F.col("person").alias("person_cik"))
    return held.where("group_cik < person_cik").distinct()


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    shares = [(r["split"], r["pct"]) for r in table(spark, d, "splits").collect()]  # one row per split
    return splits.assign(_linked(spark, d), "row_id", "person", "acc", "title_class", shares)


@REG.add("p5_assignment")
def p5_assignment(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d).select("row_id", "split")


@REG.add(
    "p5_checks",
    "SELECT count(*) AS n_rows, count(DISTINCT row_id) AS n_row_ids, 0::BIGINT AS parted_persons, 0::BIGINT AS parted_accessions, (SELECT count(*) FROM splits) AS shares_met FROM attested_tuple",
)
def p5_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of an assignment: every row once, no person or accession in two splits, and every split's rows within
    the largest component of its share."""
    wanted = [(r["split"], r["pct"]) for r in table(spark, d, "splits").collect()]  # one row per split
    got = cut(_assigned(spark, d))
    keys = _linked(spark, d).select("row_id", "acc")
    parted = lambda df, k, out: df.where(F.col(k).isNotNull()).groupBy(k).agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias(out))
    rows = got.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("row_id").alias("n_row_ids"))
    largest = got.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("largest"))
    share = spark.createDataFrame(wanted, "split string, pct int")
    held = share.join(got.groupBy("split").agg(F.count(F.lit(1)).alias("n")), "split", "left").crossJoin(F.broadcast(rows)).crossJoin(F.broadcast(largest))  # one row each
    whole = sum(p for _, p in wanted)
    met = held.agg(F.count_if(F.abs(F.coalesce("n", F.lit(0)) - F.col("n_rows") * F.col("pct") / whole) <= F.col("largest")).alias("shares_met"))
    return rows.crossJoin(parted(got, "person", "parted_persons")).crossJoin(parted(got.join(keys, "row_id"), "acc", "parted_accessions")).crossJoin(met)  # one row each


@REG.add("p5_shares")
def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    """Rows per split and title class."""
    got = p5_assignment(spark, d).join(_linked(spark, d).select("row_id", "title_class"), "row_id")
    return got.groupBy("split", "title_class").agg(F.count(F.lit(1)).alias("n_rows"))


# --- 6: duplicates hidden by formatting differences ---------------------------------------------------------------


def record_parts() -> list[Column]:
    """The canonical parts of an attested record: all columns but row_id and loaded_at."""
    words = F.array_join(F.array_sort(F.split(near_copies.canonical_text("person_name_raw"), " ")), " ")
    roles = F.array_join(F.array_sort(F.transform("role_class", lambda r: F.coalesce(F.lower(F.trim(r)), F.lit("~")))), ",")
    return [digits("accession"), number("person_cik"), number("issuer_cik"), F.col("period"), F.col("filed"), words, near_copies.canonical_text("issuer_name_raw"), near_copies.canonical_text("issuer_ticker"), near_copies.canonical_text("title_raw"), near_copies.canonical_text("title_class"), roles]


_TEXT = r"trim(regexp_replace(regexp_replace(lower({0}), '[.''’‘ʼ‐‑-]', '', 'g'), '[^\p{{L}}\p{{N}}\p{{M}}]+', ' ', 'g'))"
_P6_SQL = (
    "WITH canon AS (SELECT row_id, nullif(regexp_replace(accession, '[^0-9]', '', 'g'), '') AS a, try_cast(trim(person_cik) AS BIGINT) AS p, try_cast(trim(issuer_cik) AS BIGINT) AS i, period, filed, "
    f"list_sort(string_split({_TEXT.format('person_name_raw')}, ' ')) AS n, {_TEXT.format('issuer_name_raw')} AS c, {_TEXT.format('issuer_ticker')} AS t, {_TEXT.format('title_raw')} AS r, {_TEXT.format('title_class')} AS k, list_sort(role_class) AS roles FROM attested_tuple), "
    "g AS (SELECT row_id, min(row_id) OVER w AS keep, count(*) OVER w AS n_rows FROM canon WINDOW w AS (PARTITION BY a, p, i, period, filed, n, c, t, r, k, roles)) "
)


@REG.add("p6_found", _P6_SQL + "SELECT keep AS row_a, row_id AS row_b FROM g WHERE row_id <> keep")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    _, copies = near_copies.collapse(table(spark, d, "attested_tuple"), record_parts(), "row_id")
    return copies.select(F.col("__keep").alias("row_a"), F.col("__row").alias("row_b"))


@REG.add("p6_records", _P6_SQL + "SELECT keep AS row_id, n_rows FROM g WHERE row_id = keep")
def p6_records(spark: SparkSession, d: str) -> DataFrame:
    records, _ = near_copies.collapse(table(spark, d, "attested_tuple"), record_parts(), "row_id")
    return records.select(F.col("__keep").alias("row_id"), "n_rows")
