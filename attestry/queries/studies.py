"""Queries over studies: calls, candidates, strata, populations and unpaired contrasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators import measure, sampling
from attestry.operators.collision import band
from attestry.queries import Registry, sqlparts as q
from attestry.queries.fixtures import ANSWERS_SQL, TASKS_SQL, answers, tasks
from attestry.queries.measure import _RESOLVED, _binomial, _u, judged
from attestry.session import table

REG = Registry()


def calls(spark: SparkSession, d: str) -> DataFrame:
    """Per task the arms' answers as one call's list, in the order of the arms: three entries a task."""
    row = F.struct("arm", "person_name", "employer_name", "confidence", "employment_start")
    return answers(spark, d).groupBy("task_id", "truth_issuer_name").agg(F.array_sort(F.collect_list(row)).alias("candidates"))


@REG.add("first_answers", f"WITH {ANSWERS_SQL} SELECT task_id, person_name, employer_name FROM answers WHERE arm = 'alpha'")
def first_answers(spark: SparkSession, d: str) -> DataFrame:
    return calls(spark, d).withColumn("a", measure.first_answer(F.col("candidates"))).select("task_id", "a.person_name", "a.employer_name")


@REG.add(
    "committed_candidates",
    f"WITH {ANSWERS_SQL}, t AS (SELECT task_id, person_name FROM answers WHERE arm = 'alpha') SELECT t.task_id, min(a.arm) AS arm FROM t LEFT JOIN answers a ON a.task_id = t.task_id AND a.person_name = t.person_name AND a.employer_name = a.truth_issuer_name GROUP BY t.task_id",
)
def committed_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The returned row behind a commitment to the first name and the true employer."""
    c = calls(spark, d)
    got = measure.candidate_behind(F.col("candidates"), F.get("candidates", F.lit(0))["person_name"], F.col("truth_issuer_name"))
    return c.withColumn("c", got).select("task_id", "c.arm")


@REG.add("matched_size", f"WITH {_RESOLVED} SELECT min(n) AS matched_n FROM (SELECT arm, count(*) AS n FROM judged WHERE outcome <> 'ABSTAIN' GROUP BY arm)")
def matched_size(spark: SparkSession, d: str) -> DataFrame:
    """The size of the smallest arm that is not empty."""
    return judged(spark, d).where("outcome <> 'ABSTAIN'").groupBy("arm").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("matched_n"))


_ANSWERED = "CASE WHEN outcome NOT IN ('ABSTAIN', 'MISS') THEN CASE WHEN outcome = 'CORRECT' THEN 1.0::DOUBLE ELSE 0.0 END END"


@REG.add("policy_description", f"WITH {_RESOLVED} SELECT arm, count(*) AS n, round(avg(CASE WHEN outcome = 'ABSTAIN' THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS abstain_rate, round(avg({_ANSWERED}), 6) AS precision_answered, round(avg(confidence), 6) AS mean_confidence FROM judged GROUP BY arm")
def policy_description(spark: SparkSession, d: str) -> DataFrame:
    return measure.describe(judged(spark, d), "arm")


@REG.add("stratum_labels", f"WITH {ANSWERS_SQL} SELECT stratum, count(*) AS n FROM (SELECT CASE WHEN w > 0 THEN 'ATTESTED' ELSE 'FALSE_' || CASE WHEN u < 50 THEN 'near' ELSE 'far' END END AS stratum FROM answers) GROUP BY 1")
def stratum_labels(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("w") > 0, "ATTESTED").otherwise(F.concat(F.lit("FALSE_"), F.when(F.col("u") < 50, "near").otherwise("far")))
    return answers(spark, d).groupBy(s.alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


@REG.add("tasks_of_band", f"WITH {TASKS_SQL} SELECT task_id FROM tasks WHERE {q.band('collision_degree')} = 'unique' AND truth_issuer_name IS NOT NULL")
def tasks_of_band(spark: SparkSession, d: str) -> DataFrame:
    """A population: tasks of one band that name an employer."""
    return tasks(spark, d).where((band(F.col("collision_degree")) == "unique") & F.col("truth_issuer_name").isNotNull()).select("task_id")


def _sides(spark: SparkSession, d: str) -> DataFrame:
    """Two populations: accounts by balance, and by nation."""
    c = table(spark, d, "customer")
    one = lambda v, s: c.select(F.when(F.col(v[0]) > v[1], 1.0).otherwise(0.0).alias("value"), F.lit(s).alias("side"))
    return one(("c_acctbal", 5000), "a").unionByName(one(("c_nationkey", 12), "b"))


_N = "(SELECT count(*) AS n, count(*) FILTER (WHERE value = 0) AS none FROM s WHERE side = '{0}')"


def _side_draws(side: str) -> str:
    return _binomial(f"SELECT r.i AS resample, n AS m, none::DOUBLE / n AS p, {_u('11' + side, '0.0')} AS u FROM range(10000) r(i), {_N.format(side)}", side)


@REG.add(
    "unpaired_contrast",
    "WITH s AS (SELECT 'a' AS side, CASE WHEN c_acctbal > 5000 THEN 1.0::DOUBLE ELSE 0.0 END AS value FROM customer UNION ALL SELECT 'b', CASE WHEN c_nationkey > 12 THEN 1.0::DOUBLE ELSE 0.0 END FROM customer), "
    f"{_side_draws('a')}, {_side_draws('b')}, d AS (SELECT (a.m - a.k)::DOUBLE / a.m - (b.m - b.k)::DOUBLE / b.m AS m FROM a JOIN b USING (resample)), o AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS r FROM d), l AS (SELECT max(m) FILTER (WHERE r = 250) AS lo, max(m) FILTER (WHERE r = 9750) AS hi FROM o) "
    "SELECT (SELECT round(avg(value) FILTER (WHERE side = 'a') - avg(value) FILTER (WHERE side = 'b'), 6) FROM s) AS point, round(lo, 6) AS lo, round(hi, 6) AS hi, CASE WHEN lo > 0 OR hi < 0 THEN 'separates' ELSE 'cannot separate' END AS verdict FROM l",
)
def unpaired_contrast(spark: SparkSession, d: str) -> DataFrame:
    return sampling.unpaired_interval(_sides(spark, d))
