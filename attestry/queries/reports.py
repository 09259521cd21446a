"""Reports on what other queries give: widths, verdicts on intervals, health of a task set, audited strata, attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions import stats
from attestry.operators import measure, sampling, scholar, simulate
from attestry.queries import Registry, sqlparts as q
from attestry.queries.measure import _RESOLVED, judged
from attestry.queries.scholar import _CLEAN, _TASKS, expertise_tasks
from attestry.queries.simulation import _CELLS, _TRAJ, episode_tasks, trajectories
from attestry.session import table

REG = Registry()

_W = q.wilson("k", "n")


@REG.add(
    "accuracy_widths",
    f"WITH {_RESOLVED}, c AS (SELECT arm, count(*) AS n, count(*) FILTER (WHERE outcome = 'CORRECT') AS k FROM judged GROUP BY arm), w AS (SELECT arm, n, {_W['lo']} AS lo, {_W['hi']} AS hi FROM c) "
    "SELECT arm, n, round((hi - lo) / 2, 5) AS half_width, CASE WHEN (hi - lo) / 2 <= 0.05 THEN 'ranking' WHEN (hi - lo) / 2 <= 0.10 THEN 'intervals_only' ELSE 'cannot_separate' END AS allows FROM w",
)
def accuracy_widths(spark: SparkSession, d: str) -> DataFrame:
    """Half-width of each arm's accuracy interval and what it allows to be reported."""
    c = judged(spark, d).groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "CORRECT").alias("k"))
    i = c.withColumn("i", stats.wilson(F.col("k"), F.col("n"))).withColumn("h", stats.half_width(F.struct(F.round("i.lo", 6).alias("lo"), F.round("i.hi", 6).alias("hi"))))
    return i.select("arm", "n", F.round("h", 5).alias("half_width"), stats.power_branch(F.col("h")).alias("allows"))


@REG.add(
    "separated_arms",
    f"WITH {_RESOLVED}, h AS (SELECT task_id, arm, CASE WHEN outcome = 'CORRECT' THEN 1.0::DOUBLE ELSE 0.0 END AS hit FROM judged), v AS (SELECT a.arm AS arm_a, b.arm AS arm_b, count(*) AS n, avg(a.hit - b.hit) AS m, stddev_samp(a.hit - b.hit) AS s FROM h a JOIN h b ON a.task_id = b.task_id AND a.arm < b.arm GROUP BY ALL), "
    "l AS (SELECT *, round(m - 1.96::DOUBLE * s / sqrt(n), 6) AS lo, round(m + 1.96::DOUBLE * s / sqrt(n), 6) AS hi FROM v) SELECT arm_a, arm_b, lo, hi, lo > 0 OR hi < 0 AS separates FROM l",
)
def separated_arms(spark: SparkSession, d: str) -> DataFrame:
    """Normal limits of each paired difference, and whether they leave out 0."""
    rec = judged(spark, d).select("task_id", "arm", F.when(F.col("outcome") == "CORRECT", 1.0).otherwise(0.0).alias("hit"))
    by = sampling.contrasts(rec, "task_id", "arm", "hit").groupBy("arm_a", "arm_b").agg(F.count(F.lit(1)).alias("n"), F.avg("diff").alias("m"), F.stddev_samp("diff").alias("s"))
    arm = 1.96 * F.col("s") / F.sqrt(F.col("n"))
    lim = by.select("arm_a", "arm_b", F.round(F.col("m") - arm, 6).alias("lo"), F.round(F.col("m") + arm, 6).alias("hi"))
    return lim.withColumn("separates", stats.excludes_zero(F.col("lo"), F.col("hi")))


_HIT = "CASE WHEN outcome = 'CORRECT' THEN 1.0::DOUBLE ELSE 0.0 END"


@REG.add("solve_health", f"WITH {_TRAJ}, r AS (SELECT round(avg({_HIT}), 6) AS rate FROM traj GROUP BY task_id) SELECT count(*) AS n_tasks, round(avg(CASE WHEN rate BETWEEN 0.1 AND 0.8 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS share_in_band, round(avg(CASE WHEN rate IN (0.0, 1.0) THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS share_without_advantage FROM r")
def solve_health(spark: SparkSession, d: str) -> DataFrame:
    """Shares of tasks that are solved now and then, and of those whose attempts all end alike and teach nothing."""
    return simulate.solve_health(simulate.solve_rates(trajectories(spark, d)))


@REG.add("outcome_histogram", f"WITH {_RESOLVED} SELECT arm, outcome, least(floor(confidence * 10), 9)::BIGINT AS tenth, count(*) AS n FROM judged GROUP BY ALL")
def outcome_histogram(spark: SparkSession, d: str) -> DataFrame:
    """What each arm did: outcomes by tenth of the stated confidence."""
    return measure.outcome_histogram(judged(spark, d), "arm")


@REG.add(
    "citation_strata",
    rf"""WITH w AS (SELECT DISTINCT coalesce(issuer_cik, '-') AS author, {_CLEAN.format('text')} AS t FROM documents), a AS (SELECT doc_id AS key, kind, coalesce(issuer_cik, '-') || CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE '' END AS author, CASE WHEN doc_id % 3 = 2 THEN 'no such title at all' ELSE text END AS c FROM documents),
c AS (SELECT key, kind, author, {_CLEAN.format('c')} AS t FROM a),
v AS (SELECT kind, CASE WHEN w.t IS NOT NULL THEN 'backed' WHEN c.t IN (SELECT t FROM w WHERE t IS NOT NULL) AND length(c.t) >= 12 THEN 'exists' ELSE 'none' END AS verdict FROM c LEFT JOIN w ON w.author = c.author AND w.t = c.t AND length(c.t) >= 12),
s AS (SELECT coalesce(kind, '-') AS stratum, count(*) AS n, count(*) FILTER (WHERE verdict = 'backed') AS k, count(*) FILTER (WHERE verdict = 'exists') AS n_exists, count(*) FILTER (WHERE verdict = 'none') AS n_none FROM v GROUP BY 1)
SELECT stratum, n, k AS n_backed, n_exists, n_none, {_W['point']} AS backed_rate, {_W['lo']} AS lo, {_W['hi']} AS hi FROM s""",
)
def citation_strata(spark: SparkSession, d: str) -> DataFrame:
    """Audited citations per stratum (the kind of text), with the rate of backed ones and its interval."""
    t = table(spark, d, "documents").select("doc_id", F.coalesce("kind", F.lit("-")).alias("stratum"), F.coalesce("issuer_cik", F.lit("-")).alias("own"), F.col("text").alias("title"))
    author = F.concat("own", F.when(F.col("doc_id") % 3 == 0, "x").otherwise(""))
    cited = F.when(F.col("doc_id") % 3 == 2, "no such title at all").otherwise(F.col("title"))
    verdicts = scholar.citation_audit(t.select(F.col("doc_id").alias("key"), author.alias("author"), F.array(cited).alias("citations")), t.select(F.col("own").alias("author"), "title"))
    return scholar.audit_strata(verdicts.join(t.select(F.col("doc_id").alias("key"), "stratum"), "key"), "stratum")


@REG.add("expertise_sample", f"WITH {_TASKS}, x AS (SELECT sha256(author || '|' || topic || '|' || polarity)[1:16] AS task_id, CASE WHEN polarity = 'ATTESTED' THEN 'ATTESTED' ELSE 'FALSE_near' END AS s FROM et), r AS (SELECT task_id, s, row_number() OVER (PARTITION BY s ORDER BY sha256('11|' || task_id), task_id) AS rn FROM x) SELECT task_id, s AS stratum FROM r WHERE rn <= greatest(1, 60 // (SELECT count(DISTINCT s) FROM x))")
def expertise_sample(spark: SparkSession, d: str) -> DataFrame:
    """Equal shares of attested tasks and constructed ones of a tier; the size is the operator's parameter."""
    s = F.when(F.col("polarity") == "ATTESTED", "ATTESTED").otherwise("FALSE_near")
    return sampling.stratified(expertise_tasks(spark, d).select("task_id", s.alias("stratum")), "task_id", "stratum", 60)


def rollout_sql(runs: str, policies: dict[str, tuple[int, float]]) -> str:
    """SQL: episodes of scripted policies (queries, stated confidence) over every run (seed, run) and task."""
    u = q.hex_int("sha256(s.seed || '|' || t.task_id || '|0')") + " / 4294967296.0::DOUBLE"
    each = " UNION ALL ".join(f"SELECT '{p}' AS policy, {k} AS n_queries, {c}::DOUBLE AS stated" for p, (k, c) in policies.items())
    out = "CASE WHEN n_queries = 0 THEN 'ABSTAIN' WHEN u < p_correct THEN 'CORRECT' WHEN u < p_correct + p_stale THEN 'STALE' WHEN u < p_correct + p_stale + p_wrong THEN CASE WHEN stated >= 0.5 THEN 'FALSE_MERGE' ELSE 'UNSURE_WRONG' END ELSE 'MISS' END"
    costs = " ".join(f"WHEN '{o}' THEN {c / 5.0}::DOUBLE" for o, c in measure.PROFILES["gtm_outbound"].items())
    return f"""{_CELLS}, pol AS ({each}), s AS ({runs}),
t AS (SELECT a.task_id, coalesce(c.p_correct, p.p_correct) AS p_correct, coalesce(c.p_stale, p.p_stale) AS p_stale, coalesce(c.p_wrong, p.p_wrong) AS p_wrong FROM (SELECT * FROM answers WHERE arm = 'alpha') a LEFT JOIN cells c ON c.provider = a.arm AND c.band = a.band CROSS JOIN (SELECT * FROM cells WHERE provider IS NULL) p),
d AS (SELECT policy, run, t.task_id, n_queries, stated, {u} AS u, p_correct, p_stale, p_wrong FROM t CROSS JOIN pol CROSS JOIN s), o AS (SELECT *, {out} AS outcome FROM d),
e AS (SELECT policy, run, task_id, outcome, round(CASE WHEN outcome IN ('CORRECT', 'STALE') THEN 1.0::DOUBLE / 3 ELSE 0.0 END - 0.5::DOUBLE * pow(CASE WHEN n_queries = 0 THEN 0.0 ELSE stated END - CASE WHEN outcome = 'CORRECT' THEN 1.0::DOUBLE ELSE 0.0 END, 2) - CASE outcome {costs} ELSE 0.0 END - CASE WHEN outcome = 'CORRECT' THEN 0.3::DOUBLE * n_queries * 0.05 ELSE 0.0 END, 6) AS reward,
  round(n_queries * 0.05::DOUBLE, 6) AS spend_usd, (n_queries + 1)::INT AS turns, CASE WHEN n_queries = 0 THEN 0.0::DOUBLE ELSE stated END AS confidence FROM o)"""


_SCRIPTED = {"never_verify": (1, 0.9), "always_deep_verify": (3, 0.9), "abstain_always": (0, 0.0)}


@REG.add("episodes", f"WITH {rollout_sql('SELECT 11 AS seed, 0 AS run', _SCRIPTED)} SELECT policy, task_id, outcome, reward, spend_usd, turns, confidence FROM e")
def episodes(spark: SparkSession, d: str) -> DataFrame:
    """Whole episodes of the three floor policies."""
    t, out = episode_tasks(spark, d), None
    for name in _SCRIPTED:
        got = simulate.play(t, name, None, scripted=name)
        out = got if out is None else out.unionByName(got)
    return out.select("policy", "task_id", "outcome", F.round("reward", 6).alias("reward"), F.round("spend_usd", 6).alias("spend_usd"), "turns", "confidence")


@REG.add("rollouts", f"WITH {rollout_sql(chr(10).join(['SELECT ' + chr(39) + '11/' + chr(39) + ' || i AS seed, i AS run FROM range(4) r(i)']), {'never_verify': (1, 0.9)})} SELECT task_id, round(avg(CASE WHEN outcome = 'CORRECT' THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS rate, round(avg(reward), 5) AS mean_reward FROM e GROUP BY task_id")
def rollouts(spark: SparkSession, d: str) -> DataFrame:
    """Four attempts at every task, each with draws of its own: solve rate and mean reward."""
    got = simulate.rollouts(episode_tasks(spark, d), "never_verify", None, runs=4, scripted="never_verify")
    by = got.withColumn("reward", F.round("reward", 6)).groupBy("task_id")
    return by.agg(F.round(F.avg(F.when(F.col("outcome") == "CORRECT", 1.0).otherwise(0.0)), 6).alias("rate"), F.round(F.avg("reward"), 5).alias("mean_reward"))
