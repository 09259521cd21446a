"""Queries over the fitted simulator: cells, draws, floors, sweeps, trajectories, verdicts, episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators import measure, simulate
from attestry.operators.splitting import task_split
from attestry.queries import Registry, sqlparts as q
from attestry.queries.fixtures import answers
from attestry.queries.measure import _RESOLVED, judged

REG = Registry()

_SPLIT = f"CASE WHEN {q.hex_int('task_id')} % 10 < 6 THEN 'train' WHEN {q.hex_int('task_id')} % 10 < 8 THEN 'hillclimb' ELSE 'test' END"
_SHARES = "round(avg(CASE WHEN outcome = 'CORRECT' THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS p_correct, round(avg(CASE WHEN outcome = 'STALE' THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS p_stale, round(avg(CASE WHEN outcome IN ('FALSE_MERGE', 'UNSURE_WRONG') THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS p_wrong, round(avg(CASE WHEN outcome IN ('MISS', 'ABSTAIN') THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS p_miss, round(avg(confidence), 6) AS mean_confidence, round(avg(spend_usd), 6) AS mean_spend_usd"
_CELLS = f"""{_RESOLVED}, obs AS (SELECT arm AS provider, 'answer' AS action, band, outcome, confidence, spend_usd FROM judged WHERE {_SPLIT} = 'train'),
cells AS (SELECT provider, action, band, count(*) AS n, {_SHARES} FROM obs GROUP BY provider, action, band HAVING count(*) >= 5 UNION ALL SELECT NULL, NULL, NULL, count(*), {_SHARES} FROM obs)"""


def cells(spark: SparkSession, d: str) -> DataFrame:
    obs = judged(spark, d).where(task_split(F.col("task_id")) == "train").select(F.col("arm").alias("provider"), F.lit("answer").alias("action"), "band", "outcome", "confidence", "spend_usd")
    return simulate.checked(simulate.fit(obs))


@REG.add("fitted_cells", f"WITH {_CELLS} SELECT coalesce(provider, 'pooled') AS provider, coalesce(band, 'pooled') AS band, n, p_correct, p_stale, p_wrong, p_miss, mean_confidence, mean_spend_usd FROM cells")
def fitted_cells(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    return c.select(F.coalesce("provider", F.lit("pooled")).alias("provider"), F.coalesce("band", F.lit("pooled")).alias("band"), "n", "p_correct", "p_stale", "p_wrong", "p_miss", "mean_confidence", "mean_spend_usd")


_RATES = ", ".join(f"coalesce(c.{x}, p.{x}) AS {x}" for x in ("p_correct", "p_stale", "p_wrong", "mean_confidence"))
_SIM = f"""{_CELLS}, tried AS (SELECT a.task_id, a.arm AS provider, a.band, c.provider IS NULL AS pooled, {q.hex_int("sha256('11|' || a.task_id || '|' || a.arm)")} / 4294967296.0::DOUBLE AS u, {_RATES}
  FROM answers a LEFT JOIN cells c ON c.provider = a.arm AND c.band = a.band CROSS JOIN (SELECT * FROM cells WHERE provider IS NULL) p),
sim AS (SELECT *, CASE WHEN u < p_correct THEN 'correct' WHEN u < p_correct + p_stale THEN 'stale' WHEN u < p_correct + p_stale + p_wrong THEN 'wrong' ELSE 'none' END AS kind FROM tried)"""


def simulated(spark: SparkSession, d: str) -> DataFrame:
    rows = answers(spark, d).select("task_id", F.col("arm").alias("provider"), F.lit("answer").alias("action"), "band").withColumn("key", F.concat_ws("|", "task_id", "provider"))
    return simulate.simulated(simulate.cell_for(rows, cells(spark, d)), "key")


@REG.add("simulated_answers", f"WITH {_SIM} SELECT task_id, provider, pooled, round(u, 9) AS u, kind FROM sim")
def simulated_answers(spark: SparkSession, d: str) -> DataFrame:
    return simulated(spark, d).select("task_id", "provider", "pooled", "u", "kind")


_COST = "CASE {0} " + " ".join(f"WHEN '{o}' THEN {c / 5.0}::DOUBLE" for o, c in measure.PROFILES["gtm_outbound"].items()) + " ELSE 0.0 END"
_OUT = "CASE kind WHEN 'correct' THEN 'CORRECT' WHEN 'stale' THEN 'STALE' WHEN 'wrong' THEN CASE WHEN {0} >= 0.5 THEN 'FALSE_MERGE' ELSE 'UNSURE_WRONG' END ELSE 'MISS' END"
_REWARD = "{total} - 0.5 * pow({conf} - CASE WHEN {out} = 'CORRECT' THEN 1.0::DOUBLE ELSE 0.0 END, 2) - {cost} - CASE WHEN {out} = 'CORRECT' THEN 0.3::DOUBLE * {spend} / {budget} ELSE 0.0 END"
_TOTAL = "CASE WHEN kind IN ('correct', 'stale') THEN 1.0::DOUBLE / 3 ELSE 0.0 END"


def _floor(name: str, spend: float, conf: str, out: str, total: str) -> str:
    reward = _REWARD.format(total=total, conf=conf, out=out, cost=_COST.format(out), spend=spend, budget=0.2)
    return f"SELECT '{name}' AS policy, round(avg({reward}), 6) AS mean_reward, round({spend}::DOUBLE, 6) AS mean_spend, count(*) FILTER (WHERE {out} = 'CORRECT') AS n_correct FROM sim"


_C = "greatest(mean_confidence, 0.9)"


@REG.add("floor_policies", f"WITH {_SIM} " + " UNION ALL ".join([_floor("never_verify", 0.05, _C, "(" + _OUT.format(_C) + ")", _TOTAL), _floor("always_deep_verify", 0.05 * 3, _C, "(" + _OUT.format(_C) + ")", _TOTAL), _floor("abstain_always", 0.0, "0.0::DOUBLE", "'ABSTAIN'", "0.0::DOUBLE")]))
def floor_policies(spark: SparkSession, d: str) -> DataFrame:
    return simulate.floors(simulated(spark, d), budget=0.2, price=0.05)


@REG.add(
    "confidence_sweep",
    f"WITH {_SIM}, grid AS (SELECT i / 10.0::DOUBLE AS c FROM range(11) r(i)) SELECT c AS confidence, round(avg({_REWARD.format(total=_TOTAL, conf='c', out='(' + _OUT.format('c') + ')', cost=_COST.format('(' + _OUT.format('c') + ')'), spend=0.0, budget=1.0)}), 6) AS mean_reward FROM sim CROSS JOIN grid GROUP BY c",
)
def confidence_sweep(spark: SparkSession, d: str) -> DataFrame:
    return simulate.confidence_sweep(simulated(spark, d))


_TRAJ = f"{_RESOLVED}, traj AS (SELECT task_id, arm, CASE arm WHEN 'alpha' THEN 1 WHEN 'beta' THEN 2 ELSE 3 END AS seq, outcome, spend_usd, w AS turns, confidence FROM judged)"


def trajectories(spark: SparkSession, d: str) -> DataFrame:
    """The arms' answers to a task as its attempts."""
    seq = F.when(F.col("arm") == "alpha", 1).when(F.col("arm") == "beta", 2).otherwise(3)
    return judged(spark, d).select("task_id", "arm", seq.alias("seq"), "outcome", "spend_usd", F.col("w").alias("turns"), "confidence")


_HIT = "CASE WHEN outcome = 'CORRECT' THEN 1.0::DOUBLE ELSE 0.0 END"


@REG.add("solve_rates", f"WITH {_TRAJ} SELECT task_id, round(avg({_HIT}), 6) AS rate FROM traj GROUP BY task_id")
def solve_rates(spark: SparkSession, d: str) -> DataFrame:
    return simulate.solve_rates(trajectories(spark, d))


@REG.add("tasks_in_band", f"WITH {_TRAJ} SELECT task_id, round(avg({_HIT}), 6) AS rate FROM traj GROUP BY task_id HAVING round(avg({_HIT}), 6) BETWEEN 0.1 AND 0.8")
def tasks_in_band(spark: SparkSession, d: str) -> DataFrame:
    return simulate.in_band(simulate.solve_rates(trajectories(spark, d)))


@REG.add("solve_histogram", f"WITH {_TRAJ}, r AS (SELECT round(avg({_HIT}), 6) AS rate FROM traj GROUP BY task_id) SELECT least(floor(rate * 10), 9)::BIGINT AS decile, count(*) AS n_tasks FROM r GROUP BY 1")
def solve_histogram(spark: SparkSession, d: str) -> DataFrame:
    return simulate.solve_histogram(simulate.solve_rates(trajectories(spark, d)))


@REG.add("rejection_sample", f"WITH {_TRAJ} SELECT task_id, seq, spend_usd, turns FROM traj WHERE outcome = 'CORRECT' QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY seq) <= 2")
def rejection_sample(spark: SparkSession, d: str) -> DataFrame:
    return simulate.rejection_sample(trajectories(spark, d)).select("task_id", "seq", "spend_usd", "turns")


@REG.add("advantages", f"WITH {_TRAJ}, s AS (SELECT task_id, avg(confidence) AS m, stddev_pop(confidence) AS s FROM traj GROUP BY 1) SELECT task_id, arm, round((confidence - m) / CASE WHEN s > 1e-12 THEN s ELSE 1.0 END, 6) AS advantage FROM traj JOIN s USING (task_id)")
def advantages(spark: SparkSession, d: str) -> DataFrame:
    return simulate.advantage(trajectories(spark, d), ["task_id"], "confidence").select("task_id", "arm", "advantage")


@REG.add(
    "seed_verdicts",
    f"WITH {_RESOLVED}, s AS (SELECT arm, w AS seed, avg({_HIT}) AS score FROM judged GROUP BY ALL), v AS (SELECT arm, count(*) AS seeds, avg(score) AS m, coalesce(stddev_samp(score), 'inf'::DOUBLE) AS sd, 0.3::DOUBLE AS baseline FROM s GROUP BY arm), r AS (SELECT *, m - baseline AS margin FROM v), "
    "z AS (SELECT *, CASE WHEN seeds < 3 THEN 'too few seeds' WHEN margin <= 0 THEN 'no better than the baseline' WHEN sd >= margin THEN 'margin is seed noise' ELSE 'margin exceeds the spread' END AS reason FROM r) SELECT arm, seeds, round(m, 6) AS mean, round(sd, 6) AS sd, round(margin, 6) AS margin, reason = 'margin exceeds the spread' AS claimable, reason FROM z",
)
def seed_verdicts(spark: SparkSession, d: str) -> DataFrame:
    s = judged(spark, d).groupBy("arm", F.col("w").alias("seed")).agg(F.avg(F.when(F.col("outcome") == "CORRECT", 1.0).otherwise(0.0)).alias("score"))
    return simulate.verdict(s.withColumn("baseline", F.lit(0.3)))


def episode_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Tasks with the cell of one provider and the split they are in."""
    rows = answers(spark, d).where("arm = 'alpha'").select("task_id", F.lit("alpha").alias("provider"), F.lit("answer").alias("action"), "band")
    got = simulate.cell_for(rows, cells(spark, d))
    return got.select("task_id", "p_correct", "p_stale", "p_wrong", "mean_confidence", task_split(F.col("task_id")).alias("split"))


@REG.add("trained_policies")
def trained_policies(spark: SparkSession, d: str) -> DataFrame:
    """A policy per seed, with the epoch and score of its best checkpoint."""
    got = simulate.train(episode_tasks(spark, d), seeds=6, epochs=6, group=8)
    return got.select("seed", "best_epoch", F.round("score", 6).alias("score"))
