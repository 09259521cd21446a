"""Queries over answers: resolution, judging, losses, calibration, contrasts, cache and ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions import answers as ans
from attestry.functions import stats
from attestry.operators import collision, measure, metrics, replay, sampling
from attestry.queries import Registry, sqlparts as q
from attestry.queries.fixtures import ANSWERS_SQL, answers, people
from attestry.session import scratch, table

REG = Registry()

# --- resolving and judging ----------------------------------------------------------------------------------------

_RESOLVED = f"""{q.PEOPLE}, {ANSWERS_SQL},
presented_ix AS (SELECT DISTINCT {q.presented('person_name_raw')} AS name, person_cik AS cik FROM people WHERE person_cik IS NOT NULL),
issuers AS (SELECT DISTINCT person_cik AS cik, issuer_cik AS issuer FROM people WHERE person_cik IS NOT NULL AND issuer_cik IS NOT NULL),
firms AS (SELECT {q.company('issuer_name_raw')} AS company, min(issuer_cik) AS employer_cik FROM people WHERE issuer_cik IS NOT NULL GROUP BY 1 HAVING count(DISTINCT issuer_cik) = 1 AND company <> ''),
named AS (SELECT a.*, f.employer_cik, {q.presented('a.person_name')} AS nm FROM answers a LEFT JOIN firms f ON f.company = {q.company('a.employer_name')}),
cand AS (SELECT name, count(*) AS n, min(cik) AS one FROM presented_ix GROUP BY name),
narrow AS (SELECT p.name, i.issuer, count(*) AS n, min(p.cik) AS one FROM presented_ix p JOIN issuers i USING (cik) GROUP BY ALL),
reasoned AS (SELECT m.*, CASE WHEN coalesce(trim(person_name), '') = '' THEN 'no_name_returned' WHEN c.n IS NULL THEN 'name_not_in_corpus' WHEN c.n = 1 THEN 'unique_name' WHEN m.employer_cik IS NULL THEN 'colliding_name_no_employer'
  WHEN w.n IS NULL THEN 'employer_matches_no_candidate' WHEN w.n > 1 THEN 'still_ambiguous_after_employer' WHEN m.employer_cik = m.anchor_issuer_cik THEN 'narrowed_by_anchor' ELSE 'narrowed_by_employer' END AS reason, c.one AS c_one, w.one AS w_one
  FROM named m LEFT JOIN cand c ON c.name = m.nm LEFT JOIN narrow w ON w.name = m.nm AND w.issuer = m.employer_cik),
resolved AS (SELECT *, CASE WHEN reason = 'unique_name' THEN c_one WHEN reason IN ('narrowed_by_anchor', 'narrowed_by_employer') THEN w_one END AS resolved_cik FROM reasoned),
judged AS (SELECT *, CASE WHEN abstained THEN 'ABSTAIN' WHEN resolved_cik IS NULL THEN 'MISS' WHEN resolved_cik IS DISTINCT FROM person_cik THEN CASE WHEN confidence >= 0.5 THEN 'FALSE_MERGE' ELSE 'UNSURE_WRONG' END
  WHEN employer_cik IS NULL THEN 'MISS' WHEN employer_cik IS DISTINCT FROM truth_issuer_cik THEN 'STALE' ELSE 'CORRECT' END AS outcome FROM resolved)"""


def resolved(spark: SparkSession, d: str) -> DataFrame:
    p = people(spark, d)
    employed = measure.resolve_issuer(answers(spark, d), collision.issuer_index(p))
    return measure.resolve(employed, collision.presented_index(p), collision.issuers_of(p), "task_id")


def judged(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return resolved(spark, d).withColumn("outcome", measure.judge(c("abstained"), c("resolved_cik"), c("person_cik"), c("employer_cik"), c("truth_issuer_cik"), c("confidence")))


@REG.add("resolutions", f"WITH {_RESOLVED} SELECT task_id, arm, CAST(employer_cik AS VARCHAR) AS employer_cik, CAST(resolved_cik AS VARCHAR) AS resolved_cik, reason, reason = 'unique_name' AS independent FROM resolved")
def resolutions(spark: SparkSession, d: str) -> DataFrame:
    return resolved(spark, d).select("task_id", "arm", *[F.col(c).cast("string").alias(c) for c in ("employer_cik", "resolved_cik")], "reason", (F.col("reason") == "unique_name").alias("independent"))


@REG.add("outcomes", f"WITH {_RESOLVED} SELECT task_id, arm, outcome FROM judged")
def outcomes(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).select("task_id", "arm", "outcome")


_ATOMS = """atoms AS (SELECT *, coalesce(resolved_cik = person_cik, false) AS identity, coalesce(truth_title_class <> 'UNKNOWN', false) AS title_scored, reason = 'unique_name' AS identity_scored,
  coalesce(employment_start <= truth_period AND (employment_end IS NULL OR truth_period <= employment_end), false) AS in_window FROM judged),
scored AS (SELECT *, title_scored AND coalesce(answer_title = truth_title_class, false) AS title FROM atoms),
totals AS (SELECT *, ((CASE WHEN identity_scored AND identity THEN 1 ELSE 0 END) + title::INT + in_window::INT)::DOUBLE / (identity_scored::INT + title_scored::INT + 1) AS total FROM scored)"""


def atoms(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    a = measure.atoms(c("resolved_cik"), c("person_cik"), c("answer_title"), c("truth_title_class"), c("employment_start"), c("employment_end"), c("truth_period"), c("reason") == "unique_name")
    return judged(spark, d).withColumn("a", a)


@REG.add("answer_atoms", f"WITH {_RESOLVED}, {_ATOMS} SELECT task_id, arm, identity, title, in_window AS employment_window, title_scored, identity_scored, round(total, 6) AS total FROM totals")
def answer_atoms(spark: SparkSession, d: str) -> DataFrame:
    return atoms(spark, d).select("task_id", "arm", "a.identity", "a.title", F.col("a.window").alias("employment_window"), "a.title_scored", "a.identity_scored", F.round("a.total", 6).alias("total"))


@REG.add(
    "arm_report",
    f"WITH {_RESOLVED}, {_ATOMS} SELECT arm, count(*) AS n, "
    + ", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS n_{o.lower()}" for o in measure.OUTCOMES)
    + ", round(avg(total), 6) AS mean_atoms, round(sum(spend_usd), 4) AS spend_usd, round(avg(CASE WHEN outcome = 'CORRECT' THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy FROM totals GROUP BY arm",
)
def arm_report(spark: SparkSession, d: str) -> DataFrame:
    """Per arm the counts of all six outcomes, rates and spend."""
    each = [F.count_if(F.col("outcome") == o).alias(f"n_{o.lower()}") for o in measure.OUTCOMES]
    return atoms(spark, d).groupBy("arm").agg(F.count(F.lit(1)).alias("n"), *each, F.round(F.avg("a.total"), 6).alias("mean_atoms"), F.round(F.sum("spend_usd"), 4).alias("spend_usd"), F.round(F.avg(F.when(F.col("outcome") == "CORRECT", 1.0).otherwise(0.0)), 6).alias("accuracy"))


@REG.add("stratum_report", f"WITH {_RESOLVED} SELECT arm, band, outcome, count(*) AS n FROM judged GROUP BY ALL")
def stratum_report(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes per arm and band; strata are never pooled."""
    return judged(spark, d).groupBy("arm", "band", "outcome").agg(F.count(F.lit(1)).alias("n"))


@REG.add("reason_histogram", f"WITH {_RESOLVED} SELECT arm, reason, count(*) AS n FROM resolved GROUP BY ALL")
def reason_histogram(spark: SparkSession, d: str) -> DataFrame:
    return resolved(spark, d).groupBy("arm", "reason").agg(F.count(F.lit(1)).alias("n"))


def _profiles_sql(flat: bool) -> str:
    every = measure.PROFILES | ({"flat": measure.FLAT} if flat else {})
    rows = ", ".join(f"('{p}', '{o}', {0.0 if o == 'CORRECT' else c[o]}::DOUBLE)" for p, c in every.items() for o in measure.OUTCOMES)
    return f"profiles(profile, outcome, cost) AS (VALUES {rows})"


@REG.add("expected_losses", f"WITH {_RESOLVED}, {_profiles_sql(False)} SELECT arm, profile, round(avg(cost), 6) AS expected_loss FROM judged JOIN profiles USING (outcome) GROUP BY ALL")
def expected_losses(spark: SparkSession, d: str) -> DataFrame:
    return measure.expected_loss(judged(spark, d), measure.profile_table(spark), ["arm"])


@REG.add(
    "flat_probe",
    f"WITH {_RESOLVED}, {_profiles_sql(True)}, loss AS (SELECT arm, profile, round(avg(cost), 6) AS l FROM judged JOIN profiles USING (outcome) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY l, arm) AS r FROM loss) "
    "SELECT coalesce(bool_or(a.r <> b.r), false) AS has_power FROM r a JOIN r b ON a.arm = b.arm AND b.profile = 'flat' WHERE a.profile <> 'flat'",
)
def flat_probe(spark: SparkSession, d: str) -> DataFrame:
    return measure.flat_probe(measure.expected_loss(judged(spark, d), measure.profile_table(spark, flat=True), ["arm"]))


@REG.add(
    "expertise_outcomes",
    f"WITH {ANSWERS_SQL}, e AS (SELECT *, CASE WHEN w = 0 THEN 'CONSTRUCTED_FALSE' ELSE 'ATTESTED' END AS polarity, CASE WHEN u < 82 THEN v % 2 = 0 END AS affirms FROM answers) "
    "SELECT polarity, outcome, count(*) AS n FROM (SELECT polarity, CASE WHEN abstained THEN 'ABSTAIN' WHEN affirms IS NULL THEN 'MISS' WHEN polarity = 'ATTESTED' THEN CASE WHEN affirms THEN 'CORRECT' ELSE 'MISS' END WHEN NOT affirms THEN 'CORRECT' WHEN confidence >= 0.5 THEN 'FALSE_MERGE' ELSE 'UNSURE_WRONG' END AS outcome FROM e) GROUP BY ALL",
)
def expertise_outcomes(spark: SparkSession, d: str) -> DataFrame:
    a = answers(spark, d).withColumn("polarity", F.when(F.col("w") == 0, "CONSTRUCTED_FALSE").otherwise("ATTESTED")).withColumn("affirms", F.when(F.col("u") < 82, F.col("v") % 2 == 0))
    o = measure.judge_expertise(F.col("abstained"), F.col("affirms"), F.col("polarity"), F.col("confidence"))
    return a.groupBy("polarity", o.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


# --- intervals and power ------------------------------------------------------------------------------------------

_W = q.wilson("k", "n")


@REG.add("accuracy_intervals", f"WITH {_RESOLVED}, c AS (SELECT arm, band, count(*) AS n, count(*) FILTER (WHERE outcome = 'CORRECT') AS k FROM judged GROUP BY ALL) SELECT arm, band, n, {_W['point']} AS point, {_W['lo']} AS lo, {_W['hi']} AS hi FROM c")
def accuracy_intervals(spark: SparkSession, d: str) -> DataFrame:
    c = judged(spark, d).groupBy("arm", "band").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "CORRECT").alias("k"))
    return c.withColumn("i", stats.wilson(F.col("k"), F.col("n"))).select("arm", "band", "n", *[F.round(f"i.{x}", 6).alias(x) for x in ("point", "lo", "hi")])


@REG.add(
    "power_table",
    "WITH h AS (SELECT unnest([0.14, 0.10, 0.07, 0.05, 0.035])::DOUBLE AS half) SELECT half, ceil(1.959963984540054::DOUBLE * 1.959963984540054 * 0.15 * 0.85 / (half * half))::BIGINT AS required, CASE WHEN half <= 0.05 THEN 'ranking' WHEN half <= 0.10 THEN 'intervals_only' ELSE 'cannot_separate' END AS branch, floor(round(2.5::DOUBLE / 0.005, 9))::BIGINT AS affordable FROM h",
)
def power_table(spark: SparkSession, d: str) -> DataFrame:
    h = spark.createDataFrame([(x,) for x in (0.14, 0.10, 0.07, 0.05, 0.035)], "half double")
    return h.select("half", stats.required_n(F.lit(0.15), F.col("half")).alias("required"), stats.power_branch(F.col("half")).alias("branch"), stats.affordable_n(F.lit(2.5), F.lit(0.005)).alias("affordable"))


@REG.add(
    "false_merge_bands",
    f"""WITH {_RESOLVED}, spine(i, band) AS (VALUES (0, 'unique'), (1, 'low'), (2, 'medium'), (3, 'high')), c AS (SELECT band, count(*) AS n, count(*) FILTER (WHERE outcome = 'FALSE_MERGE') AS k FROM judged WHERE arm = 'alpha' GROUP BY band),
s AS (SELECT i, spine.band, coalesce(n, 0) AS n, coalesce(k, 0) AS k FROM spine LEFT JOIN c ON c.band = spine.band), w AS (SELECT i, band, n, {_W['point']} AS rate, {_W['lo']} AS lo, {_W['hi']} AS hi FROM s)
SELECT band, n, rate, round(CASE WHEN band = 'unique' THEN lo ELSE greatest(0.0, lo - 0.12764) END, 5) AS net_lo, round(CASE WHEN band = 'unique' THEN hi ELSE greatest(0.0, hi - 0.12764) END, 5) AS net_hi FROM w""",
)
def false_merge_bands(spark: SparkSession, d: str) -> DataFrame:
    """Rate of false merges per band, empty bands kept, less the bound of contamination where names collide."""
    spine = spark.createDataFrame([(b,) for b in ("unique", "low", "medium", "high")], "band string")
    c = judged(spark, d).where("arm = 'alpha'").groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "FALSE_MERGE").alias("k"))
    i = spine.join(c, "band", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("i", stats.wilson(F.coalesce("k", F.lit(0)), F.col("n")))
    rounded = i.select("band", "n", F.struct(F.round("i.point", 6).alias("point"), F.round("i.lo", 6).alias("lo"), F.round("i.hi", 6).alias("hi")).alias("i"))
    net = rounded.withColumn("m", stats.net_of(F.col("i"), F.when(F.col("band") == "unique", 0.0).otherwise(0.12764)))
    return net.select("band", "n", F.col("i.point").alias("rate"), F.round("m.lo", 5).alias("net_lo"), F.round("m.hi", 5).alias("net_hi"))


@REG.add(
    "false_merge_verdict",
    f"""WITH {_RESOLVED}, c AS (SELECT CASE band WHEN 'unique' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS i, round(avg(CASE WHEN outcome = 'FALSE_MERGE' THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS rate, count(*) FILTER (WHERE outcome = 'FALSE_MERGE') AS fm, count(*) AS n, count(*) FILTER (WHERE outcome = 'FALSE_MERGE') AS k FROM judged WHERE arm = 'alpha' GROUP BY band),
p AS (SELECT *, lag(rate) OVER (ORDER BY i) AS prev, {_W['lo']} - CASE WHEN i = 0 THEN 0.0::DOUBLE ELSE 0.12764 END AS net_lo FROM c),
v AS (SELECT coalesce(sum(fm), 0) > 0 AS any_false_merge, coalesce(bool_and(prev IS NULL OR prev <= rate), true) AND count(DISTINCT rate) > 1 AS rises, coalesce(bool_and(net_lo <= 0), true) AS every_interval_has_zero FROM p)
SELECT *, NOT rises OR every_interval_has_zero AS falsified FROM v""",
)
def false_merge_verdict(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    i = F.when(F.col("band") == "unique", 0).when(F.col("band") == "low", 1).when(F.col("band") == "medium", 2).otherwise(3)
    c = judged(spark, d).where("arm = 'alpha'").groupBy(i.alias("i")).agg(F.round(F.avg(F.when(F.col("outcome") == "FALSE_MERGE", 1.0).otherwise(0.0)), 6).alias("rate"), F.count_if(F.col("outcome") == "FALSE_MERGE").alias("fm"), F.count(F.lit(1)).alias("n"))
    prev = F.lag("rate").over(Window.orderBy("i"))  # four bands
    lower = F.round(stats.wilson(F.col("fm"), F.col("n"))["lo"], 6) - F.when(F.col("i") == 0, 0.0).otherwise(0.12764)
    p = c.withColumn("prev", prev).withColumn("net_lo", lower)
    v = p.agg((F.coalesce(F.sum("fm"), F.lit(0)) > 0).alias("any_false_merge"), (F.coalesce(F.bool_and(F.col("prev").isNull() | (F.col("prev") <= F.col("rate"))), F.lit(True)) & (F.count_distinct("rate") > 1)).alias("rises"), F.coalesce(F.bool_and(F.col("net_lo") <= 0), F.lit(True)).alias("every_interval_has_zero"))
    return v.withColumn("falsified", ~F.col("rises") | F.col("every_interval_has_zero"))


# --- calibration --------------------------------------------------------------------------------------------------

_REC = f"{_RESOLVED}, rec AS (SELECT task_id, arm, confidence, outcome = 'CORRECT' AS correct FROM judged)"
_BINS = "bins AS (SELECT i AS bin, i / 10.0::DOUBLE AS lo, (i + 1) / 10.0::DOUBLE AS hi FROM range(10) r(i))"
_DIAGRAM = f"{_REC}, {_BINS}, diagram AS (SELECT bin, lo, hi, count(confidence) AS n, avg(confidence) AS mc, avg(CASE WHEN correct THEN 1.0::DOUBLE WHEN NOT correct THEN 0.0 END) AS acc FROM bins LEFT JOIN rec ON confidence >= lo AND (confidence < hi OR bin = 9) GROUP BY ALL)"


def records(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).select("task_id", "arm", "confidence", (F.col("outcome") == "CORRECT").alias("correct"))


@REG.add("reliability_bins", f"WITH {_DIAGRAM} SELECT bin, n, round(mc, 6) AS mean_confidence, round(acc, 6) AS accuracy FROM diagram")
def reliability_bins(spark: SparkSession, d: str) -> DataFrame:
    return metrics.reliability(records(spark, d)).select("bin", "n", F.round("mean_confidence", 6).alias("mean_confidence"), F.round("accuracy", 6).alias("accuracy"))


@REG.add("calibration_error", f"WITH {_DIAGRAM} SELECT sum(n)::BIGINT AS n, count(*) FILTER (WHERE n = 0) AS empty_bins, round(coalesce(sum(n * abs(mc - acc)) / sum(n), 0.0), 6) AS ece FROM diagram")
def calibration_error(spark: SparkSession, d: str) -> DataFrame:
    return metrics.ece(metrics.reliability(records(spark, d)))


@REG.add("brier_score", f"WITH {_REC} SELECT round(coalesce(avg(pow(confidence - CASE WHEN correct THEN 1.0 ELSE 0.0 END, 2)), 0.0), 6) AS brier FROM rec")
def brier_score(spark: SparkSession, d: str) -> DataFrame:
    return metrics.brier(records(spark, d))


@REG.add("risk_coverage", f"WITH {_REC}, t AS (SELECT i / 20.0::DOUBLE AS threshold FROM range(21) r(i)), k AS (SELECT threshold, count(confidence) FILTER (WHERE confidence >= threshold) AS a, count(*) FILTER (WHERE confidence >= threshold AND NOT correct) AS b, count(*) AS n FROM t CROSS JOIN rec GROUP BY threshold) SELECT threshold, coalesce(round(a::DOUBLE / n, 6), 0.0) AS coverage, coalesce(round(b::DOUBLE / nullif(a, 0), 6), 0.0) AS risk, a AS n_answered, n AS n_total FROM k")
def risk_coverage(spark: SparkSession, d: str) -> DataFrame:
    return metrics.risk_coverage(records(spark, d))


_OBS = f"{_RESOLVED}, obs AS (SELECT arm, (date '2026-06-30' - truth_filed)::BIGINT AS delta, outcome = 'CORRECT' AS hit FROM judged WHERE truth_filed IS NOT NULL)"


def observations(spark: SparkSession, d: str) -> DataFrame:
    delta = F.date_diff(F.lit("2026-06-30").cast("date"), F.col("truth_filed")).cast("bigint")
    return judged(spark, d).where("truth_filed IS NOT NULL").select("arm", delta.alias("delta"), (F.col("outcome") == "CORRECT").alias("hit"))


@REG.add(
    "reflection_bins",
    f"WITH {_OBS}, s(label, a, b) AS (VALUES ('0-90d', 0, 90), ('90-365d', 90, 365), ('365-1095d', 365, 1095), ('1095-2555d', 1095, 2555), ('2555-infd', 2555, 1000000000)), c AS (SELECT label, count(delta) AS n, count(*) FILTER (WHERE hit) AS k FROM s LEFT JOIN obs ON delta >= a AND delta < b GROUP BY label) SELECT label, n, {_W['point']} AS point, {_W['lo']} AS lo, {_W['hi']} AS hi FROM c",
)
def reflection_bins(spark: SparkSession, d: str) -> DataFrame:
    return metrics.binned_rates(observations(spark, d))


# max over starts of min over ends of the mean between: the pooled value at a day
_PAVA = f"""{_OBS}, days AS (SELECT arm, delta, sum(hit::INT)::BIGINT AS s, count(*) AS c FROM obs GROUP BY ALL), cum AS (SELECT arm, delta, s, c, sum(s) OVER w AS cs, sum(c) OVER w AS cc FROM days WINDOW w AS (PARTITION BY arm ORDER BY delta)),
means AS (SELECT i.arm, i.delta AS di, j.delta AS dj, (j.cs - i.cs + i.s)::DOUBLE / (j.cc - i.cc + i.c) AS m FROM cum i JOIN cum j ON i.arm = j.arm AND j.delta >= i.delta),
suffix AS (SELECT arm, di, dj, min(m) OVER (PARTITION BY arm, di ORDER BY dj ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM means),
fit AS (SELECT arm, dj AS delta, max(m) AS prob FROM suffix GROUP BY arm, dj), stepped AS (SELECT *, lag(prob) OVER (PARTITION BY arm ORDER BY delta) AS p FROM fit)"""


@REG.add("reflection_curve", f"WITH {_PAVA} SELECT arm, delta, round(prob, 6) AS prob FROM stepped WHERE p IS NULL OR prob > p + 1e-9")
def reflection_curve(spark: SparkSession, d: str) -> DataFrame:
    """Days at which the monotone estimate rises; equal neighbours are one step here."""
    from pyspark.sql import Window

    steps = metrics.pava(observations(spark, d), "arm")
    before = F.lag("prob").over(Window.partitionBy("arm").orderBy("delta"))
    return steps.withColumn("p", before).where("p IS NULL OR prob > p + 1e-9").select("arm", "delta", F.round("prob", 6).alias("prob"))


@REG.add("curve_facts", f"WITH {_PAVA} SELECT arm, CAST(min(delta) FILTER (WHERE prob >= 0.5) AS VARCHAR) AS median_lag, bool_and(p IS NULL OR p <= prob + 1e-12) AS is_monotone FROM stepped GROUP BY arm")
def curve_facts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.curve_facts(metrics.pava(observations(spark, d), "arm"), "arm").withColumn("median_lag", F.col("median_lag").cast("string"))


@REG.add("reflected_at", f"WITH {_PAVA}, pts AS (SELECT DISTINCT arm, day FROM obs, (SELECT unnest([30, 1000, 3000, 6000])::BIGINT AS day)) SELECT pts.arm, day, round(coalesce(max(prob) FILTER (WHERE delta <= day), 0.0), 6) AS prob FROM pts LEFT JOIN fit ON fit.arm = pts.arm GROUP BY ALL")
def reflected_at(spark: SparkSession, d: str) -> DataFrame:
    """The curve's value at given days: the last step at or before, else 0."""
    obs = observations(spark, d)
    pts = obs.select("arm").distinct().withColumn("day", F.explode(F.array(*[F.lit(x).cast("bigint") for x in (30, 1000, 3000, 6000)])))
    got = metrics.step_at(pts, "day", metrics.pava(obs, "arm"), "delta", "prob", "arm", "prob", F.lit(0.0))
    return got.select("arm", "day", F.round("prob", 6).alias("prob"))


@REG.add(
    "recalibrated",
    f"""WITH {_REC}, sp AS (SELECT *, CASE WHEN {q.hex_int('task_id')} % 10 < 6 THEN 'train' ELSE 'other' END AS split FROM rec),
tr AS (SELECT arm, confidence AS x, correct::INT::DOUBLE AS k, row_number() OVER (PARTITION BY arm ORDER BY confidence, task_id) AS i FROM sp WHERE split = 'train' AND confidence IS NOT NULL AND correct IS NOT NULL),
cum AS (SELECT *, sum(k) OVER (PARTITION BY arm ORDER BY i) AS cs FROM tr),
m AS (SELECT a.arm, a.i AS s, b.i AS e, (b.cs - a.cs + a.k) / (b.i - a.i + 1) AS m FROM cum a JOIN cum b ON a.arm = b.arm AND b.i >= a.i),
above AS (SELECT arm, e AS i, max(m) AS a FROM m GROUP BY ALL), below AS (SELECT arm, s AS i, min(m) AS b FROM m GROUP BY ALL),
suffix AS (SELECT arm, e, min(m) OVER (PARTITION BY arm, s ORDER BY e ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM m), fit AS (SELECT arm, e AS i, max(m) AS y FROM suffix GROUP BY ALL),
steps AS (SELECT tr.arm, tr.x, fit.y FROM tr JOIN fit USING (arm, i) JOIN above USING (arm, i) LEFT JOIN below ON below.arm = tr.arm AND below.i = tr.i + 1 WHERE b IS NULL OR a <= b),
low AS (SELECT arm, min(y) AS y0 FROM steps GROUP BY arm)
SELECT r.task_id, r.arm, round(coalesce(max(s.y), any_value(low.y0), any_value(r.confidence)), 6) AS recalibrated FROM sp r LEFT JOIN steps s ON s.arm = r.arm AND s.x <= r.confidence LEFT JOIN low ON low.arm = r.arm WHERE r.split <> 'train' GROUP BY r.task_id, r.arm""",
)
def recalibrated(spark: SparkSession, d: str) -> DataFrame:
    """Confidence after an isotonic fit on the training tasks, for the others."""
    from attestry.operators.splitting import task_split

    rec = records(spark, d).withColumn("split", task_split(F.col("task_id")))
    steps = metrics.isotonic(rec.where("split = 'train'"), "arm", "task_id")
    last = steps.groupBy("arm", "x").agg(F.max("y").alias("y"))  # of blocks at one confidence the last is the highest
    first = steps.groupBy("arm").agg(F.min_by("y", F.struct("x", "y")).alias("y0"))
    got = metrics.step_at(rec.where("split <> 'train'").join(first, "arm", "left"), "confidence", last, "x", "y", "arm", "p", F.coalesce("y0", "confidence"))
    return got.select("task_id", "arm", F.round("p", 6).alias("recalibrated"))


# --- contrasts ----------------------------------------------------------------------------------------------------


@REG.add("paired_tasks", f"WITH {_RESOLVED}, kept AS (SELECT task_id, arm FROM judged WHERE NOT (arm = 'beta' AND outcome = 'ABSTAIN')) SELECT task_id, arm FROM kept WHERE task_id IN (SELECT task_id FROM kept GROUP BY task_id HAVING count(DISTINCT arm) = 3)")
def paired_tasks(spark: SparkSession, d: str) -> DataFrame:
    kept = judged(spark, d).where("NOT (arm = 'beta' AND outcome = 'ABSTAIN')").select("task_id", "arm")
    return sampling.paired(kept, "task_id", "arm")


def differences(spark: SparkSession, d: str) -> DataFrame:
    rec = judged(spark, d).select("task_id", "arm", F.when(F.col("outcome") == "CORRECT", 1.0).otherwise(0.0).alias("hit"))
    return sampling.contrasts(rec, "task_id", "arm", "hit")


@REG.add("arm_contrasts", f"WITH {_RESOLVED}, h AS (SELECT task_id, arm, (outcome = 'CORRECT')::INT::DOUBLE AS hit FROM judged) SELECT a.arm AS arm_a, b.arm AS arm_b, count(*) AS n, round(avg(a.hit - b.hit), 6) AS diff FROM h a JOIN h b ON a.task_id = b.task_id AND a.arm < b.arm GROUP BY ALL")
def arm_contrasts(spark: SparkSession, d: str) -> DataFrame:
    return differences(spark, d).groupBy("arm_a", "arm_b").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("diff"), 6).alias("diff"))


def _binomial(draws: str, name: str) -> str:
    """SQL: draws (resample, m, p, u, ...) with k, the smallest count whose cumulated probability reaches u."""
    log = "lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1) + k * ln(greatest(p, 1e-300)) + (m - k) * ln(greatest(1 - p, 1e-300))"
    return f"""{name}_d AS ({draws}), {name}_c AS (SELECT m, p, k, sum(exp({log})) OVER (PARTITION BY m, p ORDER BY k) AS cdf FROM (SELECT m, p, unnest(range(m + 1)) AS k FROM (SELECT DISTINCT m, p FROM {name}_d))),
{name} AS (SELECT d.resample, d.m, coalesce(min(c.k), d.m) AS k FROM {name}_d d LEFT JOIN {name}_c c ON c.m = d.m AND c.p = d.p AND c.cdf >= d.u GROUP BY d.resample, d.m)"""


def _u(seed: str, level: str) -> str:
    return q.hex_int(f"sha256('{seed}|' || r.i || '|{level}')") + " / 4294967296.0::DOUBLE"


@REG.add(
    "bootstrap_contrast",
    f"""WITH {_RESOLVED}, h AS (SELECT task_id, arm, (outcome = 'CORRECT')::INT::DOUBLE AS hit FROM judged),
v AS (SELECT a.hit - b.hit AS diff FROM h a JOIN h b USING (task_id) WHERE a.arm = 'alpha' AND b.arm = 'beta'),
n AS (SELECT count(*) AS n, count(*) FILTER (WHERE diff = -1) AS lost, count(*) FILTER (WHERE diff = 0) AS same FROM v),
{_binomial("SELECT r.i AS resample, n AS m, lost::DOUBLE / n AS p, " + _u("11", "-1.0") + " AS u FROM range(10000) r(i), n", "x")},
{_binomial("SELECT r.i AS resample, n - k AS m, same::DOUBLE / (n - lost) AS p, " + _u("11", "0.0") + " AS u FROM range(10000) r(i) JOIN x ON x.resample = r.i, n", "y")},
o AS (SELECT (n - 2 * x.k - y.k)::DOUBLE / n AS m, row_number() OVER (ORDER BY (n - 2 * x.k - y.k)) - 1 AS r FROM x JOIN y USING (resample), n)
SELECT (SELECT round(avg(diff), 6) FROM v) AS point, round(max(m) FILTER (WHERE r = 250), 6) AS lo, round(max(m) FILTER (WHERE r = 9750), 6) AS hi, (SELECT n FROM n) AS n FROM o""",
)
def bootstrap_contrast(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the accuracy difference of two arms over all tasks, resampled 10,000 times."""
    v = differences(spark, d).where("arm_a = 'alpha' AND arm_b = 'beta'")
    return sampling.bootstrap_interval(v.select("diff"))


# --- cache and ledger ---------------------------------------------------------------------------------------------

_ENTRIES = f"{ANSWERS_SQL}, entries AS (SELECT sha256(arm || '|answer|' || task_id || '|2026-06') AS key, seq, arm, task_id, spend_usd * seq AS spend_usd FROM (SELECT arm, task_id, spend_usd, unnest([1, 2]) AS seq, u FROM answers) WHERE seq = 1 OR u % 2 = 0)"


def entries(spark: SparkSession, d: str) -> DataFrame:
    """A store in which half of the keys were written twice."""
    a = answers(spark, d).withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2)))).where("seq = 1 OR u % 2 = 0")
    return a.select(replay.digest(F.col("arm"), F.lit("answer"), F.col("task_id"), F.lit("2026-06")).alias("key"), "seq", "arm", "task_id", (F.col("spend_usd") * F.col("seq")).alias("spend_usd"))


@REG.add("cache_latest", f"WITH {_ENTRIES} SELECT key, seq, arm, round(spend_usd, 6) AS spend_usd FROM entries QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1")
def cache_latest(spark: SparkSession, d: str) -> DataFrame:
    return replay.latest(entries(spark, d)).select("key", "seq", "arm", F.round("spend_usd", 6).alias("spend_usd"))


@REG.add("cache_hits", f"WITH {_ENTRIES}, r AS (SELECT task_id, sha256('delta|answer|' || task_id || '|2026-06') AS k, sha256('alpha|answer|' || task_id || '|2026-06') AS f FROM task) SELECT r.task_id, max(e.seq) FILTER (WHERE e.key = CASE WHEN r.direct THEN r.k ELSE r.f END) AS seq, count(e.key) > 0 AS cached FROM (SELECT *, k IN (SELECT key FROM entries) AS direct FROM r) r LEFT JOIN entries e ON e.key IN (r.k, r.f) GROUP BY r.task_id")
def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """Requests under a new key that fall back to the key of old."""
    key = lambda arm: replay.digest(F.lit(arm), F.lit("answer"), F.col("task_id"), F.lit("2026-06"))
    r = table(spark, d, "task").select("task_id", key("delta").alias("k"), key("alpha").alias("f"))
    return replay.look_up(r, entries(spark, d).select("key", "seq", "spend_usd"), "k", "f").select("task_id", "seq", "cached")


@REG.add("cache_spend", f"WITH {_ENTRIES} SELECT round(coalesce(sum(spend_usd), 0.0), 4) AS total_usd FROM entries")
def cache_spend(spark: SparkSession, d: str) -> DataFrame:
    return replay.total_spend(entries(spark, d))


@REG.add("live_spend", f"WITH {_ENTRIES} SELECT provider, round(sum(usd), 4) AS usd FROM (SELECT CASE arm WHEN 'alpha' THEN 'engine' WHEN 'beta' THEN 'index' ELSE 'gamma' END AS provider, spend_usd AS usd FROM entries UNION ALL SELECT 'engine', 1.25) GROUP BY provider")
def live_spend(spark: SparkSession, d: str) -> DataFrame:
    named = F.when(F.col("arm") == "alpha", "engine_name_only").when(F.col("arm") == "beta", "index_filter").otherwise(F.col("arm"))
    manual = spark.createDataFrame([("engine", 1.25)], "provider string, usd double")
    return replay.live_spend(entries(spark, d), manual, ans.billing_provider(named, ("engine", "index", "floor")))


@REG.add(
    "ledger_skip",
    f"""WITH RECURSIVE {ANSWERS_SQL}, o AS (SELECT arm, task_id, spend_usd, row_number() OVER (PARTITION BY arm ORDER BY task_id) AS i FROM answers),
f AS (SELECT arm, task_id, spend_usd, i, spend_usd <= 1.0 + 1e-9 AS charged, CASE WHEN spend_usd <= 1.0 + 1e-9 THEN spend_usd ELSE 0.0 END AS spent FROM o WHERE i = 1
  UNION ALL SELECT o.arm, o.task_id, o.spend_usd, o.i, f.spent + o.spend_usd <= 1.0 + 1e-9, f.spent + CASE WHEN f.spent + o.spend_usd <= 1.0 + 1e-9 THEN o.spend_usd ELSE 0.0 END FROM f JOIN o ON o.arm = f.arm AND o.i = f.i + 1)
SELECT arm, task_id, charged, spend_usd FROM f""",
)
def ledger_skip(spark: SparkSession, d: str) -> DataFrame:
    calls = answers(spark, d).select("arm", "task_id", "spend_usd")
    return replay.charge(calls, "arm", ["task_id"], "spend_usd", 1.0, stop=False)


@REG.add("ledger_stop", f"WITH {ANSWERS_SQL} SELECT arm, task_id, sum(spend_usd) OVER (PARTITION BY arm ORDER BY task_id) <= 1.0 + 1e-9 AS charged, spend_usd FROM answers")
def ledger_stop(spark: SparkSession, d: str) -> DataFrame:
    """A ledger that ends at the first call beyond its ceiling is a running sum."""
    calls = answers(spark, d).select("arm", "task_id", "spend_usd")
    return replay.charge(calls, "arm", ["task_id"], "spend_usd", 1.0, stop=True)


@REG.add("capped_calls", f"WITH {ANSWERS_SQL} SELECT arm, task_id FROM answers QUALIFY row_number() OVER (PARTITION BY arm ORDER BY task_id) <= 20")
def capped_calls(spark: SparkSession, d: str) -> DataFrame:
    return replay.capped(answers(spark, d).select("arm", "task_id"), "arm", ["task_id"], 20)


# --- bodies -------------------------------------------------------------------------------------------------------

def bodies(spark: SparkSession, d: str, twice: bool = False) -> DataFrame:
    """Reply bodies of the shapes that parsing tells apart; twice: half of them stored two times."""
    a = answers(spark, d).withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2)))).where("seq = 1 OR u % 2 = 0") if twice else answers(spark, d).withColumn("seq", F.lit(1))
    inner = F.to_json(F.struct("person_name", F.col("employer_name").alias("organisation"), F.col("answer_title").alias("role"), (F.col("v") / 50.0).alias("confidence"), (F.col("v") % 2 == 0).alias("affirms")))
    outer = F.to_json(F.struct(inner.alias("answer"), F.struct((F.col("w") / 100.0).alias("total")).alias("costDollars")))
    prose = F.to_json(F.struct(F.lit("She works at Acme.").alias("answer")))
    return a.select("task_id", "arm", "u", "v", "w", "seq", F.when(F.col("u") % 3 == 0, prose).otherwise(outer).alias("body"))


@REG.add("parsed_answers", f"WITH {ANSWERS_SQL} SELECT task_id, arm, CASE WHEN u % 3 <> 0 THEN nullif(person_name, '') END AS person_name, CASE WHEN u % 3 <> 0 THEN nullif(employer_name, '') END AS employer_name, CASE WHEN u % 3 <> 0 THEN answer_title END AS title_text, CASE WHEN u % 3 <> 0 THEN round(least(greatest(v / 50.0::DOUBLE, 0.0), 1.0), 6) END AS confidence FROM answers")
def parsed_answers(spark: SparkSession, d: str) -> DataFrame:
    p = bodies(spark, d).withColumn("p", ans.parse_answer(F.col("body")))
    return p.select("task_id", "arm", "p.person_name", "p.employer_name", "p.title_text", F.round("p.confidence", 6).alias("confidence"))


@REG.add("reparsed_answers", f"WITH {ANSWERS_SQL} SELECT sha256(arm || '|answer|' || task_id || '|2026-06') AS key, CASE WHEN u % 2 = 0 THEN 2 ELSE 1 END AS seq, CASE WHEN u % 3 <> 0 THEN nullif(person_name, '') END AS person_name, CASE WHEN u % 3 <> 0 THEN nullif(employer_name, '') END AS employer_name, CASE WHEN u % 3 <> 0 THEN round(least(greatest(v / 50.0::DOUBLE, 0.0), 1.0), 6) END AS confidence FROM answers")
def reparsed_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers read once more from the bodies that the cache holds, after they were stored without contact fields."""
    b = bodies(spark, d, twice=True).select(replay.digest(F.col("arm"), F.lit("answer"), F.col("task_id"), F.lit("2026-06")).alias("key"), "seq", F.lit("x").alias("work_email"), "body")
    path = scratch(spark, "cache")
    replay.append_stripped(b, path)
    return replay.reparsed(spark.read.parquet(path)).select("key", "seq", "person_name", "employer_name", F.round("confidence", 6).alias("confidence"))


@REG.add("parsed_verdicts", f"WITH {ANSWERS_SQL} SELECT task_id, arm, CAST(CASE WHEN u % 3 <> 0 THEN v % 2 = 0 END AS VARCHAR) AS affirms, CASE WHEN u % 3 <> 0 THEN round(least(v / 50.0::DOUBLE, 1.0), 6) ELSE 0.0 END AS confidence FROM answers")
def parsed_verdicts(spark: SparkSession, d: str) -> DataFrame:
    p = bodies(spark, d).withColumn("p", ans.parse_verdict(F.col("body")))
    return p.select("task_id", "arm", F.col("p.affirms").cast("string").alias("affirms"), F.round("p.confidence", 6).alias("confidence"))


@REG.add("reported_spend", f"WITH {ANSWERS_SQL} SELECT task_id, arm, CASE WHEN u % 3 <> 0 THEN round(w / 100.0::DOUBLE, 6) ELSE 0.005 END AS usd, CASE WHEN u % 3 <> 0 THEN 'reported' ELSE 'list_price_estimate' END AS unit FROM answers")
def reported_spend(spark: SparkSession, d: str) -> DataFrame:
    p = bodies(spark, d).withColumn("p", ans.spend_reported(F.col("body"), "$.costDollars.total", 1.0, 0.005))
    return p.select("task_id", "arm", F.round("p.usd", 6).alias("usd"), "p.unit")


@REG.add("event_props", "SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY event_type")
def event_props(spark: SparkSession, d: str) -> DataFrame:
    """A JSON column read by schema; unknown keys are ignored."""
    e = table(spark, d, "events").withColumn("p", F.from_json("props", "k bigint"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("k"))


_HEAD = rf"nullif(regexp_extract({q.strip("person_name_raw || ', CEO'")}, '^(.*?)(?:[\s\p{{Z}}]*[,|¦][\s\p{{Z}}]*|[\s\p{{Z}}]+-[\s\p{{Z}}]+|$)', 1), '')"


@REG.add("search_results", f"SELECT task_id, {_HEAD} AS person_name, anchor_issuer_name AS employer_name, 'CEO' AS title_text, 0.5::DOUBLE AS confidence, unnest(CASE WHEN collision_degree % 2 = 0 THEN [0, 1] ELSE [0] END)::INT AS rank FROM task")
def search_results(spark: SparkSession, d: str) -> DataFrame:
    """Rows of search replies in either envelope, with rank."""
    t = table(spark, d, "task")
    row = F.struct(F.concat("person_name_raw", F.lit(", CEO")).alias("title"), F.lit(0.5).alias("score"), F.struct(F.lit("CEO").alias("title"), F.col("anchor_issuer_name").alias("company")).alias("person"))
    body = F.when(F.col("collision_degree") % 2 == 0, F.to_json(F.struct(F.struct(F.array(row, row).alias("results")).alias("data")))).otherwise(F.to_json(F.struct(F.array(row).alias("results"))))
    return t.select("task_id", F.explode(ans.parse_search(body)).alias("r")).select("task_id", "r.*")


_STRIPPED = " || ".join(["'{'", "array_to_string(list_filter([CASE WHEN rptowner_title IS NOT NULL THEN '\"detail\": {\"title\": ' || to_json(rptowner_title) || '}' ELSE '\"detail\": {}' END, '\"links\": [{\"label\": \"bio\"}]', CASE WHEN rptownername IS NOT NULL THEN '\"rptownername\": ' || to_json(rptownername) END], lambda x: x IS NOT NULL), ', ')", "'}'"])


@REG.add("contact_stripped", f"SELECT owner_id, {_STRIPPED} AS body FROM reporting_owner")
def contact_stripped(spark: SparkSession, d: str) -> DataFrame:
    """Owner rows as free JSON without contact keys: every key of the fixed set is laid in, at some depth."""
    o = table(spark, d, "reporting_owner")
    keys = sorted(ans.CONTACT_KEYS)
    some = lambda part: [F.col("rptowner_street1").alias(k) for k in keys[part::3]]
    detail = F.struct(*some(1), F.col("rptowner_title").alias("title"))
    links = F.array(F.struct(*some(2), F.lit("bio").alias("label")))
    body = F.to_json(F.struct("rptownername", F.col("rptowner_city").alias("home_address_city"), *some(0), detail.alias("detail"), links.alias("links")))
    return o.select("owner_id", ans.strip_contact_json(body).alias("body"))
