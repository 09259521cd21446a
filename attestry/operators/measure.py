"""Resolving returned names to ids, judging answers by rule, and pricing outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.functions.names import company_name, presented_name

# Outcomes, the confidence from which a wrong person is a false merge, and costs by profile. CORRECT is 0.
OUTCOMES = ("CORRECT", "FALSE_MERGE", "UNSURE_WRONG", "MISS", "ABSTAIN", "STALE")
TAU = 0.5
PROFILES = {
    "recruiter": {"MISS": 1.0, "FALSE_MERGE": 2.0, "UNSURE_WRONG": 1.0, "ABSTAIN": 0.5, "STALE": 1.0},
    "gtm_outbound": {"MISS": 1.0, "FALSE_MERGE": 5.0, "UNSURE_WRONG": 2.0, "ABSTAIN": 0.5, "STALE": 2.0},
    "kyc_sanctions": {"MISS": 3.0, "FALSE_MERGE": 50.0, "UNSURE_WRONG": 10.0, "ABSTAIN": 1.0, "STALE": 5.0},
    "journalism": {"MISS": 1.0, "FALSE_MERGE": 100.0, "UNSURE_WRONG": 20.0, "ABSTAIN": 0.5, "STALE": 3.0},
    "expert_sourcing": {"MISS": 1.0, "FALSE_MERGE": 150.0, "UNSURE_WRONG": 30.0, "ABSTAIN": 0.5, "STALE": 2.0},
}
#: A test of the harness, never a result.
FLAT = {"MISS": 1.0, "FALSE_MERGE": 1.0, "UNSURE_WRONG": 1.0, "ABSTAIN": 1.0, "STALE": 1.0}


def profile_table(spark: SparkSession, flat: bool = False) -> DataFrame:
    """(profile, outcome, cost); the flat profile is only given where it is asked for."""
    every = PROFILES | ({"flat": FLAT} if flat else {})
    return spark.createDataFrame([(p, o, 0.0 if o == "CORRECT" else c[o]) for p, c in every.items() for o in OUTCOMES], "profile string, outcome string, cost double")


def resolve_issuer(answers: DataFrame, issuers: DataFrame) -> DataFrame:
    """answers with employer_cik: the issuer whose company form the employer has, if there is just one."""
    one = issuers.groupBy("company").agg(F.count_distinct("issuer").alias("n"), F.min("issuer").alias("employer_cik")).where("n = 1").drop("n")
    return answers.withColumn("__c", company_name("employer_name")).join(one, F.col("__c") == F.col("company"), "left").drop("__c", "company")


def resolve(answers: DataFrame, presented: DataFrame, issuers: DataFrame, key: str) -> DataFrame:
    """answers with resolved_cik and reason. answers: key, person_name, employer_cik, anchor_issuer_cik.

    A name of one id is that id; of several, the returned employer must leave one. Candidates are counted per name
    before the join, and only answers with an employer and a colliding name meet ids, in an equi-join on name and
    issuer, so a hot name is never expanded.
    """
    count = presented.groupBy("name").agg(F.count(F.lit(1)).alias("n_cand"), F.min("cik").alias("one"))
    named = answers.withColumn("__name", presented_name("person_name")).join(count, F.col("__name") == F.col("name"), "left").drop("name")
    employed = presented.join(issuers, "cik").groupBy("name", "issuer").agg(F.count(F.lit(1)).alias("n_narrow"), F.min("cik").alias("narrow"))
    met = named.join(employed, (F.col("__name") == F.col("name")) & (F.col("employer_cik") == F.col("issuer")), "left").drop("name", "issuer")
    blank = F.coalesce(F.trim("person_name"), F.lit("")) == ""
    reason = (
        F.when(blank, "no_name_returned").when(F.col("n_cand").isNull(), "name_not_in_corpus").when(F.col("n_cand") == 1, "unique_name")
        .when(F.col("employer_cik").isNull(), "colliding_name_no_employer").when(F.col("n_narrow").isNull(), "employer_matches_no_candidate").when(F.col("n_narrow") > 1, "still_ambiguous_after_employer")
        .when(F.col("employer_cik") == F.col("anchor_issuer_cik"), "narrowed_by_anchor").otherwise("narrowed_by_employer")
    )
    out = met.withColumn("reason", reason)
    cik = F.when(F.col("reason") == "unique_name", F.col("one")).when(F.col("reason").isin("narrowed_by_anchor", "narrowed_by_employer"), F.col("narrow"))
    return out.withColumn("resolved_cik", cik).drop("__name", "n_cand", "one", "n_narrow", "narrow")


def judge(abstained: Column, resolved: Column, person: Column, employer: Column, truth_issuer: Column, confidence: Column, tau: float = TAU) -> Column:
    """The outcome of an employment answer; the order of the rules decides. A right person without an employer is a miss."""
    sure = F.coalesce(confidence, F.lit(0.0)) >= tau
    return (
        F.when(F.coalesce(abstained, F.lit(False)), "ABSTAIN").when(resolved.isNull(), "MISS").when(~resolved.eqNullSafe(person), F.when(sure, "FALSE_MERGE").otherwise("UNSURE_WRONG"))
        .when(employer.isNull(), "MISS").when(~employer.eqNullSafe(truth_issuer), "STALE").otherwise("CORRECT")
    )


def judge_expertise(abstained: Column, affirms: Column, polarity: Column, confidence: Column, tau: float = TAU) -> Column:
    """The outcome of a verdict; no verdict is a miss, not a denial, and an unknown polarity fails the query."""
    wrong = F.when(F.coalesce(confidence, F.lit(0.0)) >= tau, "FALSE_MERGE").otherwise("UNSURE_WRONG")
    known = F.when(polarity == "ATTESTED", F.when(affirms, "CORRECT").otherwise("MISS")).when(polarity == "CONSTRUCTED_FALSE", F.when(~affirms, "CORRECT").otherwise(wrong))
    return F.when(F.coalesce(abstained, F.lit(False)), "ABSTAIN").when(affirms.isNull(), "MISS").when(known.isNotNull(), known).otherwise(F.raise_error(F.lit("unknown polarity")))


def atoms(resolved: Column, person: Column, title: Column, truth_title: Column, start: Column, end: Column, period: Column, identity_scored: Column) -> Column:
    """struct(identity, title, window, title_scored, identity_scored, total): which atoms count is the task's matter,
    not the answer's; the window always counts."""
    identity = F.coalesce(resolved == person, F.lit(False))
    title_scored = F.coalesce(truth_title != "UNKNOWN", F.lit(False))
    title_ok = title_scored & F.coalesce(title == truth_title, F.lit(False))
    window = F.coalesce((start <= period) & (end.isNull() | (period <= end)), F.lit(False))
    won = F.when(identity_scored & identity, 1.0).otherwise(0.0) + F.when(title_ok, 1.0).otherwise(0.0) + F.when(window, 1.0).otherwise(0.0)
    scored = F.when(identity_scored, 1.0).otherwise(0.0) + F.when(title_scored, 1.0).otherwise(0.0) + 1.0
    return F.struct(identity.alias("identity"), title_ok.alias("title"), window.alias("window"), title_scored.alias("title_scored"), identity_scored.alias("identity_scored"), (won / scored).alias("total"))


def expected_loss(records: DataFrame, profiles: DataFrame, by: list[str]) -> DataFrame:
    """Mean cost per group and profile. The profile table has six rows a profile."""
    return records.join(F.broadcast(profiles), "outcome").groupBy(*by, "profile").agg(F.round(F.avg("cost"), 6).alias("expected_loss"))


def flat_probe(losses: DataFrame, by: str = "arm") -> DataFrame:
    """One row: whether any profile orders the arms unlike the flat one, ties by name. losses has a row per arm and
    profile, flat among them."""
    ranked = losses.withColumn("r", F.row_number().over(Window.partitionBy("profile").orderBy("expected_loss", by)))
    flat = ranked.where("profile = 'flat'").select(by, F.col("r").alias("rf"))
    return ranked.where("profile <> 'flat'").join(flat, by).agg(F.coalesce(F.bool_or(F.col("r") != F.col("rf")), F.lit(False)).alias("has_power"))


def reward(total: Column, outcome: Column, confidence: Column, spend: Column, budget: float, profile: dict[str, float], brier: float = 0.5, weight: float = 0.3) -> Column:
    """Atoms less a Brier term, the outcome's share of the profile's largest cost, and, if correct, spend."""
    hit = F.when(outcome == "CORRECT", 1.0).otherwise(0.0)
    cost = F.lit(0.0)
    for o, c in profile.items():
        cost = F.when(outcome == o, c / max(profile.values())).otherwise(cost)
    return total - brier * F.pow(confidence - hit, 2) - cost - F.when(outcome == "CORRECT", weight * spend / budget).otherwise(0.0)


def first_answer(answers: Column) -> Column:
    """The answer of rank 1 of a call; NULL if it gave none."""
    return F.get(answers, F.lit(0))


def candidate_behind(candidates: Column, name: Column, employer: Column) -> Column:
    """The first returned row with the committed name and, where one is named, employer; dates come from it alone."""
    return F.get(F.filter(candidates, lambda c: (c["person_name"] == name) & (employer.isNull() | (c["employer_name"] == employer))), F.lit(0))


def outcome_histogram(records: DataFrame, by: str) -> DataFrame:
    """Per group the outcomes by tenth of the stated confidence."""
    return records.groupBy(by, "outcome", F.least(F.floor(F.col("confidence") * 10), F.lit(9)).alias("tenth")).agg(F.count(F.lit(1)).alias("n"))


def describe(records: DataFrame, by: str) -> DataFrame:
    """Per group: abstention rate, precision when answering, mean stated confidence."""
    answered = ~F.col("outcome").isin("ABSTAIN", "MISS")
    hit = F.when(answered, F.when(F.col("outcome") == "CORRECT", 1.0).otherwise(0.0))
    return records.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("outcome") == "ABSTAIN", 1.0).otherwise(0.0)), 6).alias("abstain_rate"), F.round(F.avg(hit), 6).alias("precision_answered"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
