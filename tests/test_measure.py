"""Judging, pricing, calibration, sampling, cache, simulation."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from attestry.operators import measure as m
from attestry.operators import metrics, replay, sampling, scholar, simulate


@pytest.mark.parametrize(
    ("abstained", "resolved", "employer", "conf", "outcome"),
    [(True, "1", "9", 1.0, "ABSTAIN"), (False, None, "9", 1.0, "MISS"), (False, "2", "9", 0.5, "FALSE_MERGE"), (False, "2", "9", 0.49, "UNSURE_WRONG"), (False, "1", None, 1.0, "MISS"), (False, "1", "8", 1.0, "STALE"), (False, "1", "9", 0.0, "CORRECT"), (None, "2", None, None, "UNSURE_WRONG")],
)
def test_judge(spark, abstained, resolved, employer, conf, outcome):
    s = lambda v, t: F.lit(v).cast(t)
    got = spark.range(1).select(m.judge(s(abstained, "boolean"), s(resolved, "string"), F.lit("1"), s(employer, "string"), F.lit("9"), s(conf, "double")).alias("o")).first()["o"]
    assert got == outcome


@pytest.mark.parametrize(("affirms", "polarity", "conf", "outcome"), [(True, "ATTESTED", 0.0, "CORRECT"), (False, "ATTESTED", 0.0, "MISS"), (None, "ATTESTED", 0.0, "MISS"), (False, "CONSTRUCTED_FALSE", 0.0, "CORRECT"), (True, "CONSTRUCTED_FALSE", 0.5, "FALSE_MERGE"), (True, "CONSTRUCTED_FALSE", 0.4, "UNSURE_WRONG")])
def test_judge_expertise(spark, affirms, polarity, conf, outcome):
    got = spark.range(1).select(m.judge_expertise(F.lit(False), F.lit(affirms).cast("boolean"), F.lit(polarity), F.lit(conf)).alias("o")).first()["o"]
    assert got == outcome


def test_unknown_polarity_fails(spark):
    with pytest.raises(Exception, match="polarity"):
        spark.range(1).select(m.judge_expertise(F.lit(False), F.lit(True), F.lit("MAYBE"), F.lit(1.0))).collect()


def test_withholding_dates_never_pays(spark):
    d = lambda x: F.lit(x).cast("date")
    a = lambda start, end: m.atoms(F.lit("1"), F.lit("1"), F.lit("CEO"), F.lit("UNKNOWN"), d(start), d(end), d("2020-01-05"), F.lit(True))
    r = spark.range(1).select(a("2020-01-01", None).alias("x"), a(None, None).alias("y"), a("2020-01-01", "2020-01-02").alias("z")).first()
    assert (r["x"]["total"], r["y"]["total"], r["z"]["total"], r["x"]["title_scored"]) == (1.0, 0.5, 0.5, False)


def test_losses_and_flat_probe(spark):
    rec = spark.createDataFrame([("a", "FALSE_MERGE")] * 1 + [("a", "CORRECT")] * 3 + [("b", "ABSTAIN")] * 2 + [("b", "CORRECT")] * 2, "arm string, outcome string")
    loss = m.expected_loss(rec, m.profile_table(spark, flat=True), ["arm"])
    got = {(r["arm"], r["profile"]): r["expected_loss"] for r in loss.collect()}
    assert got["a", "gtm_outbound"] == 1.25 and got["b", "gtm_outbound"] == 0.25 and got["a", "flat"] == 0.25
    assert m.flat_probe(loss).first()[0] is True
    assert m.expected_loss(rec.where("false"), m.profile_table(spark), ["arm"]).count() == 0


def brute_pava(points):
    days = sorted({d for d, _ in points})
    mean = lambda lo, hi: (sum(h for d, h in points if lo <= d <= hi) / sum(1 for d, _ in points if lo <= d <= hi))
    return {k: max(min(mean(i, j) for j in days if j >= k) for i in days if i <= k) for k in days}


def test_pava_equals_the_closed_form(spark):
    rng = random.Random(5)
    rows = [(f"g{g}", rng.randrange(15), rng.random() < 0.2 + 0.03 * g) for g in range(4) for _ in range(60)]
    steps = metrics.pava(spark.createDataFrame(rows, "g string, delta bigint, hit boolean"), "g").collect()
    for g in range(4):
        own = sorted((s["delta"], s["prob"]) for s in steps if s["g"] == f"g{g}")
        for k, v in brute_pava([(d, h) for x, d, h in rows if x == f"g{g}"]).items():
            assert math.isclose(max((p for d, p in own if d <= k), default=0), v, abs_tol=1e-9)
        assert all(a[1] <= b[1] + 1e-12 for a, b in itertools.pairwise(own))


def test_isotonic_places_pools_at_their_right_edge(spark):
    rec = spark.createDataFrame([("a", 0.1, True, 1), ("a", 0.2, False, 2), ("a", 0.9, True, 3)], "arm string, confidence double, correct boolean, id int")
    assert sorted((r["x"], r["y"]) for r in metrics.isotonic(rec, "arm", "id").collect()) == [(0.2, 0.5), (0.9, 1.0)]


def test_reliability_edges(spark):
    below = math.nextafter(0.9, 0)
    rec = spark.createDataFrame([(below, True), (0.9, False), (1.0, True), (0.0, False)], "confidence double, correct boolean")
    n = {r["bin"]: r["n"] for r in metrics.reliability(rec).collect()}
    assert n == {0: 1, 8: 1, 9: 2} | {i: 0 for i in range(1, 8)}
    assert metrics.ece(metrics.reliability(rec.where("false"))).first()["ece"] == 0.0
    assert metrics.brier(rec.where("false")).first()[0] == 0.0
    with pytest.raises(Exception, match="outside"):
        metrics.reliability(spark.createDataFrame([(1.5, True)], "confidence double, correct boolean")).collect()


def test_risk_coverage_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(round(rng.random(), 2), rng.random() < 0.5) for _ in range(80)]
    for r in metrics.risk_coverage(spark.createDataFrame(rows, "confidence double, correct boolean")).collect():
        kept = [k for c, k in rows if c >= r["threshold"]]
        assert r["n_answered"] == len(kept) and math.isclose(r["risk"], sum(not k for k in kept) / len(kept) if kept else 0.0, abs_tol=1e-6)


def test_binned_rates_keep_empty_spans(spark):
    got = metrics.binned_rates(spark.createDataFrame([(5, True), (90, False)], "delta bigint, hit boolean")).collect()
    assert sorted((r["label"], r["n"], r["point"]) for r in got) == [("0-90d", 1, 1.0), ("1095-2555d", 0, None), ("2555-infd", 0, None), ("365-1095d", 0, None), ("90-365d", 1, 0.0)]


def test_samples_repeat_and_strata_are_equal(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") < 2900, "hot").when(F.col("id") < 2995, "warm").otherwise("cold").alias("s"))
    a = sampling.stratified(df, "id", "s", 90)
    assert {r["s"]: r["count"] for r in a.groupBy("s").count().collect()} == {"hot": 30, "warm": 30, "cold": 5}
    assert sorted(r["id"] for r in a.collect()) == sorted(r["id"] for r in sampling.stratified(df.repartition(7), "id", "s", 90).collect())
    rank = {r["id"]: i for i, r in enumerate(df.where("s = 'hot'").orderBy(sampling.draw(11, F.col("id")), "id").limit(30).collect())}
    assert {r["id"] for r in a.where("s = 'hot'").collect()} == set(rank)
    assert sampling.stratified(df.where("false"), "id", "s", 90).count() == 0


def test_bootstrap(spark):
    v = spark.createDataFrame([(i, 1.0 if i % 4 else -1.0) for i in range(40)], "idx bigint, diff double")
    r = sampling.bootstrap_interval(v, 400).first()
    assert r["point"] == 0.5 and r["lo"] < 0.5 < r["hi"] and r["n"] == 40
    assert tuple(sampling.bootstrap_interval(v.where("false")).first()) == (0.0, 0.0, 0.0, 0)


def test_pairs(spark):
    rec = spark.createDataFrame([("t1", "a", 1.0), ("t1", "b", 0.0), ("t2", "a", 1.0)], "task string, arm string, v double")
    assert {r["task"] for r in sampling.paired(rec, "task", "arm").collect()} == {"t1"}
    assert [tuple(r) for r in sampling.contrasts(rec, "task", "arm", "v").collect()] == [("a", "b", "t1", 1.0)]


def test_cache(spark, tmp_path):
    e = spark.createDataFrame([("k", 1, 0.1), ("k", 2, 0.2), ("old", 1, 0.3)], "key string, seq int, spend_usd double")
    assert {(r["key"], r["seq"]) for r in replay.latest(e).collect()} == {("k", 2), ("old", 1)}
    q = spark.createDataFrame([(1, "k", "old"), (2, "x", "old"), (3, "x", "y")], "id int, key2 string, f string")
    assert {r["id"]: (r["cached"], r["seq"]) for r in replay.look_up(q, e, "key2", "f").collect()} == {1: (True, 2), 2: (True, 1), 3: (False, None)}
    replay.append(e, str(tmp_path / "c"))
    replay.append(e, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 6
    with pytest.raises(ValueError):
        replay.append(e.withColumn("email", F.lit("x")), str(tmp_path / "c"))


def test_ledger_skips_or_stops(spark):
    calls = spark.createDataFrame([("a", 1, 0.6), ("a", 2, 0.5), ("a", 3, 0.4), ("b", 1, 2.0)], "arm string, i int, p double")
    got = lambda stop: {(r["arm"], r["i"]): r["charged"] for r in replay.charge(calls, "arm", ["i"], "p", 1.0, stop).collect()}
    assert got(False) == {("a", 1): True, ("a", 2): False, ("a", 3): True, ("b", 1): False}
    assert got(True) == {("a", 1): True, ("a", 2): False, ("a", 3): False, ("b", 1): False}


def test_fit_refuses_other_splits_and_falls_back(spark):
    obs = spark.createDataFrame([("p", "q", "low", "CORRECT", 0.8, 0.1)] * 6 + [("p", "q", "high", "MISS", 0.2, 0.1)], "provider string, action string, band string, outcome string, confidence double, spend_usd double")
    with pytest.raises(ValueError):
        simulate.fit(obs, "test")
    cells = simulate.checked(simulate.fit(obs))
    assert cells.count() == 2
    rows = spark.createDataFrame([("p", "q", "low"), ("p", "q", "high")], "provider string, action string, band string")
    assert {r["band"]: (r["pooled"], r["n"]) for r in simulate.cell_for(rows, cells).collect()} == {"low": (False, 6), "high": (True, 7)}


def test_abstaining_never_beats_the_gold_and_nothing_stalls():
    gold = {"task_id": "t", "p_correct": 1.0, "p_stale": 0.0, "p_wrong": 0.0, "mean_confidence": 0.9}
    ep = simulate.Episode(gold)
    ep.step(("query", None), simulate.cell_answer(1))
    ep.step(("answer", 1.0), simulate.cell_answer(1))
    idle = simulate.Episode(gold, budget=0.0)
    while not idle.step(("query", None), simulate.cell_answer(1)):
        pass
    assert ep.record["outcome"] == "CORRECT" and idle.record["outcome"] == "ABSTAIN" and idle.turns == idle.cap and ep.record["reward"] > idle.record["reward"]
    with pytest.raises(RuntimeError):
        ep.step(("abstain", None), simulate.cell_answer(1))


def test_verdict_reasons(spark):
    rows = [("few", i, 1.0, 0.0) for i in range(2)] + [("bad", i, 0.1 * i, 1.0) for i in range(3)] + [("noise", i, float(i), 0.5) for i in range(3)] + [("good", i, 1 + 0.01 * i, 0.0) for i in range(4)]
    got = {r["arm"]: r["reason"] for r in simulate.verdict(spark.createDataFrame(rows, "arm string, seed int, score double, baseline double")).collect()}
    assert got == {"few": "too few seeds", "bad": "no better than the baseline", "noise": "margin exceeds the spread" if 1.0 < 0.5 else "margin is seed noise", "good": "margin exceeds the spread"}


def test_institutions_and_citations(spark):
    known = spark.createDataFrame([("Alpha University", 1, [9]), ("Beta College", 2, [1])], "name string, institution_id bigint, lineage array<bigint>")
    rows = spark.createDataFrame([(1, "Dept of X, Alpha University"), (2, "beta college"), (3, "??"), (4, None)], "id bigint, inst string")
    assert {r["id"]: r["institution_id"] for r in scholar.resolve_institution(rows, "id", "inst", known).collect()} == {1: 1, 2: 2, 3: None, 4: None}
    works = spark.createDataFrame([(1, "A long enough title"), (2, "Another fine title")], "author bigint, title string")
    said = spark.createDataFrame([("x", 1, ["nope, not it at all", "a LONG enough, title!"]), ("y", 1, ["another fine title"]), ("z", 1, ["short"]), ("e", 1, [])], "key string, author bigint, citations array<string>")
    assert {r["key"]: r["verdict"] for r in scholar.citation_audit(said, works).collect()} == {"x": "backed", "y": "exists", "z": "none", "e": "none"}


def test_few_scored_rows_give_no_verdict(spark):
    v = spark.createDataFrame([("a", i, 1.0) for i in range(120)] + [("b", i, 0.0) for i in range(120)], "side string, idx bigint, value double")
    assert tuple(sampling.unpaired_interval(v, 200).first()) == (1.0, 1.0, 1.0, "separates")
    assert sampling.unpaired_interval(v.where("side = 'a' OR idx < 50"), 200).first()["verdict"] == "none"


def test_dates_come_from_the_candidate_alone(spark):
    c = spark.sql("SELECT array(named_struct('person_name', 'A', 'employer_name', 'X', 'd', 1), named_struct('person_name', 'A', 'employer_name', 'Y', 'd', 2)) AS c")
    pick = lambda n, e: c.select(m.candidate_behind(F.col("c"), F.lit(n), F.lit(e).cast("string")).alias("r")).first()["r"]
    assert pick("A", "Y")["d"] == 2 and pick("A", None)["d"] == 1 and pick("B", None) is None
    assert c.select(m.first_answer(F.slice("c", 1, 0)).alias("r")).first()["r"] is None


def test_dense_index_has_no_gaps(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"))
    got = sampling.dense_index(df, "id", ["g"]).collect()
    for g in range(3):
        assert sorted(r["idx"] for r in got if r["g"] == g) == list(range(sum(r["g"] == g for r in got)))
    assert sampling.dense_index(df.where("false"), "id").count() == 0


def test_contrasts_resample_ten_thousand_times(spark, monkeypatch):
    v = spark.createDataFrame([(i, float(i % 3 - 1), "ab"[i % 2]) for i in range(400)], "idx bigint, diff double, side string")
    made, means = [], sampling.resampled_means
    monkeypatch.setattr(sampling, "resampled_means", lambda rows, value, n, resamples, seed: made.append(resamples) or means(rows, value, n, resamples, seed))
    r = sampling.bootstrap_interval(v).first()
    half = 1.96 * math.sqrt(2 / 3 / 400)
    assert abs(r["hi"] - r["point"] - half) < 0.01 and abs(r["point"] - r["lo"] - half) < 0.01
    assert sampling.unpaired_interval(v.withColumnRenamed("diff", "value")).first()["verdict"] == "cannot separate"
    assert made == [10_000] * 3


def test_checkpoints_are_scored_on_every_hill_climb_task(spark):
    rows = [(f"a{i}", "train", 0.6, 0.1, 0.2, 0.8) for i in range(6)] + [(f"b{i}", "hillclimb", 0.1 * (i % 9), 0.1, 0.1, 0.7) for i in range(40)]
    t = spark.createDataFrame(rows, "task_id string, split string, p_correct double, p_stale double, p_wrong double, mean_confidence double")
    got = simulate.train(t, seeds=1, epochs=1, group=2, study_tasks=4).first()
    played = simulate.play(t.where("split = 'hillclimb'"), "p", got["weights"], seed=0).agg(F.avg("reward"), F.count(F.lit(1))).first()
    assert played[1] == 40 and abs(played[0] - got["score"]) < 1e-9


def test_binomial_quantiles_against_exact_sums():
    import numpy as np

    for n, p in ((1, 0.5), (7, 0.1), (40, 0.75), (300, 0.02)):
        exact = [sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)) for k in range(n + 1)]
        u = np.linspace(0.0003, 0.9997, 301)
        assert sampling.binomial_quantile(n, p, u).tolist() == [next((k for k, c in enumerate(exact) if c >= x), n) for x in u]
    assert sampling.binomial_quantile(5, 0.0, u).max() == 0 and sampling.binomial_quantile(5, 1.0, u).min() == 5
    big = sampling.binomial_quantile(10**9, 0.3, np.array([0.025, 0.5, 0.975]))
    dev = math.sqrt(10**9 * 0.21)
    assert abs(big[1] - 3 * 10**8) < 2 and abs(big[2] - big[0] - 2 * 1.96 * dev) < 0.01 * dev


def test_resampled_means_have_the_right_spread(spark):
    v = spark.createDataFrame([(float(x),) for x in [-1] * 30 + [0] * 50 + [1] * 20] + [(None,)] * 10, "diff double")
    got = [r["m"] for r in sampling.resampled_means(v, "diff", 110, 4000, 3).collect()]
    mean, var = sum(got) / 4000, sum(x * x for x in got) / 4000 - (sum(got) / 4000) ** 2
    assert len(got) == 4000 and abs(mean + 0.1) < 0.01 and abs(var - 0.49 / 100) < 0.0006


def test_health_histogram_and_strata(spark):
    rates = spark.createDataFrame([("a", 0.0), ("b", 0.5), ("c", 1.0), ("d", 0.8)], "task_id string, rate double")
    assert tuple(simulate.solve_health(rates).first()) == (4, 0.5, 0.5)
    rec = spark.createDataFrame([("x", "CORRECT", 1.0), ("x", "CORRECT", 0.99), ("x", "MISS", 0.0)], "arm string, outcome string, confidence double")
    assert {(r["outcome"], r["tenth"]): r["n"] for r in m.outcome_histogram(rec, "arm").collect()} == {("CORRECT", 9): 2, ("MISS", 0): 1}
    v = spark.createDataFrame([("s", "backed")] * 3 + [("s", "none"), ("t", "exists")], "stratum string, verdict string")
    assert {r["stratum"]: (r["n"], r["n_backed"], r["backed_rate"]) for r in scholar.audit_strata(v, "stratum").collect()} == {"s": (4, 3, 0.75), "t": (1, 0, 0.0)}


def test_attempts_at_a_task_differ(spark):
    t = spark.createDataFrame([(f"t{i}", 0.5, 0.1, 0.1, 0.8) for i in range(60)], "task_id string, p_correct double, p_stale double, p_wrong double, mean_confidence double")
    got = simulate.rollouts(t, "never_verify", None, runs=5, scripted="never_verify")
    by = simulate.solve_rates(got).collect()
    assert got.count() == 300 and len({r["rate"] for r in by}) > 3 and 0.4 < sum(r["rate"] for r in by) / 60 < 0.6


def test_a_store_is_stripped_and_read_again(spark, tmp_path):
    body = '{"answer": "{\\"person_name\\": \\"A\\", \\"organisation\\": \\"B\\"}", "url": "SENTINEL"}'
    e = spark.createDataFrame([("k", 1, "prose", "SENTINEL", ("SENTINEL", 3)), ("k", 2, body, "SENTINEL", ("SENTINEL", 4))], "key string, seq int, body string, phone string, meta struct<home_email: string, n: int>")
    replay.append_stripped(e, str(tmp_path / "s"))
    got = spark.read.parquet(str(tmp_path / "s"))
    assert got.columns == ["key", "seq", "body", "meta"] and not any("SENTINEL" in str(r) for r in got.collect())
    assert [(r["seq"], r["person_name"], r["employer_name"], r["meta"]["n"]) for r in replay.reparsed(got).collect()] == [(2, "A", "B", 4)]
    q = spark.createDataFrame([("zz",)], "key string")
    with pytest.raises(ValueError):
        replay.look_up(q, got.select("key", "seq"), need=True)


def test_a_ledger_without_prices(spark):
    calls = spark.createDataFrame([("a", 1, 0.6), ("a", 2, None), ("a", 3, 0.2)], "arm string, i int, p double")
    got = lambda stop: {r["i"]: r["charged"] for r in replay.charge(calls, "arm", ["i"], "p", 1.0, stop).collect()}
    assert got(False) == {1: True, 2: False, 3: True} and got(True) == {1: True, 2: False, 3: False}
    assert replay.charge(calls.where("false"), "arm", ["i"], "p", 1.0, False).count() == 0
