"""A simulated provider fitted on judged answers, floor policies over it, episodes under a budget, and a linear policy
trained per seed. Everything per task is columnar; only whole episodes and training run in Python workers."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.keys import hash_draw
from attestry.operators.measure import PROFILES, TAU, reward
from attestry.operators.sampling import draw, sample

LEAST_CELL = 5
# Reward weights, the floor policies' confidence, the confidences a policy may state, seeds to claim.
BRIER, SPEND, FLOOR_CONFIDENCE, STATED, LEAST_SEEDS = 0.5, 0.3, 0.9, tuple(i / 10 for i in range(11)), 3


def fit(observations: DataFrame, split: str = "train", least: int = LEAST_CELL) -> DataFrame:
    """Cells per (provider, action, band) with at least so many observations, and the pooled cell (all three NULL).

    Two grouping sets in one pass. Only the train split may be fitted."""
    if split != "train":
        raise ValueError("only the train split may be fitted")
    is_ = lambda *o: F.round(F.avg(F.when(F.col("outcome").isin(*o), 1.0).otherwise(0.0)), 6)
    keys = ["provider", "action", "band"]
    aggs = [F.count(F.lit(1)).alias("n"), is_("CORRECT").alias("p_correct"), is_("STALE").alias("p_stale"), is_("FALSE_MERGE", "UNSURE_WRONG").alias("p_wrong"), is_("MISS", "ABSTAIN").alias("p_miss"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.round(F.avg("spend_usd"), 6).alias("mean_spend_usd"), F.grouping_id().alias("g")]
    cells = observations.groupingSets([[F.col(k) for k in keys], []], *keys).agg(*aggs)
    return cells.where((F.col("g") > 0) | (F.col("n") >= least)).drop("g")


def checked(cells: DataFrame) -> DataFrame:
    """cells, failing on one whose shares do not add up to 1."""
    total = F.col("p_correct") + F.col("p_stale") + F.col("p_wrong") + F.col("p_miss")
    return cells.where(F.assert_true(F.abs(total - 1) <= 1e-5, F.lit("cell probabilities do not sum to 1")).isNull())


def cell_for(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """rows (provider, action, band) with their cell, else the pooled one; without either the query fails. Cells are few:
    one per provider, action and band."""
    cols = [c for c in cells.columns if c not in ("provider", "action", "band")]
    own = cells.where("provider IS NOT NULL").select("provider", "action", "band", F.struct(*cols).alias("__c"))
    pooled = cells.where("provider IS NULL").agg(F.first(F.struct(*cols)).alias("__p"))
    out = rows.join(F.broadcast(own), ["provider", "action", "band"], "left").crossJoin(F.broadcast(pooled))  # pooled: one row
    cell = F.coalesce("__c", "__p", F.raise_error(F.lit("no cell and no fallback")))
    return out.withColumn("pooled", F.col("__c").isNull()).withColumn("__c", cell).select("*", "__c.*").drop("__c", "__p")


def uniform(seed: int | str, *keys: Column) -> Column:
    """A number in [0, 1) from a hash of the seed and the keys."""
    return hash_draw(draw(seed, *keys)) / F.lit(float(1 << 32))


def simulated(rows: DataFrame, key: str, seed: int | str = 11) -> DataFrame:
    """rows that have a cell with what the simulated provider returns: kind is correct, stale, wrong or none."""
    u = uniform(seed, F.col(key))
    stale = F.col("p_correct") + F.col("p_stale")
    kind = F.when(u < F.col("p_correct"), "correct").when(u < stale, "stale").when(u < stale + F.col("p_wrong"), "wrong").otherwise("none")
    return rows.withColumn("u", F.round(u, 9)).withColumn("kind", kind)


def outcome_of(kind: Column, confidence: Column, tau: float = TAU) -> Column:
    return F.when(kind == "correct", "CORRECT").when(kind == "stale", "STALE").when(kind == "wrong", F.when(confidence >= tau, "FALSE_MERGE").otherwise("UNSURE_WRONG")).otherwise("MISS")


def floors(rows: DataFrame, budget: float, price: float, profile: str = "gtm_outbound", deep: int = 3) -> DataFrame:
    """Mean reward and spend of the three floor policies over simulated rows: one query and rank 1, every affordable query
    and rank 1, and abstention. Atoms are what the outcome implies."""
    spent = {"never_verify": price, "always_deep_verify": min(deep, math.floor(budget / price + 1e-9)) * price, "abstain_always": 0.0}
    out = None
    for name, usd in spent.items():
        if name == "abstain_always":
            outcome, conf, total = F.lit("ABSTAIN"), F.lit(0.0), F.lit(0.0)
        else:
            conf = F.greatest(F.col("mean_confidence"), F.lit(FLOOR_CONFIDENCE))
            outcome = outcome_of(F.col("kind"), conf)
            total = F.when(F.col("kind").isin("correct", "stale"), 1.0 / 3).otherwise(0.0)
        row = rows.select(F.lit(name).alias("policy"), outcome.alias("outcome"), reward(total, outcome, conf, F.lit(usd), budget, PROFILES[profile], BRIER, SPEND).alias("reward"), F.lit(usd).alias("spend"))
        out = row if out is None else out.unionByName(row)
    return out.groupBy("policy").agg(F.round(F.avg("reward"), 6).alias("mean_reward"), F.round(F.avg("spend"), 6).alias("mean_spend"), F.count_if(F.col("outcome") == "CORRECT").alias("n_correct"))


def confidence_sweep(rows: DataFrame, profile: str = "gtm_outbound") -> DataFrame:
    """Mean reward when every answer states one confidence, for each of STATED. The grid is folded into the aggregate, so
    rows are read once and never multiplied."""
    total = F.when(F.col("kind").isin("correct", "stale"), 1.0 / 3).otherwise(0.0)
    means = [F.avg(reward(total, outcome_of(F.col("kind"), F.lit(c)), F.lit(c), F.lit(0.0), 1.0, PROFILES[profile], BRIER, SPEND)).alias(f"m{i}") for i, c in enumerate(STATED)]
    one = rows.agg(*means)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("confidence"), F.round(f"m{i}", 6).alias("mean_reward")) for i, c in enumerate(STATED)])).alias("x")).select("x.*")


def solve_rates(trajectories: DataFrame) -> DataFrame:
    return trajectories.groupBy("task_id").agg(F.round(F.avg(F.when(F.col("outcome") == "CORRECT", 1.0).otherwise(0.0)), 6).alias("rate"))


def in_band(rates: DataFrame, lo: float = 0.10, hi: float = 0.80) -> DataFrame:
    return rates.where(F.col("rate").between(lo, hi))


def solve_histogram(rates: DataFrame) -> DataFrame:
    """Tasks per tenth of the solve rate."""
    return rates.groupBy(F.least(F.floor(F.col("rate") * 10), F.lit(9)).alias("decile")).agg(F.count(F.lit(1)).alias("n_tasks"))


def solve_health(rates: DataFrame, lo: float = 0.10, hi: float = 0.80) -> DataFrame:
    """One row: tasks, the share whose solve rate lies in the band, and the share of those that are always or never solved,
    whose attempts have no advantage over each other."""
    share = lambda cond: F.round(F.avg(F.when(cond, 1.0).otherwise(0.0)), 6)
    return rates.agg(F.count(F.lit(1)).alias("n_tasks"), share(F.col("rate").between(lo, hi)).alias("share_in_band"), share(F.col("rate").isin(0.0, 1.0)).alias("share_without_advantage"))


def rejection_sample(trajectories: DataFrame, most: int = 2) -> DataFrame:
    """Passing trajectories, the first few of each task by seq, cheapest first: place is the position."""
    r = F.row_number().over(Window.partitionBy("task_id").orderBy("seq"))
    kept = trajectories.where("outcome = 'CORRECT'").withColumn("r", r).where(F.col("r") <= most).drop("r")
    return kept.orderBy("spend_usd", "turns", "task_id", "seq")


def advantage(trajectories: DataFrame, group: list[str], value: str = "reward") -> DataFrame:
    """Rewards less their group's mean, over its population deviation (0 counts as 1). Folded and joined back, so a group
    is never gathered."""
    stats = trajectories.groupBy(*group).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    return trajectories.join(stats, group).withColumn("advantage", F.round((F.col(value) - F.col("__m")) / F.when(F.col("__s") > 1e-12, F.col("__s")).otherwise(1.0), 6)).drop("__m", "__s")


def verdict(scores: DataFrame, least: int = LEAST_SEEDS) -> DataFrame:
    """Per arm: seeds, mean, sample deviation over seeds, margin over the baseline and whether it may be claimed.
    scores: arm, seed, score, baseline."""
    by = scores.groupBy("arm").agg(F.count(F.lit(1)).alias("seeds"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"), F.max("baseline").alias("baseline"))
    sd, margin = F.coalesce("sd", F.lit(float("inf"))), F.col("mean") - F.col("baseline")
    reason = F.when(F.col("seeds") < least, "too few seeds").when(margin <= 0, "no better than the baseline").when(sd >= margin, "margin is seed noise").otherwise("margin exceeds the spread")
    return by.select("arm", "seeds", F.round("mean", 6).alias("mean"), F.round(sd, 6).alias("sd"), F.round(margin, 6).alias("margin"), (reason == "margin exceeds the spread").alias("claimable"), reason.alias("reason"))


# --- episodes -----------------------------------------------------------------------------------------------------


@dataclass
class Episode:
    """One task under a budget and a cap of turns. Refused queries cost a turn, so no policy can stall for ever."""

    task: dict
    budget: float = 1.0
    cap: int = 8
    price: float = 0.05
    turns: int = 0
    spent: float = 0.0
    candidates: list[dict] = field(default_factory=list)
    record: dict | None = None

    def observe(self) -> dict:
        top = self.candidates[0] if self.candidates else {}
        next_ = self.candidates[1] if len(self.candidates) > 1 else {}
        conf, other = top.get("confidence", 0.0), next_.get("confidence", 0.0)
        return {"turns_left": self.cap - self.turns, "budget_left": self.budget - self.spent, "candidates": self.candidates, "affordable": self.spent + self.price <= self.budget + 1e-12, "x": [1.0, (self.cap - self.turns) / self.cap, (self.budget - self.spent) / self.budget, min(len(self.candidates), 5) / 5, float(bool(self.candidates)), min(max(conf, 0.0), 1.0), min(max(conf - other, 0.0), 1.0), float(top.get("kind") in ("correct", "stale", "wrong")), 0.0, float(self.turns > 0)]}

    def step(self, action: tuple[str, float | None], answer: Callable[[dict, int], dict]) -> bool:
        """Whether the episode has ended."""
        if self.record is not None:
            raise RuntimeError("the episode has ended")
        self.turns += 1
        kind, conf = action
        if kind == "query":
            if self.spent + self.price <= self.budget + 1e-12:
                self.spent += self.price
                self.candidates.append(answer(self.task, len(self.candidates)))
            if self.turns >= self.cap:
                self._end("ABSTAIN", 0.0, 0.0)
        elif kind == "abstain":
            self._end("ABSTAIN", 0.0, 0.0)
        elif kind == "answer":
            top = self.candidates[0]["kind"] if self.candidates else "none"
            got = {"correct": "CORRECT", "stale": "STALE", "wrong": "FALSE_MERGE" if conf >= TAU else "UNSURE_WRONG"}.get(top, "MISS")
            self._end(got, float(conf), 1 / 3 if top in ("correct", "stale") else 0.0)
        else:
            raise ValueError(f"unknown action {kind}")
        return self.record is not None

    def _end(self, outcome: str, confidence: float, total: float) -> None:
        costs = PROFILES["gtm_outbound"]
        hit = outcome == "CORRECT"
        value = total - BRIER * (confidence - hit) ** 2 - costs.get(outcome, 0.0) / max(costs.values()) - (SPEND * self.spent / self.budget if hit else 0.0)
        self.record = {"task_id": self.task["task_id"], "outcome": outcome, "reward": value, "spend_usd": self.spent, "turns": self.turns, "confidence": confidence}


def hashed(*parts: object) -> float:
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / (1 << 32)


def cell_answer(seed: int | str) -> Callable[[dict, int], dict]:
    """Answers drawn from the task's cell by a hash of the seed, the task and the number of the query."""

    def answer(task: dict, i: int) -> dict:
        u = hashed(seed, task["task_id"], i)
        a, b, c = task["p_correct"], task["p_correct"] + task["p_stale"], task["p_correct"] + task["p_stale"] + task["p_wrong"]
        kind = "correct" if u < a else "stale" if u < b else "wrong" if u < c else "none"
        return {"kind": kind, "confidence": 0.0 if kind == "none" else task["mean_confidence"]}

    return answer


ACTIONS: tuple[tuple[str, float | None], ...] = (("query", None), ("abstain", None), *[("answer", c) for c in STATED])


class LinearPolicy:
    """Softmax over ACTIONS, linear in ten features."""

    def __init__(self, weights: list[list[float]] | None = None) -> None:
        self.w = weights or [[0.0] * 10 for _ in ACTIONS]

    def shares(self, x: list[float]) -> list[float]:
        z = [sum(a * b for a, b in zip(row, x, strict=True)) for row in self.w]
        e = [math.exp(v - max(z)) for v in z]
        return [v / sum(e) for v in e]

    def pick(self, x: list[float], u: float | None = None) -> int:
        p = self.shares(x)
        if u is None:
            return p.index(max(p))
        for i, share in enumerate(p):
            u -= share
            if u <= 0:
                return i
        return len(p) - 1

    def learn(self, x: list[float], action: int, weight: float, rate: float) -> None:
        """A step along the gradient of the chosen action's log share, times weight."""
        for j, share in enumerate(self.shares(x)):
            g = rate * weight * ((j == action) - share)
            self.w[j] = [w + g * v for w, v in zip(self.w[j], x, strict=True)]


RECORD = "policy string, task_id string, outcome string, reward double, spend_usd double, turns int, confidence double"


def play(tasks: DataFrame, name: str, weights: list[list[float]] | None, seed: int | str = 11, scripted: str | None = None) -> DataFrame:
    """Episode records of a policy over tasks that have a cell: whole episodes in the workers, no shuffle."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        policy, answer = LinearPolicy(weights), cell_answer(seed)
        script = {"never_verify": [("query", None), ("answer", FLOOR_CONFIDENCE)], "abstain_always": [("abstain", None)], "always_deep_verify": [("query", None)] * 3 + [("answer", FLOOR_CONFIDENCE)]}.get(scripted or "")
        for b in batches:
            out = []
            for t in b.to_dict("records"):
                ep, i = Episode(t), 0
                while not ep.step(script[i] if script else ACTIONS[policy.pick(ep.observe()["x"])], answer):
                    i += 1
                out.append({"policy": name, **ep.record})
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RECORD.split(", ")])

    return tasks.mapInPandas(run, RECORD)


def rollouts(tasks: DataFrame, name: str, weights: list[list[float]] | None, runs: int, seed: int | str = 11, scripted: str | None = None) -> DataFrame:
    """Records of so many attempts at every task, each with draws of its own; run tells them apart."""
    out = None
    for k in range(runs):
        got = play(tasks, name, weights, f"{seed}/{k}", scripted).withColumn("run", F.lit(k))
        out = got if out is None else out.unionByName(got)
    return out


def train(tasks: DataFrame, seeds: int, epochs: int = 3, group: int = 4, rate: float = 0.05, study_tasks: int = 2000) -> DataFrame:
    """(seed, best_epoch, score, weights): a policy per seed, trained by cloning a demonstration and then by group-relative
    advantage over tasks that are solved now and then, the epoch kept that does best on the hill-climb tasks, the first
    on ties. tasks: task_id, split and a cell. A policy is fitted on a study of at most study_tasks training tasks, taken by
    hash, which every seed's worker holds; every checkpoint is scored on all hill-climb tasks."""
    spark = tasks.sparkSession
    study = [r.asDict() for r in sample(tasks.where("split = 'train'"), "task_id", study_tasks).collect()]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        seed = int(pdf["seed"].iloc[0])
        policy, answer = LinearPolicy(), cell_answer(seed)
        for t in study:
            ep = Episode(t)
            for a in (0, ACTIONS.index(("answer", 0.9))):
                policy.learn(ep.observe()["x"], a, 1.0, rate)
                ep.step(ACTIONS[a], answer)

        kept = [[r[:] for r in policy.w]]
        for epoch in range(1, epochs + 1):
            for t in study:
                runs = []
                for k in range(group):
                    ep, steps = Episode(t), []
                    while ep.record is None:
                        x = ep.observe()["x"]
                        a = policy.pick(x, hashed(seed, epoch, t["task_id"], k, ep.turns))
                        steps.append((x, a))
                        ep.step(ACTIONS[a], cell_answer(f"{seed}/{epoch}/{k}"))
                    runs.append((ep.record["reward"], steps))
                mean = sum(r for r, _ in runs) / group
                dev = math.sqrt(sum((r - mean) ** 2 for r, _ in runs) / group) or 1.0
                for r, steps in runs:
                    for x, a in steps:
                        policy.learn(x, a, (r - mean) / dev, rate)
            kept.append([r[:] for r in policy.w])
        return pd.DataFrame({"seed": seed, "epoch": range(len(kept)), "weights": kept})

    frame = spark.range(seeds).select(F.col("id").alias("seed"))
    made = frame.groupBy("seed").applyInPandas(one, "seed bigint, epoch int, weights array<array<double>>").collect()  # a row per seed and epoch

    def score(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, climb = [], b.to_dict("records")
            for r in made:
                policy, answer, total = LinearPolicy(r["weights"]), cell_answer(r["seed"]), 0.0
                for t in climb:
                    ep = Episode(t)
                    while not ep.step(ACTIONS[policy.pick(ep.observe()["x"])], answer):
                        pass
                    total += ep.record["reward"]
                rows.append((r["seed"], r["epoch"], total, len(climb)))
            yield pd.DataFrame(rows, columns=["seed", "epoch", "total", "n"])

    got = tasks.where("split = 'hillclimb'").mapInPandas(score, "seed bigint, epoch int, total double, n bigint")
    means = got.groupBy("seed", "epoch").agg((F.sum("total") / F.sum("n")).alias("score"))
    points = spark.createDataFrame(made, "seed bigint, epoch int, weights array<array<double>>").join(means, ["seed", "epoch"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    best = points.groupBy("seed").agg(F.max_by(F.struct("epoch", "score", "weights"), F.struct("score", -F.col("epoch"))).alias("b"))
    return best.select("seed", F.col("b.epoch").alias("best_epoch"), "b.score", "b.weights")
