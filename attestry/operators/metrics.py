"""Calibration, reflection over time and step functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.functions.stats import wilson

N_BINS = 10
# Edges of elapsed time in days; the last span is open.
EDGES = (0, 90, 365, 1095, 2555, 10**9)


def bins(spark: SparkSession, n: int = N_BINS) -> DataFrame:
    """The spine of equal bins; the last is closed."""
    return spark.createDataFrame([(i, i / n, (i + 1) / n, i == n - 1) for i in range(n)], "bin int, lo double, hi double, closed boolean")


def reliability(records: DataFrame, n: int = N_BINS) -> DataFrame:
    """Per bin: n, mean confidence and accuracy, NULL where it is empty. records: confidence, correct. A confidence
    outside [0, 1] fails the query; NULL confidences are left out. Bins are told by their edges, and records are folded
    before the spine is joined."""
    spark = records.sparkSession
    c = F.col("confidence")
    ok = F.when((c >= 0) & (c <= 1), c).otherwise(F.raise_error(F.lit("confidence outside [0, 1]")))
    edge = F.size(F.filter(F.array(*[F.lit(i / n) for i in range(1, n)]), lambda e: e <= F.col("c")))
    by = records.where(c.isNotNull()).select(ok.alias("c"), F.col("correct")).withColumn("bin", edge).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("mean_confidence"), F.avg(F.when(F.col("correct"), 1.0).otherwise(0.0)).alias("accuracy"))
    return bins(spark, n).join(by, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"), "mean_confidence", "accuracy")


def ece(diagram: DataFrame) -> DataFrame:
    """One row: expected calibration error weighted by occupancy, and empty bins."""
    gap = F.abs(F.col("mean_confidence") - F.col("accuracy"))
    error = F.try_divide(F.sum(F.col("n") * gap), F.sum("n"))
    return diagram.agg(F.sum("n").alias("n"), F.count_if(F.col("n") == 0).alias("empty_bins"), F.round(F.coalesce(error, F.lit(0.0)), 6).alias("ece"))


def brier(records: DataFrame) -> DataFrame:
    hit = F.when(F.col("correct"), 1.0).otherwise(0.0)
    return records.agg(F.round(F.coalesce(F.avg(F.pow(F.col("confidence") - hit, 2)), F.lit(0.0)), 6).alias("brier"))


def risk_coverage(records: DataFrame, steps: int = 21) -> DataFrame:
    """Coverage and risk when only answers at or above a threshold are given, for equally spaced thresholds.

    Records are folded to one row per number of thresholds they pass, so the cumulation runs over steps + 1 rows."""
    spark = records.sparkSession
    points = [i / (steps - 1) for i in range(steps)]
    passed = F.size(F.filter(F.array(*[F.lit(p) for p in points]), lambda p: F.col("confidence") >= p))
    by = records.withColumn("k", passed).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("correct")).alias("bad"))
    spine = spark.createDataFrame([(i, p) for i, p in enumerate(points)], "i int, threshold double")
    got = spine.join(by, F.col("k") > F.col("i"), "left").groupBy("threshold").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_answered"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    total = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_total"))
    rate = lambda a, b: F.coalesce(F.round(F.try_divide(a.cast("double"), b.cast("double")), 6), F.lit(0.0))
    return got.crossJoin(F.broadcast(total)).select("threshold", rate(F.col("n_answered"), F.col("n_total")).alias("coverage"), rate(F.col("bad"), F.col("n_answered")).alias("risk"), "n_answered", "n_total")  # total: one row


def binned_rates(observations: DataFrame, edges: tuple[int, ...] = EDGES) -> DataFrame:
    """Rate per span of elapsed days with its interval; empty spans stay. observations: delta, hit."""
    spark = observations.sparkSession
    spans = [(i, f"{a}-{b if b < 10**8 else 'inf'}d", a, b) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
    spine = spark.createDataFrame(spans, "i int, label string, lo bigint, hi bigint")
    at = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col("delta"))) - 1
    by = observations.withColumn("i", at).groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("k"))
    got = spine.join(by, "i", "left").withColumn("w", wilson(F.coalesce("k", F.lit(0)), F.coalesce("n", F.lit(0))))
    return got.select("label", F.col("w.n").alias("n"), *[F.round(f"w.{c}", 6).alias(c) for c in ("point", "lo", "hi")])


def _pool(blocks: list[tuple[float, float, float]], left: bool) -> list[tuple[float, float, float]]:
    """Adjacent blocks (sum, count, edge) pooled while a mean is above the next; which edge a pool keeps is left's."""
    out: list[tuple[float, float, float]] = []
    for b in blocks:
        out.append(b)
        while len(out) > 1 and out[-2][0] * out[-1][1] > out[-1][0] * out[-2][1]:
            y, x = out.pop(), out.pop()
            out.append((x[0] + y[0], x[1] + y[1], x[2] if left else y[2]))
    return out


def pava(observations: DataFrame, group: str) -> DataFrame:
    """Steps (group, delta, prob, n) of the monotone fit of hit on delta, per group; a step begins at its left edge.

    Observations are folded to one row per group and day first: what one task pools is the days of a group, which the
    span of time bounds, whatever the number of observations."""
    days = observations.where("delta IS NOT NULL AND hit IS NOT NULL").groupBy(group, "delta").agg(F.sum(F.when(F.col("hit"), 1.0).otherwise(0.0)).alias("s"), F.count(F.lit(1)).cast("double").alias("c"))
    kind = dict(days.dtypes)[group]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("delta")
        got = _pool(list(zip(pdf["s"], pdf["c"], pdf["delta"], strict=True)), left=True)
        return pd.DataFrame({group: pdf[group].iloc[0], "delta": [int(b[2]) for b in got], "prob": [b[0] / b[1] for b in got], "n": [int(b[1]) for b in got]})

    return days.groupBy(group).applyInPandas(run, f"{group} {kind}, delta bigint, prob double, n bigint")


def isotonic(records: DataFrame, group: str, tie: str) -> DataFrame:
    """Steps (group, x, y) of the recalibration of confidence: every record is a block, ties in the order of tie, and a
    pool is placed at its right edge.

    Records of one confidence are folded to runs of equal outcome first where their order allows it: within a
    confidence, only the sequence of outcomes matters. A group's records are sorted in one task; groups are arms."""
    kind = dict(records.dtypes)[group]
    rows = records.where("confidence IS NOT NULL AND correct IS NOT NULL").select(group, "confidence", F.when(F.col("correct"), 1.0).otherwise(0.0).alias("k"), F.col(tie).alias("__t"))
    w = Window.partitionBy(group, "confidence").orderBy("__t")
    runs = rows.withColumn("new", F.coalesce((F.lag("k").over(w) != F.col("k")).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    folded = runs.groupBy(group, "confidence", "run").agg(F.sum("k").alias("s"), F.count(F.lit(1)).cast("double").alias("c"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["confidence", "run"])
        got = _pool(list(zip(pdf["s"], pdf["c"], pdf["confidence"], strict=True)), left=False)
        return pd.DataFrame({group: pdf[group].iloc[0], "x": [b[2] for b in got], "y": [b[0] / b[1] for b in got]})

    return folded.groupBy(group).applyInPandas(run, f"{group} {kind}, x double, y double")


def step_at(points: DataFrame, at: str, steps: DataFrame, edge: str, value: str, by: str, out: str, default: Column) -> DataFrame:
    """points with the value of the last step at or before them, else default: an as-of join.

    Steps of a group become spans by lead() and the join is an equi-join on the group with the span as residual, so each
    point meets one step."""
    spans = steps.select(F.col(by).alias("__g"), F.col(edge).alias("__a"), F.lead(edge).over(Window.partitionBy(by).orderBy(edge)).alias("__b"), F.col(value).alias("__v"))
    on = (F.col(by) == F.col("__g")) & (F.col("__a") <= F.col(at)) & (F.col("__b").isNull() | (F.col(at) < F.col("__b")))
    return points.join(spans, on, "left").withColumn(out, F.coalesce("__v", default)).drop("__g", "__a", "__b", "__v")


def curve_facts(steps: DataFrame, by: str) -> DataFrame:
    """Per curve: the first day at which it reaches one half (NULL: never) and whether it never falls."""
    before = F.lag("prob").over(Window.partitionBy(by).orderBy("delta"))
    return steps.withColumn("__p", before).groupBy(by).agg(F.min(F.when(F.col("prob") >= 0.5, F.col("delta"))).alias("median_lag"), F.bool_and(F.coalesce(F.col("__p") <= F.col("prob") + 1e-12, F.lit(True))).alias("is_monotone"))
