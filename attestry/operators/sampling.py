"""Deterministic samples by hash order, strata of equal size, and the bootstrap over tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.keys import hash_draw


def draw(seed: int | str, *keys: Column) -> Column:
    """A sha256 that orders rows at random, alike on every run and cluster."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]), 256)


def sample(rows: DataFrame, key: str, n: int, seed: int | str = 11) -> DataFrame:
    """n rows in hash order: a top-n, of which no task keeps more than n."""
    return rows.withColumn("__h", draw(seed, F.col(key))).orderBy("__h", key).limit(n).drop("__h")


def stratified(rows: DataFrame, key: str, stratum: str, n: int, seed: int | str = 11) -> DataFrame:
    """Equal shares of n over the strata that occur, at least one row each, as far as a stratum has rows.

    Ranks are taken within hash buckets after the rows that cannot be in the sample are left out: a row is only ranked if
    its hash lies under a bound that its stratum's size gives, so a hot stratum is not sorted whole."""
    sizes = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("__size"))
    each = sizes.agg(F.greatest(F.lit(1), F.floor(F.lit(n) / F.greatest(F.lit(1), F.count(F.lit(1))))).alias("__each"))
    bound = sizes.crossJoin(F.broadcast(each)).withColumn("__bound", 4.0 * F.col("__each") / F.col("__size") + 64.0 / F.col("__size"))  # each: one row
    h = rows.withColumn("__h", draw(seed, F.col(key))).withColumn("__u", hash_draw(F.col("__h")) / F.lit(float(1 << 32)))
    near = h.join(F.broadcast(bound), stratum).where(F.col("__u") <= F.col("__bound"))  # a row per stratum
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy("__h", key))
    return near.withColumn("__r", rank).where(F.col("__r") <= F.col("__each")).drop("__h", "__u", "__r", "__size", "__each", "__bound")


def dense_index(rows: DataFrame, key: str, by: list[str] | None = None, buckets: int = 256) -> DataFrame:
    """rows with idx from 0 without gaps, per group of by: ordered by a hash bucket of the key, then the key. Buckets are
    counted first and ranked apart, so no task sorts all rows."""
    by = by or []
    bucketed = rows.withColumn("__b", (hash_draw(F.sha2(F.col(key).cast("string"), 256)) % buckets).cast("int"))
    counts = bucketed.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy(*by, "__b").orderBy(key))
    joined = bucketed.withColumn("__r", place).join(F.broadcast(counts.select(*by, "__b", before.alias("__before"))), [*by, "__b"])  # a row per bucket
    return joined.withColumn("idx", F.col("__before") + F.col("__r") - 1).drop("__b", "__r", "__before")


#: Standard deviations from the mean beyond which a binomial draw does not fall at the 32 bits of a hash.
REACH = 12.0


def _log_factorial(k: np.ndarray) -> np.ndarray:
    """ln k!: summed for small k, by Stirling's series for others."""
    small = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 256)))])
    x = np.maximum(k, 1).astype(float) + 1.0
    series = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(k < 256, small[np.minimum(k, 255).astype(int)], series)


def binomial_quantile(n: int, p: float, u: np.ndarray) -> np.ndarray:
    """For each u the smallest k of which at most k of n trials succeed with a probability of at least u."""
    if p <= 0.0 or p >= 1.0 or n == 0:
        return np.full(len(u), 0 if p <= 0.0 else n, np.int64)
    mid, dev = n * p, np.sqrt(n * p * (1 - p))
    lo, hi = max(0, int(mid - REACH * dev - REACH)), min(n, int(mid + REACH * dev + REACH))
    k = np.arange(lo, hi + 1)
    log = _log_factorial(np.array([n])) - _log_factorial(k) - _log_factorial(n - k) + k * np.log(p) + (n - k) * np.log1p(-p)
    return np.minimum(lo + np.searchsorted(np.cumsum(np.exp(log)), u), hi)


def _uniforms(ids: Iterable[int], seed: int | str, level: float) -> np.ndarray:
    return np.array([int(hashlib.sha256(f"{seed}|{i}|{level}".encode()).hexdigest()[:8], 16) for i in ids]) / float(1 << 32)


def resampled_means(values: DataFrame, value: str, n: int, resamples: int, seed: int | str) -> DataFrame:
    """(resample, m): means of n draws with replacement from n rows, NULLs left out of the mean.

    Equal values are folded, and a resample draws how often each of them is taken: value by value a binomial count of the
    draws that are left, from a hash of seed, resample and value. That is the distribution of n single draws, at a cost
    that the number of different values gives. Values are outcomes or their differences, of which there are few; their
    folded counts are what reaches the driver.
    """
    folded = values.groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")).toLocalIterator()
    levels = sorted((r["v"], r["n"]) for r in folded if r["v"] is not None)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b["id"].tolist()
            left, pool = np.full(len(ids), n, np.int64), n
            total, count = np.zeros(len(ids)), np.zeros(len(ids))
            for v, size in levels:
                u, took = _uniforms(ids, seed, v), np.zeros(len(ids), np.int64)
                for m in np.unique(left).tolist():
                    at = left == m
                    took[at] = binomial_quantile(m, size / pool, u[at])
                left, pool = left - took, pool - size
                total, count = total + took * v, count + took
            yield pd.DataFrame({"resample": ids, "m": np.where(count > 0, total / np.maximum(count, 1), np.nan)})

    return values.sparkSession.range(resamples).mapInPandas(run, "resample bigint, m double").where("m IS NOT NULL AND NOT isnan(m)")


def bootstrap_interval(values: DataFrame, resamples: int = 10_000, seed: int | str = 11) -> DataFrame:
    """One row: point, lo, hi, n of the mean of paired differences, resampling tasks. values: diff.

    Limits are order statistics, not interpolated."""
    n = values.count()
    spark = values.sparkSession
    if n == 0:
        return spark.createDataFrame([(0.0, 0.0, 0.0, 0)], "point double, lo double, hi double, n bigint")
    means = resampled_means(values, "diff", n, resamples, seed)
    ordered = means.withColumn("r", F.row_number().over(Window.orderBy("m")) - 1)  # one row per resample
    lo, hi = int(0.025 * resamples), min(int(0.975 * resamples), resamples - 1)
    limits = ordered.agg(F.max(F.when(F.col("r") == lo, F.col("m"))).alias("lo"), F.max(F.when(F.col("r") == hi, F.col("m"))).alias("hi"))
    return values.agg(F.round(F.avg("diff"), 6).alias("point"), F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(limits)).select("point", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n")


def paired(records: DataFrame, task: str, arm: str) -> DataFrame:
    """Records of tasks that every arm has."""
    arms = records.agg(F.count_distinct(arm).alias("k"))
    full = records.groupBy(task).agg(F.count_distinct(arm).alias("n")).crossJoin(F.broadcast(arms)).where("n = k").select(task)  # arms: one row
    return records.join(full, task, "left_semi")


def contrasts(records: DataFrame, task: str, arm: str, value: str) -> DataFrame:
    """(arm_a, arm_b, task, diff) for every unordered pair of arms, names in order. Arms meet per task, and a task has a
    row per arm."""
    one = records.groupBy(task, arm).agg(F.max(value).alias("v"))
    a, b = one.select(task, F.col(arm).alias("arm_a"), F.col("v").alias("va")), one.select(task, F.col(arm).alias("arm_b"), F.col("v").alias("vb"))
    return a.join(b, task).where("arm_a < arm_b").select("arm_a", "arm_b", task, (F.col("va") - F.col("vb")).alias("diff"))


def unpaired_interval(values: DataFrame, resamples: int = 10_000, least: int = 100, seed: int | str = 11) -> DataFrame:
    """One row: difference of two populations' means and its limits, each population resampled on its own; NULL limits and
    verdict 'none' if either has fewer than least scored rows. values: side ('a' or 'b'), value."""
    n = {r["side"]: r["n"] for r in values.groupBy("side").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    spark = values.sparkSession
    if min(n.get("a", 0), n.get("b", 0)) < least:
        return spark.createDataFrame([(None, None, None, "none")], "point double, lo double, hi double, verdict string")
    mean = lambda s: resampled_means(values.where(F.col("side") == s), "value", n[s], resamples, f"{seed}{s}").withColumnRenamed("m", s)
    diffs = mean("a").join(mean("b"), "resample").select((F.col("a") - F.col("b")).alias("m"))
    ordered = diffs.withColumn("r", F.row_number().over(Window.orderBy("m")) - 1)  # one row per resample
    lo, hi = int(0.025 * resamples), min(int(0.975 * resamples), resamples - 1)
    limits = ordered.agg(F.max(F.when(F.col("r") == lo, F.col("m"))).alias("lo"), F.max(F.when(F.col("r") == hi, F.col("m"))).alias("hi"))
    point = values.agg((F.avg(F.when(F.col("side") == "a", F.col("value"))) - F.avg(F.when(F.col("side") == "b", F.col("value")))).alias("point"))
    both = point.crossJoin(F.broadcast(limits))  # one row each
    verdict = F.when((F.col("lo") > 0) | (F.col("hi") < 0), "separates").otherwise("cannot separate")
    return both.select(F.round("point", 6).alias("point"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), verdict.alias("verdict"))
