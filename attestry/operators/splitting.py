"""Deterministic hash splits and the leak that a split leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.keys import hash_draw, sha_key


def bucket(key: Column, seed: int | str, of: int = 100) -> Column:
    return hash_draw(F.sha2(F.concat(F.lit(f"{seed}|"), key.cast("string")), 256)) % of


def split(key: Column, seed: int | str = 11, test: int = 15, hillclimb: int = 15) -> Column:
    b = bucket(key, seed)
    return F.when(b < test, "test").when(b < test + hillclimb, "hillclimb").otherwise("train")


def task_split(task_id: Column) -> Column:
    """60 / 20 / 20 by the leading digits of a task's id."""
    b = hash_draw(task_id) % 10
    return F.when(b < 6, "train").when(b < 8, "hillclimb").otherwise("test")


def signature(person: Column, issuer: Column, roles: Column, title: Column, period: Column) -> Column:
    """Digest of an attested fact: labelled parts in a fixed order, without the accession."""
    parts = [F.concat(F.lit("person="), person), F.concat(F.lit("issuer="), issuer), F.concat(F.lit("roles="), F.array_join(F.array_sort(roles), ",")), F.concat(F.lit("title="), title), F.concat(F.lit("period="), F.date_format(period, "yyyy-MM-dd"))]
    return sha_key(*parts)


def name_hash(salt: str, name: Column) -> Column:
    if not salt:
        raise ValueError("a salt is required")
    return F.sha2(F.concat(F.lit(salt + "|"), name), 256)


def leak_rate(train: DataFrame, held_out: DataFrame, key: str) -> DataFrame:
    """One row: the share of held-out rows whose key is in train; 0 if nothing is held out."""
    seen = train.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__in", F.lit(1))
    got = held_out.join(seen, key, "left").agg(F.avg(F.coalesce("__in", F.lit(0))).alias("r"))
    return got.select(F.coalesce(F.round("r", 6), F.lit(0.0)).alias("leak_rate"))
