"""The answer cache and the spending ledger."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.functions.keys import sha_key


def digest(provider: Column, action: Column, request: Column, window: Column) -> Column:
    return sha_key(provider, action, request, window)


def latest(entries: DataFrame) -> DataFrame:
    """The last entry of each key by seq. entries: key, seq and the rest; a max of structs, folded map-side."""
    rest = [c for c in entries.columns if c not in ("key", "seq")]
    return entries.groupBy("key").agg(F.max(F.struct("seq", *rest)).alias("e")).select("key", "e.*")


def look_up(requests: DataFrame, entries: DataFrame, key: str = "key", fallback: str | None = None, need: bool = False) -> DataFrame:
    """requests with the entry of their key, else of their fallback key; cached tells whether there was one. need: fails if
    no request has any, which is a wrong key rather than an empty cache."""
    last = latest(entries)
    cols = [c for c in last.columns if c != "key"]
    first = last.select(F.col("key").alias("__k"), F.struct(*cols).alias("__e"))
    out = requests.join(first, F.col(key) == F.col("__k"), "left").drop("__k")
    if fallback:
        second = last.select(F.col("key").alias("__k"), F.struct(*cols).alias("__f"))
        out = out.join(second, F.col("__e").isNull() & (F.col(fallback) == F.col("__k")), "left").withColumn("__e", F.coalesce("__e", "__f")).drop("__k", "__f")
    if need and out.where(F.col("__e").isNotNull()).isEmpty():
        raise ValueError("no request is in the cache")
    return out.withColumn("cached", F.col("__e").isNotNull()).select("*", "__e.*").drop("__e")


def append(entries: DataFrame, path: str) -> None:
    """Adds entries to a store; refuses contact fields."""
    from attestry.functions.answers import forbidden_fields

    if bad := forbidden_fields(entries.schema):
        raise ValueError(f"contact fields: {bad}")
    entries.write.mode("append").parquet(path)


def append_stripped(entries: DataFrame, path: str) -> None:
    """Adds entries to a store without their contact fields, at any depth; a text column body, which holds JSON of no fixed
    shape, loses its contact keys too."""
    from attestry.functions.answers import is_contact, strip_contact_json, without_contact

    kept = [f for f in entries.schema.fields if not is_contact(f.name)]
    clean = [strip_contact_json(F.col(f.name)) if f.name == "body" and f.dataType == T.StringType() else without_contact(f.dataType, F.col(f.name)) for f in kept]
    append(entries.select(*[c.alias(f.name) for c, f in zip(clean, kept, strict=True)]), path)


def reparsed(entries: DataFrame) -> DataFrame:
    """The latest entry of each key with the answer that its stored body gives now: person_name, employer_name, title_text
    and confidence, NULL for prose."""
    from attestry.functions.answers import parse_answer

    return latest(entries).withColumn("__p", parse_answer(F.col("body"))).select("*", *[F.col(f"__p.{c}").alias(c) for c in ("person_name", "employer_name", "title_text", "confidence")]).drop("__p")


def total_spend(entries: DataFrame) -> DataFrame:
    return entries.agg(F.round(F.coalesce(F.sum("spend_usd"), F.lit(0.0)), 4).alias("total_usd"))


def charge(calls: DataFrame, ledger: str, order: list[str], price: str, ceiling: float, stop: bool) -> DataFrame:
    """calls with charged: in order, a call is paid if it fits under the ledger's ceiling. One that does not is skipped,
    or, with stop, ends the ledger.

    A ledger that stops is a running sum, as no call after the first that does not fit is paid. In one that skips, whether a
    call fits depends on which before it did, so it is a fold in order, one task per ledger; calls that alone are beyond
    the ceiling never reach it. Prices are not negative; a call without a price is not paid."""
    if stop:
        w = Window.partitionBy(ledger).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        priced = F.coalesce(F.col(price), F.lit(float("inf")))
        return calls.withColumn("charged", F.sum(priced).over(w) <= ceiling + 1e-9)
    schema = calls.withColumn("charged", F.lit(True)).schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        spent, out = 0.0, []
        for p in pdf[price]:
            ok = spent + p <= ceiling + 1e-9
            spent += p if ok else 0.0
            out.append(ok)
        return pdf.assign(charged=out)

    fits = F.coalesce(F.col(price) <= ceiling + 1e-9, F.lit(False))
    return calls.where(fits).groupBy(ledger).applyInPandas(run, schema).unionByName(calls.where(~fits).withColumn("charged", F.lit(False)))


def capped(calls: DataFrame, provider: str, order: list[str], most: int) -> DataFrame:
    """The first calls of each provider in order."""
    r = F.row_number().over(Window.partitionBy(provider).orderBy(*order))
    return calls.withColumn("__r", r).where(F.col("__r") <= most).drop("__r")


def live_spend(entries: DataFrame, manual: DataFrame, provider: Column) -> DataFrame:
    """Spend per billing provider, live and manual. entries: spend_usd and what provider needs; manual: provider, usd."""
    live = entries.select(provider.alias("provider"), F.col("spend_usd").alias("usd"))
    return live.unionByName(manual).groupBy("provider").agg(F.round(F.sum("usd"), 4).alias("usd"))
