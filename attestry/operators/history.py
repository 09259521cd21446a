"""History of changing attributes as insert-only satellites: attributes are split by how fast they change, a row is
appended only when the hash of its attributes differs from the version before, and ends come from lead() in a view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.session import cut

NULL_MARK = "\x00"


def hash_diff(attrs: list[str]) -> Column:
    """Hash of a satellite's attributes, in which NULL differs from every value and parts cannot run together."""
    parts = [F.coalesce(F.concat(F.lit("="), F.to_json(F.struct(F.col(a).alias("v")))), F.lit(NULL_MARK)) for a in attrs]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def latest_per_period(df: DataFrame, key: str, period: str, order: list[str], keep: list[str]) -> DataFrame:
    """One row per key and period: the largest by order, NULLs lowest. A max of structs, so it is folded map-side and
    a key with a third of all rows leaves each task as at most one row per period. Rows without key or period are left out;
    repeated rows change nothing; columns that are not named are not read; an empty table gives no rows."""
    best = F.max(F.struct(*order, *[c for c in keep if c not in order])).alias("__b")
    return df.where(F.col(key).isNotNull() & F.col(period).isNotNull()).groupBy(key, period).agg(best).select(key, period, *[F.col(f"__b.{c}").alias(c) for c in keep])


def satellite(snapshots: DataFrame, key: str, period: str, attrs: list[str]) -> DataFrame:
    """Versions to append: rows whose hash differs from the same key's row at the period before.

    snapshots has one row per key and period (see latest_per_period). Columns: key, valid_from, attrs, hash_diff. The
    window runs per key over periods, which are dates: a key has no more rows than the calendar has days. A change to or
    from NULL is a change; columns other than those named are left behind.
    """
    w = Window.partitionBy(key).orderBy(period)
    rows = snapshots.withColumn("hash_diff", hash_diff(attrs))
    before = F.lag("hash_diff").over(w)
    return rows.withColumn("__p", before).where(F.col("__p").isNull() | (F.col("__p") != F.col("hash_diff"))).select(key, F.col(period).alias("valid_from"), *attrs, "hash_diff")


def append(stored: DataFrame, snapshots: DataFrame, key: str, period: str, attrs: list[str]) -> DataFrame:
    """The rows that a later load adds to a stored satellite: the stored rows stay as they are. snapshots must lie after
    each key's last stored version; older corrections need a rebuild of that key."""
    last = stored.groupBy(key).agg(F.max(F.struct("valid_from", "hash_diff")).alias("__l"))
    seen = snapshots.join(last, key, "left").where(F.col("__l").isNull() | (F.col(period) > F.col("__l.valid_from")))
    w = Window.partitionBy(key).orderBy(period)
    rows = seen.withColumn("hash_diff", hash_diff(attrs)).withColumn("__p", F.coalesce(F.lag("hash_diff").over(w), F.col("__l.hash_diff")))
    return rows.where(F.col("__p").isNull() | (F.col("__p") != F.col("hash_diff"))).select(key, F.col(period).alias("valid_from"), *attrs, "hash_diff")


def narrowed(sat: DataFrame, key: str, attrs: list[str]) -> DataFrame:
    """A satellite of some of a satellite's attributes: versions in which only others changed fall together."""
    return satellite(sat.drop("hash_diff"), key, "valid_from", attrs)


def load(snapshots: DataFrame, key: str, period: str, attrs: list[str], edges: list[object]) -> DataFrame:
    """A satellite filled batch by batch: the snapshots before each edge (a value of period) and from the last one on are
    appended to what is stored, in that order; rows once written stay as they are."""
    at = F.col(period)
    bounds = [None, *edges, None]
    stored = None
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        batch = snapshots.where((F.lit(True) if lo is None else at >= F.lit(lo)) & (F.lit(True) if hi is None else at < F.lit(hi)))
        new = cut(satellite(batch, key, period, attrs) if stored is None else append(stored, batch, key, period, attrs))
        stored = new if stored is None else stored.unionByName(new)
    return stored


def history_view(sat: DataFrame, key: str, versions_from: int = 1) -> DataFrame:
    """The satellite with valid_to, the start of the next version (NULL: still valid), and n_versions of the key."""
    w = Window.partitionBy(key).orderBy("valid_from")
    out = sat.withColumn("valid_to", F.lead("valid_from").over(w)).withColumn("n_versions", F.count(F.lit(1)).over(Window.partitionBy(key)))
    return out.where(F.col("n_versions") >= versions_from)


def change_rates(snapshots: DataFrame, key: str, period: str, attrs: list[str]) -> DataFrame:
    """Per attribute: how many steps from one period to the next there are, and the share in which it changed."""
    w = Window.partitionBy(key).orderBy(period)
    steps = snapshots.select(key, period, F.lag(F.lit(1)).over(w).alias("__has"), *[(~F.col(a).eqNullSafe(F.lag(a).over(w))).alias(a) for a in attrs]).where("__has = 1")
    agg = steps.agg(F.count(F.lit(1)).alias("n_steps"), *[F.count_if(a).alias(a) for a in attrs])
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).alias("n_changes")) for a in attrs]))
    rate = F.round(F.try_divide(F.col("p.n_changes").cast("double"), F.col("n_steps")), 6)
    return agg.select("n_steps", pairs.alias("p")).select("p.attribute", "n_steps", "p.n_changes", F.coalesce(rate, F.lit(0.0)).alias("change_rate"))


def split_by_rate(rates: list[tuple[str, float]], edges: tuple[float, ...] = (0.05,)) -> list[list[str]]:
    """Attributes grouped into satellites: one per span between edges, slowest first; rates as change_rates reports."""
    out: list[list[str]] = [[] for _ in range(len(edges) + 1)]
    for name, rate in sorted(rates):
        out[sum(rate >= e for e in edges)].append(name)
    return [g for g in out if g]


def as_of(facts: DataFrame, fact_key: str, at: str, view: DataFrame, key: str, take: dict[str, str]) -> DataFrame:
    """facts with the columns of the version that held at their time; take maps version columns to new names.

    An equi-join on the key with the span as residual; facts without a version keep NULL."""
    v = view.select(F.col(key).alias("__k"), F.col("valid_from").alias("__f"), F.col("valid_to").alias("__t"), *[F.col(a).alias(b) for a, b in take.items()])
    on = (F.col(fact_key) == F.col("__k")) & (F.col("__f") <= F.col(at)) & (F.col("__t").isNull() | (F.col(at) < F.col("__t")))
    return facts.join(v, on, "left").drop("__k", "__f", "__t")
