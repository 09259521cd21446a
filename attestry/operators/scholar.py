"""Expertise: attested topics, topics an author provably never published in, institutions, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.stats import wilson
from attestry.operators.sampling import draw
from attestry.session import broadcast_if_small

# Bounds of the author population, catch-all topic labels, the shortest title that is matched.
WORKS, LEAST_IN_TOPIC, SHORTEST_TITLE = (20, 500), 3, 12
CATCHALL = ("diverse", "various", "miscellaneous", "interdisciplinary studies", "research studies", "scientific studies", "and applications")
TIERS = {"near": ("near", "far"), "far": ("far", "near"), "far_domain": ("far_domain",)}


def clean_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))


def is_catchall(label: Column) -> Column:
    return F.lower(label).rlike("|".join(CATCHALL))


def author_disposition(orcid: Column, works: Column, topics: Column, institution: Column) -> Column:
    """kept, or the first rule that drops an author; topics is the number of topics with enough works."""
    return (
        F.when(F.trim(F.coalesce(orcid, F.lit(""))) == "", "no_orcid").when(~F.coalesce(works, F.lit(0)).between(*WORKS), "works_out_of_band")
        .when(F.coalesce(topics, F.lit(0)) < 1, "no_attested_topic").when(F.coalesce(institution, F.lit("")) == "", "no_institution").otherwise("kept")
    )


def attested_topics(works: DataFrame, least: int = LEAST_IN_TOPIC) -> DataFrame:
    """(author, topic, n_works) with at least so many works; works: author, topic, one row per work and topic."""
    return works.groupBy("author", "topic").agg(F.count(F.lit(1)).alias("n_works")).where(F.col("n_works") >= least)


def false_topics(attested: DataFrame, topics: DataFrame, works: DataFrame, difficulty: str, seed: int | str = 11) -> DataFrame:
    """(author, topic, tier): for each author one topic of the wanted tier, else of its fallback, in which the author has
    no work at all; the first by hash. Catch-all topics never serve.

    topics: topic, label, subfield, field, domain, a dimension that is checked to be small; near and far meet on field
    or domain, and what the author has is taken off by anti-joins. The pick is a minimum of structs, folded map-side."""
    own = attested.join(topics, "topic")
    has = lambda level: own.select("author", level).distinct()
    usable = topics.where(~is_catchall(F.col("label")))
    pools = {
        "near": lambda: has("field").join(usable, "field").join(has("subfield"), ["author", "subfield"], "left_anti"),
        "far": lambda: has("domain").join(usable, "domain").join(has("field"), ["author", "field"], "left_anti"),
    }
    authors = own.select("author").distinct()
    out = None
    for rank, tier in enumerate(TIERS[difficulty]):
        pool = authors.crossJoin(broadcast_if_small(usable)).join(has("domain"), ["author", "domain"], "left_anti") if tier == "far_domain" else pools[tier]()
        row = pool.select("author", "topic", F.lit(rank).alias("rank"), F.lit(tier).alias("tier"))
        out = row if out is None else out.unionByName(row)
    false = out.join(works.select("author", "topic").distinct(), ["author", "topic"], "left_anti")
    best = F.min(F.struct("rank", draw(seed, F.col("author"), F.col("topic")).alias("h"), "topic", "tier")).alias("b")
    return false.groupBy("author").agg(best).select("author", "b.topic", "b.tier")


def institution_candidates(name: Column) -> Column:
    """What is looked up, in this order: the whole name, its first and its last clause; shorter than three letters not."""
    parts = F.filter(F.transform(F.split(name, ","), lambda p: F.trim(p)), lambda p: p != "")
    more = F.when(F.contains(name, F.lit(",")), F.array(F.get(parts, F.lit(0)), F.element_at(parts, -1))).otherwise(F.array().cast("array<string>"))
    plain = F.transform(F.concat(F.array(F.trim(name)), more), lambda c: F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}_\s&-]", " ")))
    return F.filter(plain, lambda c: F.length(c) >= 3)


def resolve_institution(rows: DataFrame, key: str, name: str, known: DataFrame) -> DataFrame:
    """rows with institution_id and lineage of the first candidate that is known. known: name, institution_id, lineage.

    Distinct names are looked up once each and joined back, which is what a memo of lookups does."""
    names = rows.select(F.col(name).alias("__n")).where(F.col("__n").isNotNull()).distinct()
    cands = names.select("__n", F.posexplode(institution_candidates(F.col("__n"))).alias("pos", "cand"))
    dim = known.select(F.lower("name").alias("__k"), "institution_id", "lineage")
    hit = cands.join(dim, F.lower("cand") == F.col("__k")).groupBy("__n").agg(F.min(F.struct("pos", "institution_id", "lineage")).alias("h")).select("__n", "h.institution_id", "h.lineage")
    return rows.join(hit, F.col(name) == F.col("__n"), "left").drop("__n")


def same_institution(a: Column, a_lineage: Column, b: Column, b_lineage: Column) -> Column:
    """Whether two resolved institutions are one, or one contains the other; NULL if the truth is not resolved."""
    same = (a == b) | F.coalesce(F.array_contains(a_lineage, b), F.lit(False)) | F.coalesce(F.array_contains(b_lineage, a), F.lit(False))
    return F.when(b.isNotNull(), F.coalesce(same, F.lit(False)))


def citation_audit(affirmed: DataFrame, works: DataFrame, most: int = 3) -> DataFrame:
    """(key, verdict): backed if one of the first few cited titles is the author's, exists if some author has it, else
    none. affirmed: key, author, citations. Titles are compared cleaned; short ones match nothing."""
    cited = affirmed.select("key", "author", F.explode_outer(F.slice("citations", 1, most)).alias("t")).withColumn("t", clean_title(F.col("t")))
    cited = cited.withColumn("t", F.when(F.length("t") >= SHORTEST_TITLE, F.col("t")))
    held = works.select(F.col("author").alias("__a"), clean_title(F.col("title")).alias("__t")).distinct()
    exists = held.groupBy("__t").agg(F.lit(True).alias("__any"))
    own = held.withColumn("__own", F.lit(True))
    got = cited.join(own, (F.col("author") == F.col("__a")) & (F.col("t") == F.col("__t")), "left").drop("__a", "__t").join(exists, F.col("t") == F.col("__t"), "left")
    by = got.groupBy("key").agg(F.bool_or(F.coalesce("__own", F.lit(False))).alias("b"), F.bool_or(F.coalesce("__any", F.lit(False))).alias("e"))
    return by.select("key", F.when(F.col("b"), "backed").when(F.col("e"), "exists").otherwise("none").alias("verdict"))


def audit_strata(verdicts: DataFrame, stratum: str) -> DataFrame:
    """Per stratum the verdicts of audited citations, and the rate of backed ones with its interval."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    by = verdicts.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), n("backed").alias("n_backed"), n("exists").alias("n_exists"), n("none").alias("n_none"))
    i = by.withColumn("i", wilson(F.col("n_backed"), F.col("n")))
    return i.select(stratum, "n", "n_backed", "n_exists", "n_none", F.round("i.point", 6).alias("backed_rate"), F.round("i.lo", 6).alias("lo"), F.round("i.hi", 6).alias("hi"))


def first_wins(frames: list[DataFrame], key: str) -> DataFrame:
    """Union in which the earliest frame's row of a key stays."""
    out = None
    for i, f in enumerate(frames):
        row = f.withColumn("__f", F.lit(i))
        out = row if out is None else out.unionByName(row)
    rank = F.row_number().over(Window.partitionBy(key).orderBy("__f"))
    return out.withColumn("__r", rank).where("__r = 1").drop("__r", "__f")
