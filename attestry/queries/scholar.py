"""Expertise queries over a stand-in: customers as authors, ordered parts as works, brand and size as the topic tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions.answers import expertise_prompt
from attestry.functions.keys import sha_key
from attestry.operators import scholar, splitting
from attestry.queries import Registry
from attestry.session import table

REG = Registry()

_TREE = """brands AS (SELECT *, CAST(substr(p_brand, 7) AS INT) AS b FROM part),
parts AS (SELECT p_partkey, b * 2 + p_size % 2 AS topic, b AS subfield, b % 10 AS field, b % 5 AS domain FROM brands),
topics AS (SELECT DISTINCT topic, CASE WHEN topic % 17 = 0 THEN 'Diverse Scientific Research Studies ' ELSE 'Topic ' END || topic AS label, subfield, field, domain FROM parts),
works AS (SELECT o_custkey AS author, topic FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN parts ON p_partkey = l_partkey),
attested AS (SELECT author, topic, count(*) AS n_works FROM works GROUP BY ALL HAVING count(*) >= 3)"""


def parts(spark: SparkSession, d: str) -> DataFrame:
    b = F.substring("p_brand", 7, 9).cast("int")
    return table(spark, d, "part").select("p_partkey", (b * 2 + F.col("p_size") % 2).alias("topic"), b.alias("subfield"), (b % 10).alias("field"), (b % 5).alias("domain"))


def topics(spark: SparkSession, d: str) -> DataFrame:
    label = F.concat(F.when(F.col("topic") % 17 == 0, "Diverse Scientific Research Studies ").otherwise("Topic "), F.col("topic").cast("string"))
    return parts(spark, d).select("topic", label.alias("label"), "subfield", "field", "domain").distinct()


def works(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("author"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(parts(spark, d), F.col("l_partkey") == F.col("p_partkey")).select("author", "topic")


def attested(spark: SparkSession, d: str) -> DataFrame:
    return scholar.attested_topics(works(spark, d))


@REG.add("attested_topics", f"WITH {_TREE} SELECT author, topic, n_works FROM attested")
def attested_topics(spark: SparkSession, d: str) -> DataFrame:
    return attested(spark, d)


@REG.add("works_in_topic", f"WITH {_TREE} SELECT c_custkey AS author, topic, count(topic) AS n_works FROM customer LEFT JOIN works ON author = c_custkey GROUP BY ALL")
def works_in_topic(spark: SparkSession, d: str) -> DataFrame:
    """Works of every author in every topic that they have any in; an author without works has one row without a topic."""
    n = works(spark, d).groupBy("author", "topic").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("author")).join(n, "author", "left").select("author", "topic", F.coalesce("n", F.lit(0)).alias("n_works"))


@REG.add(
    "author_dispositions",
    f"WITH {_TREE}, w AS (SELECT author, count(*) AS n FROM works GROUP BY 1), t AS (SELECT author, count(*) AS n FROM attested GROUP BY 1) "
    "SELECT disposition, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 7 = 0 THEN 'no_orcid' WHEN NOT coalesce(w.n, 0) BETWEEN 20 AND 500 THEN 'works_out_of_band' WHEN coalesce(t.n, 0) < 1 THEN 'no_attested_topic' WHEN c_nationkey = 3 THEN 'no_institution' ELSE 'kept' END AS disposition FROM customer LEFT JOIN w ON w.author = c_custkey LEFT JOIN t ON t.author = c_custkey) GROUP BY 1",
)
def author_dispositions(spark: SparkSession, d: str) -> DataFrame:
    """Authors by the rule that keeps or drops them; the counts add up to the authors seen."""
    n = works(spark, d).groupBy(F.col("author").alias("a1")).agg(F.count(F.lit(1)).alias("n_works"))
    t = attested(spark, d).groupBy(F.col("author").alias("a2")).agg(F.count(F.lit(1)).alias("n_topics"))
    c = table(spark, d, "customer").join(n, F.col("c_custkey") == F.col("a1"), "left").join(t, F.col("c_custkey") == F.col("a2"), "left")
    what = scholar.author_disposition(F.when(F.col("c_custkey") % 7 != 0, "id"), F.col("n_works"), F.col("n_topics"), F.when(F.col("c_nationkey") != 3, "somewhere"))
    return c.groupBy(what.alias("disposition")).agg(F.count(F.lit(1)).alias("n"))


_POOLS = {
    "near": "SELECT DISTINCT a.author, t.topic FROM (SELECT DISTINCT author, field FROM attested JOIN topics USING (topic)) a JOIN usable t USING (field) WHERE (a.author, t.subfield) NOT IN (SELECT author, subfield FROM attested JOIN topics USING (topic))",
    "far": "SELECT DISTINCT a.author, t.topic FROM (SELECT DISTINCT author, domain FROM attested JOIN topics USING (topic)) a JOIN usable t USING (domain) WHERE (a.author, t.field) NOT IN (SELECT author, field FROM attested JOIN topics USING (topic))",
    "far_domain": "SELECT a.author, t.topic FROM (SELECT DISTINCT author FROM attested) a CROSS JOIN usable t WHERE (a.author, t.domain) NOT IN (SELECT author, domain FROM attested JOIN topics USING (topic))",
}


def _false_sql(difficulty: str) -> str:
    pools = " UNION ALL ".join(f"SELECT author, topic, {i} AS r, '{t}' AS tier FROM ({_POOLS[t]})" for i, t in enumerate(scholar.TIERS[difficulty]))
    return f"WITH {_TREE}, usable AS (SELECT * FROM topics WHERE NOT regexp_matches(lower(label), '{'|'.join(scholar.CATCHALL)}')), pool AS ({pools}) SELECT author, topic, tier FROM pool WHERE (author, topic) NOT IN (SELECT author, topic FROM works) QUALIFY row_number() OVER (PARTITION BY author ORDER BY r, sha256('11|' || author || '|' || topic), topic) = 1"


def _false(difficulty: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return scholar.false_topics(attested(spark, d), topics(spark, d), works(spark, d), difficulty)

    return query


for _d in scholar.TIERS:
    REG.add(f"false_topics_{_d}", _false_sql(_d))(_false(_d))


@REG.add("topic_stats", f"WITH {_TREE} SELECT domain, count(*) AS n_attested, count(DISTINCT author) AS n_authors FROM attested JOIN topics USING (topic) GROUP BY domain")
def topic_stats(spark: SparkSession, d: str) -> DataFrame:
    each = attested(spark, d).join(F.broadcast(topics(spark, d)), "topic").groupBy("domain", "author").agg(F.count(F.lit(1)).alias("n"))  # the topic tree
    return each.groupBy("domain").agg(F.sum("n").alias("n_attested"), F.count(F.lit(1)).alias("n_authors"))


@REG.add("topics_per_author", f"WITH {_TREE}, c AS (SELECT author, count(*) AS n FROM attested GROUP BY 1) SELECT median(n)::DOUBLE AS median_topics, round(avg(n), 6) AS mean_topics FROM c")
def topics_per_author(spark: SparkSession, d: str) -> DataFrame:
    c = attested(spark, d).groupBy("author").agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.median("n").alias("median_topics"), F.round(F.avg("n"), 6).alias("mean_topics"))


@REG.add("top_topic", f"WITH {_TREE} SELECT author, topic FROM attested QUALIFY row_number() OVER (PARTITION BY author ORDER BY n_works DESC, topic) = 1")
def top_topic(spark: SparkSession, d: str) -> DataFrame:
    return attested(spark, d).groupBy("author").agg(F.max(F.struct("n_works", (-F.col("topic")).alias("t"))).alias("m")).select("author", (-F.col("m.t")).alias("topic"))


_TASKS = f"{_TREE}, tops AS (SELECT author, topic FROM attested QUALIFY row_number() OVER (PARTITION BY author ORDER BY n_works DESC, topic) = 1), et AS (SELECT author, topic, CASE WHEN author % 2 = 0 THEN 'ATTESTED' ELSE 'CONSTRUCTED_FALSE' END AS polarity FROM tops)"


@REG.add("expertise_tasks", f"WITH {_TASKS} SELECT sha256(author || '|' || topic || '|' || polarity)[1:16] AS task_id, author, polarity, 'Has ' || c_name || ' of ' || n_name || ' published research in Topic ' || topic || '? Answer yes or no. Give your confidence as a number between 0 and 1.' AS prompt FROM et JOIN customer ON c_custkey = author JOIN nation ON n_nationkey = c_nationkey")
def expertise_tasks(spark: SparkSession, d: str) -> DataFrame:
    t = top_topic(spark, d).withColumn("polarity", F.when(F.col("author") % 2 == 0, "ATTESTED").otherwise("CONSTRUCTED_FALSE"))
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    j = t.join(c, F.col("author") == F.col("c_custkey"))
    label = F.concat(F.lit("Topic "), F.col("topic").cast("string"))
    return j.select(F.substring(sha_key(F.col("author"), F.col("topic"), F.col("polarity")), 1, 16).alias("task_id"), "author", "polarity", expertise_prompt(F.col("c_name"), F.col("n_name"), label).alias("prompt"))


@REG.add("expertise_stats", f"WITH {_TASKS} SELECT polarity, count(*) AS n FROM et GROUP BY 1")
def expertise_stats(spark: SparkSession, d: str) -> DataFrame:
    return expertise_tasks(spark, d).groupBy("polarity").agg(F.count(F.lit(1)).alias("n"))


@REG.add("public_expertise", f"WITH {_TREE} SELECT sha256('public-salt|' || c_name) AS author_hash, topic, n_works FROM attested JOIN customer ON c_custkey = author")
def public_expertise(spark: SparkSession, d: str) -> DataFrame:
    """One row per author and attested topic under a salted hash; false claims about a person are never published."""
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return attested(spark, d).join(c, F.col("author") == F.col("c_custkey")).select(splitting.name_hash("public-salt", F.col("c_name")).alias("author_hash"), "topic", "n_works")


@REG.add(
    "institutions",
    "WITH n AS (SELECT c_custkey, n_name || CASE WHEN c_custkey % 3 = 0 THEN ', Dept. of Works' WHEN c_custkey % 3 = 1 THEN '' ELSE '!' END AS inst, n_nationkey, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey) SELECT c_custkey, CAST(n_nationkey AS VARCHAR) AS institution_id, CAST(n_regionkey AS VARCHAR) AS lineage FROM n",
)
def institutions(spark: SparkSession, d: str) -> DataFrame:
    """Typed institutions resolved by whole name, first or last clause."""
    n = table(spark, d, "nation")
    c = table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    typed = c.select("c_custkey", F.concat("n_name", F.when(F.col("c_custkey") % 3 == 0, ", Dept. of Works").when(F.col("c_custkey") % 3 == 1, "").otherwise("!")).alias("inst"))
    known = n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("institution_id"), F.array("n_regionkey").alias("lineage"))
    return scholar.resolve_institution(typed, "c_custkey", "inst", known).select("c_custkey", F.col("institution_id").cast("string").alias("institution_id"), F.get("lineage", F.lit(0)).cast("string").alias("lineage"))


@REG.add("same_institutions", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, a.n_nationkey = b.n_nationkey OR a.n_regionkey = b.n_nationkey OR b.n_regionkey = a.n_nationkey AS same FROM nation a, nation b")
def same_institutions(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a dimension of 25 rows; the parent of a nation stands for its lineage."""
    n = table(spark, d, "nation")
    a = n.select(F.col("n_nationkey").alias("a"), F.array("n_regionkey").alias("la"))
    b = n.select(F.col("n_nationkey").alias("b"), F.array("n_regionkey").alias("lb"))
    return a.crossJoin(F.broadcast(b)).select("a", "b", scholar.same_institution(F.col("a"), F.col("la"), F.col("b"), F.col("lb")).alias("same"))  # 25 nations


_CLEAN = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


@REG.add(
    "citation_audit",
    rf"""WITH w AS (SELECT DISTINCT coalesce(issuer_cik, '-') AS author, {_CLEAN.format('text')} AS t FROM documents), a AS (SELECT doc_id AS key, coalesce(issuer_cik, '-') || CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE '' END AS author, CASE WHEN doc_id % 3 = 2 THEN 'no such title at all' ELSE text END AS c FROM documents),
c AS (SELECT key, author, {_CLEAN.format('c')} AS t FROM a)
SELECT key, CASE WHEN w.t IS NOT NULL THEN 'backed' WHEN c.t IN (SELECT t FROM w WHERE t IS NOT NULL) AND length(c.t) >= 12 THEN 'exists' ELSE 'none' END AS verdict FROM c LEFT JOIN w ON w.author = c.author AND w.t = c.t AND length(c.t) >= 12""",
)
def citation_audit(spark: SparkSession, d: str) -> DataFrame:
    """Whether a cited text is the author's own, somebody's, or nobody's; issuers stand for authors, whole texts for titles."""
    t = table(spark, d, "documents").select("doc_id", F.coalesce("issuer_cik", F.lit("-")).alias("own"), F.col("text").alias("title"))
    w = t.select(F.col("own").alias("author"), "title")
    author = F.concat("own", F.when(F.col("doc_id") % 3 == 0, "x").otherwise(""))
    cited = F.when(F.col("doc_id") % 3 == 2, "no such title at all").otherwise(F.col("title"))
    return scholar.citation_audit(t.select(F.col("doc_id").alias("key"), author.alias("author"), F.array(cited).alias("citations")), w)


@REG.add("first_wins_union", "SELECT c_custkey, 'BUILDING' AS origin FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey, 'POSITIVE' FROM customer WHERE c_acctbal > 0 AND c_mktsegment <> 'BUILDING'")
def first_wins_union(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    a = c.where("c_mktsegment = 'BUILDING'").select("c_custkey", F.lit("BUILDING").alias("origin"))
    b = c.where("c_acctbal > 0").select("c_custkey", F.lit("POSITIVE").alias("origin"))
    return scholar.first_wins([a, b], "c_custkey")


@REG.add("two_populations", "SELECT 'customer' AS population, count(*) AS n, count(hit) AS n_scored, round(avg(hit), 6) AS rate FROM (SELECT CASE WHEN c_acctbal > 5000 THEN 1.0::DOUBLE WHEN c_acctbal > 0 THEN 0.0 END AS hit FROM customer) UNION ALL SELECT 'supplier', count(*), count(hit), round(avg(hit), 6) FROM (SELECT CASE WHEN s_acctbal > 5000 THEN 1.0::DOUBLE WHEN s_acctbal > 0 THEN 0.0 END AS hit FROM supplier)")
def two_populations(spark: SparkSession, d: str) -> DataFrame:
    """Rates over two populations in which NULL is unscorable and is never counted as wrong."""
    one = lambda t, c: table(spark, d, t).select(F.lit(t).alias("population"), F.when(F.col(c) > 5000, 1.0).when(F.col(c) > 0, 0.0).alias("hit"))
    both = one("customer", "c_acctbal").unionByName(one("supplier", "s_acctbal"))
    return both.groupBy("population").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("n_scored"), F.round(F.avg("hit"), 6).alias("rate"))
