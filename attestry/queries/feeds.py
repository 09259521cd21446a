"""Queries of sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.queries import Registry
from attestry.session import scratch, table
from attestry.sources import archives, stores
from attestry.streaming import events

REG = Registry()

_PAGE = '<a href="/data/2006q2_form345.zip">b</a> <a href="/data/2006q1_form345.zip">a</a> <a href="/old/2006q1_form345.zip">again</a> <a href="/data/readme.txt">x</a> <a href="/data/2021q4_form345.zip">z</a>'


@REG.add("discovered_quarters", "SELECT * FROM (VALUES (2006, 1, '/data/2006q1_form345.zip'), (2006, 2, '/data/2006q2_form345.zip'), (2021, 4, '/data/2021q4_form345.zip')) t(year, quarter, url)")
def discovered_quarters(spark: SparkSession, d: str) -> DataFrame:
    return archives.quarters(spark.createDataFrame([(_PAGE,)], "html string"))


@REG.add("task_roundtrip", "SELECT task_id, person_name_raw, collision_degree, strict_degree, strftime(target_date, '%Y-%m-%d') AS target_date FROM task")
def task_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Tasks written as JSON lines and loaded again."""
    path = scratch(spark, "tasks")
    stores.write_lines(table(spark, d, "task"), path)
    return stores.read_tasks(spark, path).select("task_id", "person_name_raw", "collision_degree", "strict_degree", F.date_format("target_date", "yyyy-MM-dd").alias("target_date"))


@REG.add("corpus_roundtrip", "SELECT title_class, count(*) AS n FROM attested_tuple GROUP BY 1")
def corpus_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The corpus written as Parquet in files of bounded length and read again."""
    path = scratch(spark, "corpus")
    stores.write_parquet(table(spark, d, "attested_tuple"), path)
    return spark.read.parquet(path).groupBy("title_class").agg(F.count(F.lit(1)).alias("n"))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


@REG.add("stream_spend", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1")
def stream_spend(spark: SparkSession, d: str) -> DataFrame:
    """Windows of the event stream, taken whole, summed per kind."""
    got = events.drained(events.spend_per_window(_stream(spark, d)), "spend", "complete")
    return got.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("value"), 2).alias("value"))


@REG.add("stream_dedup", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    s = _stream(spark, d)
    got = events.drained(events.deduplicated(s.unionByName(s), delay="365 days"), "dedup")
    return got.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@REG.add("stream_ledger")
def stream_ledger(spark: SparkSession, d: str) -> DataFrame:
    return events.drained(events.ledger(_stream(spark, d)), "ledger", "update")
