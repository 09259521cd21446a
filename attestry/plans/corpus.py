"""The corpus build from archives to tables: lines, rejects, attested records, tasks, all lazy up to the sinks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators import ingest, rejects, tasks
from attestry.sources.archives import archive_lines


@dataclass
class Corpus:
    rejected: DataFrame
    counts: DataFrame
    attested: DataFrame
    tasks: DataFrame


def build(spark: SparkSession, archives: str, floor: tuple[int, int] = ingest.FLOOR) -> Corpus:
    """Everything that follows from a folder of archives. A line's place in its archive orders arrivals."""
    lines = archive_lines(spark, archives).withColumn("line_id", F.xxhash64("archive", "member_file", "line_no"))
    parsed = rejects.parse_lines(lines)
    subs = rejects.loadable(parsed, "SUBMISSION.tsv").withColumn("sub_id", F.col("line_id")).withColumn("arrived_at", F.col("archive"))
    owners = rejects.loadable(parsed, "REPORTINGOWNER.tsv").withColumn("owner_id", F.col("line_id"))
    judged = ingest.judged(owners, subs, floor)
    attested = ingest.attested(judged)
    rows = attested.withColumnRenamed("owner_id", "row_id").withColumn("acc", F.col("accession"))
    return Corpus(rejects.rejects(parsed), ingest.reconciles(ingest.exclusion_counts(judged, ["archive"])), attested, tasks.as_tasks(tasks.movers(rows)))
