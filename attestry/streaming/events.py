"""Streams over the same operators: a de-duplicated cache feed, spend per window, and a ledger with a ceiling."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from attestry.session import scratch

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(folder)


def deduplicated(stream: DataFrame, key: str = "event_id", delay: str = "1 hour") -> DataFrame:
    """First arrivals of each key; state is dropped once the watermark has passed it."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def spend_per_window(stream: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Count and sum per window and kind; late rows within the delay still count."""
    by = stream.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type")
    return by.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").alias("window_start"), "event_type", "n", "value")


def ledger(stream: DataFrame, key: str = "event_type", ceiling: float = 1000.0) -> DataFrame:
    """Per key and batch what was charged under a ceiling that holds over the whole stream; rows that do not fit are
    counted as refused. State is one number per key."""

    def charge(k: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent = state.get[0] if state.exists else 0.0
        paid = refused = 0
        for b in batches:
            for v in b.sort_values(["ts", "event_id"])["value"]:
                if spent + v <= ceiling:
                    spent, paid = spent + v, paid + 1
                else:
                    refused += 1
        state.update((spent,))
        yield pd.DataFrame({key: [k[0]], "spent": [spent], "paid": [paid], "refused": [refused]})

    return stream.groupBy(key).applyInPandasWithState(charge, f"{key} string, spent double, paid bigint, refused bigint", "spent double", "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a stream gives when all its input is taken once, as a table in the shared folder beside the stream's state.

    Every batch overwrites a folder of its own, so one that is tried again adds nothing twice; in complete mode the last
    batch is the table. A stream without input gives no rows."""
    spark = stream.sparkSession
    path = scratch(spark, name)

    def write(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={0 if mode == 'complete' else i}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{path}/out/batch=-1")
    return spark.read.schema(stream.schema).parquet(f"{path}/out").select(*stream.columns)
