"""Queries of problems 8, 9 and 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import languages, leaks, packing
from attestry.queries import Registry
from attestry.session import table

REG = Registry()

# --- 8: filling fixed-capacity containers -------------------------------------------------------------------------


@REG.add("p8_containers")
def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """The place of every text, or piece of one that exceeds the capacity, in the containers of each window."""
    return packing.fill_containers(table(spark, d, "documents"), table(spark, d, "context_window"))


@REG.add("p8_waste")
def p8_waste(spark: SparkSession, d: str) -> DataFrame:
    return packing.waste(p8_containers(spark, d))


# --- 9: evaluation texts leaking into training text ---------------------------------------------------------------

_P9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_item),
iw AS (SELECT DISTINCT item_id, array_to_string(w[p:p + 11], ' ') AS t FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 10))) AS p FROM i)),
dw AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 11], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 10))) AS p FROM d)),
found AS (SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (t))
"""


@REG.add("p9_found", _P9_SQL + "SELECT doc_id, item_id FROM found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_item")).select("doc_id", "item_id").distinct()


@REG.add("p9_items", _P9_SQL + "SELECT item_id, count(f.doc_id) AS n_docs FROM eval_item LEFT JOIN found f USING (item_id) GROUP BY item_id")
def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Every test item with the number of documents that hold part of it."""
    items = table(spark, d, "eval_item")
    found = p9_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return items.select("item_id").join(found, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n_docs"))


_P9_RUNS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_item),
iw AS (SELECT item_id, p, array_to_string(w[p:p + 11], ' ') AS t FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 10))) AS p FROM i)),
dw AS (SELECT doc_id, p, array_to_string(w[p:p + 11], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 10))) AS p FROM d)),
hit AS (SELECT doc_id, item_id, dw.p AS dp, iw.p AS ip, dw.p - row_number() OVER (PARTITION BY doc_id, item_id, dw.p - iw.p ORDER BY dw.p) AS island FROM dw JOIN iw USING (t)),
run AS (SELECT doc_id, item_id, count(*) + 11 AS n, min(dp) - 1 AS doc_at, min(ip) - 1 AS item_at FROM hit GROUP BY doc_id, item_id, dp - ip, island)
SELECT doc_id, item_id, n::INT AS n_words, doc_at::INT AS doc_at, item_at::INT AS item_at FROM run
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n DESC, doc_at, item_at) = 1
"""


@REG.add("p9_passages", _P9_RUNS_SQL)
def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    """The longest passage that each document and item share."""
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))


# --- 10: missing or wrong language labels -------------------------------------------------------------------------


@REG.add("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.unsound(languages.segments(table(spark, d, "documents")))


@REG.add("p10_documents")
def p10_documents(spark: SparkSession, d: str) -> DataFrame:
    return languages.documents(languages.segments(table(spark, d, "documents")))


@REG.add("p10_segments")
def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    return languages.segments(table(spark, d, "documents")).select("doc_id", "seg", "start", "stop", "lang", F.round("confidence", 6).alias("confidence"))
