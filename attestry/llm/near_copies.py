"""Duplicates hidden by formatting: canonical records, Bloom filters of once- and repeatedly-seen hashes merged over
partitions, exact grouping of possible repeats only; all other records are emitted as singletons without a shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.session import cut

#: Bits of filter per row, hash functions, the most bytes of one filter (driver and each worker), and the bytes of one
#: shard. The hash space is parted into as many blocks as keep a block's filter below FILTER_BYTES.
BITS_PER_ROW, PROBES, FILTER_BYTES, SHARD_BYTES = 16, 2, 64 << 20, 1 << 18

#: Characters that are dropped from text; all others that are no letter or digit separate words.
DROPPED = ".'’‘ʼ-‐‑"


def canonical_text(c: str) -> Column:
    """Lower case, full stops, apostrophes and hyphens dropped, every other run of non-alphanumerics one space."""
    plain = F.translate(F.lower(F.col(c)), DROPPED, "")
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}\p{M}]+", " "))


def marked(c: Column) -> Column:
    """Text in which NULL differs from every value."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~"))


def record_of(parts: list[Column]) -> Column:
    return F.concat_ws("\x1f", *[marked(p) for p in parts])


def _positions(h: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit positions of each 64-bit hash, as rows."""
    h = h.astype(np.uint64)
    lo, hi = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([((lo + np.uint64(i) * hi) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(bits) for i in range(PROBES)])


def repeat_filter(hashes: DataFrame, rows: int) -> tuple[np.ndarray, int]:
    """The packed filter of repeatedly-seen hashes of a one-column DataFrame h, and its bits.

    Each partition finds the bits of hashes that it sees once and again and sends them shard by shard; one task per shard
    merges them: a bit that two partitions have set is one of the second filter. A shard's bits follow the rows that fall
    into it, some SHARD_BYTES * 8 / BITS_PER_ROW, whatever the number of partitions. What reaches the driver is one bit
    per BITS_PER_ROW share, at most FILTER_BYTES by the caller's choice of rows.
    """
    shard_bits = SHARD_BYTES * 8
    bits = max(1, -(-rows * BITS_PER_ROW // shard_bits)) * shard_bits if rows * BITS_PER_ROW > shard_bits else max(1024, 1 << (max(1, rows) * BITS_PER_ROW - 1).bit_length())
    width = min(bits, shard_bits)

    def build(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b["h"].to_numpy() for b in batches if len(b)]
        if not got:
            return
        own, n = np.unique(np.concatenate(got), return_counts=True)
        first, second = (np.unique(_positions(x, bits).ravel()) for x in (own, own[n > 1]))
        shards = np.unique(first // np.uint64(width))
        part = lambda at, k: (at[slice(*np.searchsorted(at, [k * width, (k + 1) * width]))] - np.uint64(k * width)).astype(np.uint32).tobytes()
        for some in np.array_split(shards, -(-len(shards) // 64)):
            ks = some.tolist()
            yield pd.DataFrame({"shard": np.array(ks, np.int32), "once": [part(first, k) for k in ks], "again": [part(second, k) for k in ks]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        once, n = np.unique(np.concatenate([np.frombuffer(b, np.uint32) for b in pdf["once"]]), return_counts=True)
        again = np.zeros(width, bool)
        again[once[n > 1]] = True
        for b in pdf["again"]:
            again[np.frombuffer(b, np.uint32)] = True
        return pd.DataFrame({"shard": pdf["shard"][:1], "again": [np.packbits(again).tobytes()]})

    built = hashes.mapInPandas(build, "shard int, once binary, again binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in built.groupBy("shard").applyInPandas(merge, "shard int, again binary").toLocalIterator():
        out[r["shard"] * width // 8 : (r["shard"] + 1) * width // 8] = np.frombuffer(bytes(r["again"]), np.uint8)
    return out, bits


def _maybe(packed: np.ndarray, bits: int, spark: object) -> object:
    shared = spark.sparkContext.broadcast(packed)  # at most FILTER_BYTES

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        f = shared.value
        ok = np.ones(len(h), bool)
        for p in _positions(h.to_numpy(), bits):
            ok &= (f[(p >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (p & np.uint64(7))).astype(np.uint8)) & 1 == 1
        return pd.Series(ok)

    return maybe


def possible_repeats(df: DataFrame, parts: list[Column], row_id: str) -> DataFrame:
    """(__row, __rec, __maybe): each row's id and canonical record; __maybe is false only for records that occur once.

    The canonical records are written once, by blocks of their hashes; every block has a filter of its own, so the work
    grows with the rows whatever their number, and a row is read three times: as it came, its hash, and its record. A
    record that is wrongly thought repeated costs a little work and changes no result.
    """
    rows = df.count()
    blocks = max(1, -(-rows * BITS_PER_ROW // (FILTER_BYTES * 8)))
    canon = df.select(F.col(row_id).alias("__row"), record_of(parts).alias("__rec")).withColumn("h", F.xxhash64("__rec"))
    canon = cut(canon.withColumn("block", F.pmod(F.shiftright("h", 40), F.lit(blocks)).cast("int")), by="block")
    out = None
    for k in range(blocks):
        own = canon.where(F.col("block") == k)
        packed, bits = repeat_filter(own.select("h"), -(-rows // blocks))
        got = own.withColumn("__maybe", _maybe(packed, bits, df.sparkSession)(F.col("h"))).select("__row", "__rec", "__maybe")
        out = got if out is None else out.unionByName(got)
    return out


def collapse(df: DataFrame, parts: list[Column], row_id: str) -> tuple[DataFrame, DataFrame]:
    """(records, copies). records: __keep, the smallest row id of each record, and n_rows, how many rows it had; copies:
    __row, a row that is a copy, and __keep.

    Only possible repeats are shuffled: they are grouped by the whole canonical record, the count and the smallest id are
    folded map-side, and the join back has one row per record on its right, so a record that a third of all rows repeat
    is split by AQE. NULL equals NULL and differs from an empty text. Empty tables give empty results; texts are compared
    whole, however long; columns that are in no part are not read.
    """
    flagged = possible_repeats(df, parts, row_id)
    cand = cut(flagged.where("__maybe").select("__row", "__rec"))
    groups = cand.groupBy("__rec").agg(F.min("__row").alias("__keep"), F.count(F.lit(1)).alias("n_rows"))
    singles = flagged.where(~F.col("__maybe")).select(F.col("__row").alias("__keep"), F.lit(1).cast("bigint").alias("n_rows"))
    copies = cand.join(groups.where("n_rows > 1").select("__rec", "__keep"), "__rec").where(F.col("__row") != F.col("__keep")).select("__row", "__keep")
    return groups.select("__keep", "n_rows").unionByName(singles), copies
