"""Sharding by jump consistent hashing (Lamping and Veach, 2014): no ring table, least movement.

A key's shard follows from the key and the number of shards alone.  With one more shard a
key either stays or goes to the new shard, and about one key in n + 1 goes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless, in_batches, written


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key, from 0 to ``shards`` - 1; all keys jump in step."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = keys.astype(np.uint64).copy()
    at = np.zeros(len(key), np.int64)
    going = np.arange(len(key))
    while len(going):
        key[going] = key[going] * np.uint64(2862933555777941757) + np.uint64(1)
        step = (key[going] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead = np.floor((at[going] + 1) * (2147483648.0 / step)).astype(np.int64)
        more = ahead < shards
        going = going[more]
        at[going] = ahead[more]
    return at.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a long column that holds a key's hash."""

    @F.pandas_udf("int")
    def of(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(np.int64, na_value=0).view(np.uint64), shards))

    return of(key)


def assign(df: DataFrame, keys: list[str], shards: int, grow_to: int | None = None) -> DataFrame:
    """``df`` with ``shard`` and, if ``grow_to`` is given, ``grown_shard`` for that number of shards.

    Keys of any types are hashed together (XXH64); a null key is a key like any other, so all its
    rows share a shard.  Repeated rows share a shard.  An empty table stays empty.  Columns of ``df``
    named ``shard`` or ``grown_shard`` are replaced.
    """
    in_batches(df.sparkSession)
    key = F.xxhash64(*[F.col(f"`{k}`") for k in keys])
    out = df.withColumn("shard", shard_of(key, shards))
    return out.withColumn("grown_shard", shard_of(key, grow_to)) if grow_to else out


def placed(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Every document's shard by ``doc_id`` and its slot there, gapless from 0.

    Columns: doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, law, shard, slot, grown_shard
    (with one more shard).  A null text has no bytes; a null doc_id is one key; rows that are equal
    get neighbouring slots; slots are ranks that no single task computes for a whole shard.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = written(assign(rows, ["doc_id"], shards, shards + 1), "shards")
    slots = gapless(rows, ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
