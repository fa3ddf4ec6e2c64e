"""Write batches as rows: sequence numbers, concatenation, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import varint_length

#: Batches to a group whose running sum one task computes.
GROUP = 100_000


def sequence_batches(batches: DataFrame, last_seq: int = 0, group: int = GROUP) -> DataFrame:
    """``first_seq`` for each batch (``batch_id``, ``n_ops``) when they are applied in order of their ids after ``last_seq``.

    The running sum goes group by group of ids, with the sums of the groups before carried in; only
    the table of groups is summed in one task.
    """
    rows = batches.withColumn("_g", F.floor(F.col("batch_id") / group).cast("long"))
    before = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy("_g").agg(F.sum("n_ops").alias("_n")).select("_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_carry"))
    own = Window.partitionBy("_g").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1)
    first = F.lit(last_seq + 1) + F.col("_carry") + F.coalesce(F.sum("n_ops").over(own), F.lit(0))
    return rows.join(carry, "_g").withColumn("first_seq", first.cast("long")).drop("_g", "_carry")


def to_log(batches: DataFrame, last_seq: int = 0) -> DataFrame:
    """Log rows of batches (``batch_id``, ``ops``: array of vt, key, value): operation i of a batch gets its first number plus i."""
    numbered = sequence_batches(batches.withColumn("n_ops", F.size("ops").cast("long")), last_seq)
    ops = numbered.select("first_seq", F.posexplode("ops").alias("i", "op"))
    return ops.select(F.col("op.key").alias("key"), (F.col("first_seq") + F.col("i")).alias("seq"), F.col("op.vt").alias("vt"), F.when(F.col("op.vt") == 1, F.col("op.value")).alias("value"))


def concatenated(ops: DataFrame, by: str = "group_id") -> DataFrame:
    """One batch for each group: operations in order of (``batch_id``, ``i``), and their number."""
    rows = F.sort_array(F.collect_list(F.struct("batch_id", "i", "vt", "key")))
    return ops.groupBy(by).agg(rows.alias("ops"), F.count("*").alias("n_ops"))


def sizes(ops: DataFrame, by: str = "batch_id") -> DataFrame:
    """Operations and encoded bytes of each batch: 12 for the header, and a tag and length-prefixed slices for each operation."""
    k, v = F.octet_length("key").cast("long"), F.octet_length("value").cast("long")
    one = F.lit(1) + varint_length(k) + k + F.when(F.col("vt") == 1, varint_length(v) + v).otherwise(0)
    return ops.groupBy(by).agg(F.count("*").alias("n_ops"), (F.lit(12) + F.sum(one)).cast("long").alias("n_bytes"))


def memory_usage(log: DataFrame, by: list[str], overhead: int = 0) -> DataFrame:
    """Bytes that a memtable needs for the rows of each group: key, 8-byte tag, value."""
    row = F.octet_length("key") + 8 + F.coalesce(F.octet_length("value"), F.lit(0)) + overhead
    return log.groupBy(*by).agg(F.sum(row).cast("long").alias("n_bytes"), F.count("*").alias("n_entries"))
