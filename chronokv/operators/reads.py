"""Reading a change log: latest state, snapshots, batched gets, scans and history.

A log has ``key``, ``seq`` (unique), ``vt`` (1 put, 0 delete) and ``value``.  Versions are chosen before tombstones are
dropped, never after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.model import DELETE, PUT
from ..functions.tables import written

#: Sequence numbers to a bucket: what one task sorts for one key at most.
BUCKET_SEQS = 1 << 20


def newest(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Each key's newest version, tombstones included, as of ``snapshot``; a partial maximum runs before the shuffle."""
    if snapshot is not None:
        log = log.where(F.col("seq") <= snapshot)
    rest = [c for c in log.columns if c != "key"]
    best = log.groupBy("key").agg(F.max_by(F.struct(*rest), F.col("seq")).alias("_v"))
    return best.select("key", *[F.col(f"_v.`{c}`").alias(c) for c in rest])


def latest(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Live keys and their values."""
    return newest(log, snapshot).where(F.col("vt") == PUT)


def latest_by_window(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The same by rank within each key: for logs whose keys have few versions each."""
    if snapshot is not None:
        log = log.where(F.col("seq") <= snapshot)
    first = Window.partitionBy("key").orderBy(F.col("seq").desc())
    return log.withColumn("_n", F.row_number().over(first)).where((F.col("_n") == 1) & (F.col("vt") == PUT)).drop("_n")


def multi_get(log: DataFrame, probes: DataFrame, bucket: int = BUCKET_SEQS, newest_seq: int | None = None) -> DataFrame:
    """For each probe (``probe_id``, ``key``, ``snapshot_seq``) the newest version at or below its snapshot.

    Adds ``seq``, ``vt`` and ``value`` of that version and ``status``: ``found``, ``deleted`` or ``missing``; a null snapshot reads the
    newest.  Log and probes meet in one sorted pass, not in a join of all pairs; a key with very many versions is
    spread over buckets of its sequence numbers, and each bucket gets the last version before it.  However many probes ask the same, it is asked
    once: the answers, a written table, are joined back.  ``newest_seq`` is the log's greatest sequence number where the caller knows it.
    """
    at = F.floor(F.col("seq") / bucket).cast("long").alias("_b")
    newest_seq = newest_seq if newest_seq is not None else log.agg(F.max("seq")).first()[0] or 0
    top = F.lit(newest_seq).cast("long")
    limit = F.least(F.coalesce(F.col("snapshot_seq"), top), top)
    version = F.struct("seq", "vt", "value")
    rows = log.select("key", "seq", at, F.lit(0).alias("_kind"), version.alias("_v"))
    asks = probes.select("key", limit.alias("seq")).distinct().select("key", "seq", at, F.lit(1).alias("_kind"), F.lit(None).cast(rows.schema["_v"].dataType).alias("_v"))
    seen = Window.partitionBy("key", "_b").orderBy("seq", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.unionByName(asks).withColumn("_hit", F.last("_v", ignorenulls=True).over(seen)).where(F.col("_kind") == 1)
    if newest_seq < bucket:  # one bucket: nothing to carry into it
        found = local.select("key", F.col("seq").alias("_limit"), F.col("_hit").alias("_v"))
    else:
        ends = log.select("key", at, version.alias("_v")).groupBy("key", "_b").agg(F.max_by("_v", F.col("_v.seq")).alias("_end"))
        wanted = asks.select("key", "_b").distinct().withColumn("_end", F.lit(None).cast(ends.schema["_end"].dataType))
        line = ends.unionByName(wanted).groupBy("key", "_b").agg(F.first("_end", ignorenulls=True).alias("_end"))
        earlier = Window.partitionBy("key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        carry = line.withColumn("_carry", F.last("_end", ignorenulls=True).over(earlier)).select("key", "_b", "_carry")
        found = local.join(carry, ["key", "_b"], "left").select("key", F.col("seq").alias("_limit"), F.coalesce("_hit", "_carry").alias("_v"))
    asked = probes.select("probe_id", "key", "snapshot_seq", limit.alias("_limit"))
    return _answers(asked.join(written(found, "answers"), ["key", "_limit"], "left"))


def _answers(found: DataFrame) -> DataFrame:
    status = F.when(F.col("_v").isNull(), "missing").when(F.col("_v.vt") == DELETE, "deleted").otherwise("found")
    return found.select("probe_id", "key", "snapshot_seq", F.col("_v.seq").alias("seq"), F.col("_v.vt").alias("vt"), F.when(F.col("_v.vt") == PUT, F.col("_v.value")).alias("value"), status.alias("status"))


def get(log: DataFrame, key, snapshot: int | None = None) -> DataFrame:
    """The newest version of one key, or no row; key and sequence filters reach the scan."""
    one = log.where(F.col("key") == F.lit(key))
    if snapshot is not None:
        one = one.where(F.col("seq") <= snapshot)
    return one.orderBy(F.col("seq").desc()).limit(1).where(F.col("vt") == PUT)


def layered_get(layers: list[DataFrame], probes: DataFrame) -> DataFrame:
    """For each probe (``key``) the version of the first layer that has the key; ``layer`` counts from 0.

    Layers are alike in columns; within a layer the newest version counts.
    """
    every = layers[0].withColumn("layer", F.lit(0))
    for i, df in enumerate(layers[1:], 1):
        every = every.unionByName(df.withColumn("layer", F.lit(i)))
    rest = [c for c in every.columns if c != "key"]
    found = every.join(probes.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.max_by(F.struct(*rest), F.struct(-F.col("layer"), F.col("seq"))).alias("_v"))
    return found.select("key", *[F.col(f"_v.`{c}`").alias(c) for c in rest])


def history(log: DataFrame, bucket: int = BUCKET_SEQS, newest_seq: int | None = None) -> DataFrame:
    """Every version with ``next_seq``: it is visible from ``seq`` up to, not including, that; null for the newest.

    Sorted within a key's buckets; a bucket's last version gets its successor from the table of buckets.
    """
    newest_seq = newest_seq if newest_seq is not None else log.agg(F.max("seq")).first()[0] or 0
    if newest_seq < bucket:  # one bucket
        return log.withColumn("next_seq", F.lead("seq").over(Window.partitionBy("key").orderBy("seq")))
    rows = log.withColumn("_b", F.floor(F.col("seq") / bucket).cast("long"))
    first = rows.groupBy("key", "_b").agg(F.min("seq").alias("_first"))
    after = first.withColumn("_after", F.lead("_first").over(Window.partitionBy("key").orderBy("_b"))).select("key", "_b", "_after")
    inner = F.lead("seq").over(Window.partitionBy("key", "_b").orderBy("seq"))
    return rows.withColumn("_inner", inner).join(after, ["key", "_b"]).withColumn("next_seq", F.coalesce("_inner", "_after")).drop("_b", "_inner", "_after")


def visible_to(snapshots: list[int], seq: Column, next_seq: Column) -> Column:
    """Whether any of the snapshots, or a reader of the newest state, sees the version."""
    seen = next_seq.isNull()
    for s in snapshots:
        seen = seen | ((seq <= s) & (next_seq > s))
    return seen


def scan(log: DataFrame, low=None, high=None, snapshot: int | None = None, reverse: bool = False) -> DataFrame:
    """Live entries with low <= key < high in key order; either bound may be None.  Bounds reach the scan before any shuffle."""
    if low is not None:
        log = log.where(F.col("key") >= F.lit(low))
    if high is not None:
        log = log.where(F.col("key") < F.lit(high))
    key = F.col("key")
    return latest(log, snapshot).orderBy(key.desc() if reverse else key.asc())


def seek(state: DataFrame, target, how: str = "ge") -> DataFrame:
    """The entry at a cursor's new place: first key >= target (``ge``), last key < target (``lt``), ``first`` or ``last``; or no row."""
    key = F.col("key")
    if how == "ge":
        return state.where(key >= F.lit(target)).orderBy(key).limit(1)
    if how == "lt":
        return state.where(key < F.lit(target)).orderBy(key.desc()).limit(1)
    if how in ("first", "last"):
        return state.orderBy(key if how == "first" else key.desc()).limit(1)
    raise ValueError(f"unknown seek {how!r}")


def seek_many(state: DataFrame, targets: DataFrame, how: str = "ge") -> DataFrame:
    """For each ``target`` the key that :func:`seek` would land on, as ``found`` (null: past the end).

    Keys and targets are sorted together by range; within a part a running minimum or maximum answers, and a
    part that can't answer asks the parts beside it, of which there are few.
    """
    from ..functions.tables import in_order

    if how not in ("ge", "lt"):
        raise ValueError(f"unknown seek {how!r}")
    kind = state.schema["key"].dataType
    targets = targets.select(F.col("target").cast(kind).alias("target"))
    keys = state.select(F.col("key").alias("k"), F.lit(1 if how == "ge" else 0).alias("kind"), F.lit(None).cast(kind).alias("target"), F.col("key").alias("hit"))
    asks = targets.select(F.col("target").alias("k"), F.lit(0 if how == "ge" else -1).alias("kind"), F.col("target"), F.lit(None).cast(kind).alias("hit"))
    # ge: targets stand before equal keys and look ahead; lt: they stand before equal keys and look back.
    run = in_order(written(keys.unionByName(asks), "seek"), F.col("k"), F.col("kind"))
    # Both look back over a growing frame, ge from the far end: a frame that shrinks towards the end would be gone through anew for each row.
    ahead = how == "ge"
    back = lambda c: (F.col(c).desc() if ahead else F.col(c).asc())
    own = Window.partitionBy("part").orderBy(back("at")).rowsBetween(Window.unboundedPreceding, 0)
    beside = Window.orderBy(back("part")).rowsBetween(Window.unboundedPreceding, -1)
    near = F.last("hit", ignorenulls=True).over(own)
    edge = run.groupBy("part").agg((F.min if ahead else F.max)("hit").alias("edge")).withColumn("carry", F.last("edge", ignorenulls=True).over(beside))
    return run.withColumn("near", near).where("target is not null").join(edge, "part").select("target", F.coalesce("near", "carry").alias("found"))


def contains(state: DataFrame, probes: DataFrame) -> DataFrame:
    """Probes whose key the state has."""
    return probes.join(state.select("key"), "key", "left_semi")
