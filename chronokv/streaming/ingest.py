"""Streams of operations: the latest state as a running aggregate, and appends into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.model import PUT


def latest_state(ops: DataFrame) -> DataFrame:
    """Each key's newest version of a stream with ``key``, ``seq``, ``vt``, ``value``; late and replayed rows don't matter.

    State is one row for each key; tombstones stay in it, or an older put that comes late would revive a key.
    """
    rest = [c for c in ops.columns if c != "key"]
    best = ops.groupBy("key").agg(F.max_by(F.struct(*rest), F.col("seq")).alias("v"))
    return best.select("key", *[F.col(f"v.`{c}`").alias(c) for c in rest])


def live(state: DataFrame) -> DataFrame:
    return state.where(F.col("vt") == PUT)


def into_store(ops: DataFrame, store, checkpoint: str, source: str = "stream"):
    """Append a stream with ``key``, ``vt``, ``value`` and ``order`` to a store, a micro-batch at a time; the running query.

    A micro-batch that is replayed after a failure is appended once.
    """
    from ..functions.tables import in_order

    def append(batch: DataFrame, batch_id: int) -> None:
        rows = in_order(batch, F.col("order")).withColumn("pos", F.col("pos") - 1)
        store.append(rows, batch_id, source)

    return ops.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream of an aggregate over what there is now; its final rows, from a written table in ``folder``."""
    last: list[str] = []

    def keep(batch: DataFrame, batch_id: int) -> None:
        path = f"{folder}/rows-{batch_id}"
        batch.write.mode("overwrite").parquet(path)
        last[:] = [path]

    q = stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(last[0]) if last else spark.createDataFrame([], stream.schema)
