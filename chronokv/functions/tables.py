"""Written tables and positions in a global order, without a task that sees all rows."""

from __future__ import annotations

import itertools
import operator
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_dir: list[str] = []
#: Rows, and bytes of texts and binary values, of an Arrow batch that Python makes.
BATCH_ROWS, BATCH_BYTES = 1 << 14, 8 << 20


def row_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Runs of rows with an equal first value, as (value, rows), of Arrow batches in its order: one call of Python serves many small groups."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    return itertools.groupby(rows, operator.itemgetter(0))


def record_batches(rows: Iterable[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """The rows as Arrow batches of a bounded size: however many rows a task has, a worker holds one batch of them."""
    held, size = [], 0
    made = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], k) for i, k in enumerate(kinds)], names)
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, (bytes, str)))
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; on a local master without it, a temporary folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="chronokv-"))
    return _own_dir[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_order(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``pos`` (from 1, in the given order), ``part`` and ``at`` (place in the part, from 0).

    Rows are dealt by range and sorted within a part, so no task sees all; a part's place is the number of rows in
    those before it.  The one window without a partition runs over a row for each part.
    """
    one = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    run = written(one, "run").withColumn("part", F.shiftright("_m", 33).cast("int")).withColumn("at", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = run.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    return run.join(base, "part").withColumn("pos", F.col("_base") + F.col("at") + 1).drop("_base")


def with_previous(run: DataFrame, column: str, out: str) -> DataFrame:
    """``run`` from :func:`in_order` with ``out``, the value of ``column`` one position before."""
    last = run.groupBy("part").agg(F.max_by(column, "at").alias("_last"))
    carry = last.select("part", F.lag("_last").over(Window.orderBy("part")).alias("_carry"))
    inner = F.lag(column).over(Window.partitionBy("part").orderBy("at"))
    return run.withColumn("_inner", inner).join(carry, "part").withColumn(out, F.when(F.col("at") == 0, F.col("_carry")).otherwise(F.col("_inner"))).drop("_inner", "_carry")
