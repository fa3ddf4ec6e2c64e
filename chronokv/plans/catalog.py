"""The queries over the testdata's change log, and the SQL that each one equals.

``oplog`` is made of events: sequence number event_id + 1, an error is a delete, anything else a put of its properties; ``run`` of
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codec, keys
from ..functions.model import Options
from ..functions.tables import in_order, record_batches, row_groups, shared_dir, with_previous, written
from ..operators import batches, compaction, manifest, reads, runs
from ..sources import tables, wal
from ..sources.store import open_store
from ..streaming import ingest

SNAPSHOT = 5000
SNAPSHOTS = [3000, 7000, 10000]
RUN_FILE, RUN_BLOCK = 512, 1024
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function as the query of its name, and the SQL with the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def padded(c: Column, n: int = 8) -> Column:
    return F.lpad(c.cast("string"), n, "0")


# Relations that several queries share, in Spark and in SQL

_OPLOG = """oplog AS (SELECT lpad(CAST(user_id AS VARCHAR), 8, '0') AS key, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS vt,
  CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value, user_id FROM events)"""
_LATEST = f"""{_OPLOG}, newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM oplog) WHERE rn = 1),
state AS (SELECT key, seq, value FROM newest WHERE vt = 1)"""
_HISTORY = f"{_OPLOG}, versions AS (SELECT *, lead(seq) OVER (PARTITION BY key ORDER BY seq) AS next_seq FROM oplog)"
_KEPT = "(next_seq IS NULL" + "".join(f" OR (seq <= {s} AND next_seq > {s})" for s in SNAPSHOTS) + ")"
_OPS = f"{_OPLOG}, ops AS (SELECT (seq - 1) // 10 AS batch_id, (seq - 1) % 10 AS i, vt, key, value FROM oplog)"
_BYTES = "strlen(key) + 8 + coalesce(strlen(value), 0)"
_FILES = f"""{_OPLOG}, files AS (
  SELECT 0 AS level, ((seq - 1) // 500) * 100 + user_id // 30 AS number, CAST(sum({_BYTES}) AS BIGINT) AS file_size, count(*) AS n_entries, min(key) AS lo, max(key) AS hi FROM oplog GROUP BY 2
  UNION ALL SELECT 1, 100000 + user_id // 10, CAST(sum({_BYTES}) AS BIGINT), count(*), min(key), max(key) FROM oplog GROUP BY 2
  UNION ALL SELECT 2, 200000 + user_id // 25, CAST(sum({_BYTES}) AS BIGINT), count(*), min(key), max(key) FROM oplog WHERE (user_id // 25) % 2 = 0 GROUP BY 2)"""
_SHARED = "coalesce(list_min(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: substring({a}, i, 1) <> substring({b}, i, 1))) - 1, least(length({a}), length({b})))"


def _vlen(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} < {1 << 7 * n} THEN {n}" for n in range(1, 9)) + " ELSE 9 END"


_RUN = f"""entries AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS key, o_orderpriority AS value FROM orders),
placed AS (SELECT key, value, row_number() OVER (ORDER BY key) AS pos, lag(key) OVER (ORDER BY key) AS prev_key FROM entries),
filed AS (SELECT *, (pos - 1) // {RUN_FILE} AS file_no, (pos - 1) % {RUN_FILE} AS in_file FROM placed),
shares AS (SELECT *, in_file % 16 = 0 AS restart, CAST(CASE WHEN in_file % 16 = 0 THEN 0 ELSE {_SHARED.format(a="key", b="prev_key")} END AS BIGINT) AS shared FROM filed),
run AS (SELECT *, CAST({_vlen("shared")} + {_vlen("length(key) - shared")} + {_vlen("length(value)")} + length(key) - shared + length(value) AS BIGINT) AS entry_bytes FROM shares)"""
_CUT = f"""{_RUN}, cut AS (SELECT file_no, in_file, CAST(0 AS BIGINT) AS block_no, CASE WHEN entry_bytes >= {RUN_BLOCK} THEN 0 ELSE entry_bytes END AS used, entry_bytes >= {RUN_BLOCK} AS closed FROM run WHERE in_file = 0
  UNION ALL SELECT r.file_no, r.in_file, c.block_no + CASE WHEN c.closed THEN 1 ELSE 0 END, CASE WHEN c.used + r.entry_bytes >= {RUN_BLOCK} THEN 0 ELSE c.used + r.entry_bytes END, c.used + r.entry_bytes >= {RUN_BLOCK}
  FROM cut c JOIN run r ON r.file_no = c.file_no AND r.in_file = c.in_file + 1),
blocks AS (SELECT run.*, cut.block_no FROM run JOIN cut USING (file_no, in_file)),
sized AS (SELECT file_no, block_no, count(*) AS n_entries, min(key) AS first_key, max(key) AS last_key, CAST(sum(entry_bytes) AS BIGINT) AS size FROM blocks GROUP BY ALL),
following AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY file_no ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
  lead(first_key) OVER (PARTITION BY file_no ORDER BY block_no) AS next_key FROM sized),
lengths AS (SELECT *, {_SHARED.format(a="last_key", b="next_key")} AS n FROM following),
block_index AS (SELECT * EXCLUDE (n, next_key), CASE WHEN next_key IS NULL THEN last_key WHEN n < least(length(last_key), length(next_key)) AND ascii(substring(last_key, n + 1, 1)) + 1 < ascii(substring(next_key, n + 1, 1))
  THEN substring(last_key, 1, n) || chr(ascii(substring(last_key, n + 1, 1)) + 1) ELSE last_key END AS separator FROM lengths)"""


def oplog(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    put = F.col("event_type") != "error"
    return e.select(padded(F.col("user_id")).alias("key"), (F.col("event_id") + 1).alias("seq"), F.when(put, 1).otherwise(0).alias("vt"), F.when(put, F.col("props")).alias("value"), "user_id")


def log(spark: SparkSession, d: str) -> DataFrame:
    return oplog(spark, d).drop("user_id")


def ops(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("seq") - 1
    return oplog(spark, d).select(F.floor(at / 10).cast("long").alias("batch_id"), (at % 10).alias("i"), "vt", "key", "value")


def level_files(spark: SparkSession, d: str) -> DataFrame:
    rows = oplog(spark, d)
    size = F.octet_length("key") + 8 + F.coalesce(F.octet_length("value"), F.lit(0))
    chunk = lambda n: F.floor(F.col("user_id") / n).cast("long")
    out = None
    for level, number, some in ((0, F.floor((F.col("seq") - 1) / 500) * 100 + chunk(30), F.lit(True)), (1, 100000 + chunk(10), F.lit(True)), (2, 200000 + chunk(25), chunk(25) % 2 == 0)):
        part = manifest.describe(rows.where(some).withColumn("number", number.cast("long")), ["number"], size).withColumn("level", F.lit(level))
        out = part if out is None else out.unionByName(part)
    return out


def order_run(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return runs.sorted_run(o.select(padded(F.col("o_orderkey"), 10).alias("key"), F.col("o_orderpriority").alias("value")), file_entries=RUN_FILE)


def targets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(padded(F.col("c_custkey") * 3 % 200).alias("target")).distinct()


_TARGETS = "targets AS (SELECT DISTINCT lpad(CAST(c_custkey * 3 % 200 AS VARCHAR), 8, '0') AS target FROM customer)"

# Reads


@query(f"WITH {_LATEST} SELECT key, seq, value FROM state")
def latest_state(spark, d):
    return reads.latest(log(spark, d)).select("key", "seq", "value")


@query(f"WITH {_LATEST} SELECT key, seq, value FROM state")
def latest_state_window(spark, d):
    return reads.latest_by_window(log(spark, d)).select("key", "seq", "value")


@query(f"WITH {_LATEST.replace('FROM oplog)', f'FROM oplog WHERE seq <= {SNAPSHOT})')} SELECT key, seq, value FROM state")
def snapshot_state(spark, d):
    return reads.latest(log(spark, d), SNAPSHOT).select("key", "seq", "value")


_STATUS = "CASE WHEN o.seq IS NULL THEN 'missing' WHEN o.vt = 0 THEN 'deleted' ELSE 'found' END AS status"


@query(f"""WITH {_OPLOG}, probes AS (SELECT c_custkey AS probe_id, lpad(CAST(c_custkey % 200 AS VARCHAR), 8, '0') AS key, c_custkey * 7 % 10000 AS snapshot_seq FROM customer)
SELECT p.probe_id, p.key, p.snapshot_seq, o.seq, o.vt, o.value, {_STATUS} FROM probes p ASOF LEFT JOIN oplog o ON p.key = o.key AND p.snapshot_seq >= o.seq""")
def multi_get_asof(spark, d):
    probes = table(spark, d, "customer").select(F.col("c_custkey").alias("probe_id"), padded(F.col("c_custkey") % 200).alias("key"), (F.col("c_custkey") * 7 % 10000).alias("snapshot_seq"))
    return reads.multi_get(log(spark, d), probes)


@query(f"""WITH {_LATEST}, probes AS (SELECT c_custkey AS probe_id, lpad(CAST(c_custkey % 300 AS VARCHAR), 8, '0') AS key FROM customer)
SELECT p.probe_id, p.key, o.seq, o.vt, o.value, {_STATUS} FROM probes p LEFT JOIN newest o ON p.key = o.key""")
def multi_get_missing(spark, d):
    probes = table(spark, d, "customer").select(F.col("c_custkey").alias("probe_id"), padded(F.col("c_custkey") % 300).alias("key"), F.lit(None).cast("long").alias("snapshot_seq"))
    return reads.multi_get(log(spark, d), probes).drop("snapshot_seq")


@query(f"""WITH {_OPLOG}, layered AS (SELECT *, CASE WHEN seq > 8000 THEN 0 WHEN seq > 4000 THEN 1 ELSE 2 END AS layer FROM oplog),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY layer, seq DESC) AS rn FROM layered) SELECT key, seq, vt, value, layer FROM ranked WHERE rn = 1""")
def layered_get(spark, d):
    every = log(spark, d)
    seq = F.col("seq")
    probes = every.select("key").distinct()
    return reads.layered_get([every.where(seq > 8000), every.where((seq > 4000) & (seq <= 8000)), every.where(seq <= 4000)], probes)


@query(f"WITH {_OPLOG} SELECT key, seq, value FROM oplog WHERE key = '00000042' AND vt = 1 AND seq = (SELECT max(seq) FROM oplog WHERE key = '00000042')")
def point_get(spark, d):
    return reads.get(log(spark, d), "00000042").select("key", "seq", "value")


@query(f"WITH {_HISTORY} SELECT key, seq, vt, next_seq FROM versions")
def version_history(spark, d):
    return reads.history(log(spark, d)).select("key", "seq", "vt", "next_seq")


@query(f"WITH {_HISTORY} SELECT key, count(*) AS n_shadowed FROM versions WHERE next_seq IS NOT NULL GROUP BY key")
def shadowed_versions(spark, d):
    return reads.history(log(spark, d)).where("next_seq is not null").groupBy("key").agg(F.count("*").alias("n_shadowed"))


@query(f"WITH {_HISTORY} SELECT key, count(*) AS n_versions, count(*) FILTER (WHERE NOT {_KEPT}) AS n_droppable FROM versions GROUP BY key")
def gc_candidates(spark, d):
    return compaction.gc_counts(log(spark, d), SNAPSHOTS)


@query(f"WITH {_OPLOG} SELECT key, count(*) FILTER (WHERE vt = 1) AS n_puts, count(*) FILTER (WHERE vt = 0) AS n_deletes FROM oplog GROUP BY key")
def tombstone_stats(spark, d):
    return log(spark, d).groupBy("key").agg(F.count_if(F.col("vt") == 1).alias("n_puts"), F.count_if(F.col("vt") == 0).alias("n_deletes"))


@query(f"WITH {_OPLOG} SELECT key, seq, vt, row_number() OVER (ORDER BY key, seq DESC, vt DESC) AS pos FROM oplog")
def internal_key_order(spark, d):
    return in_order(log(spark, d).select("key", "seq", "vt"), F.col("key"), F.col("seq").desc(), F.col("vt").desc()).select("key", "seq", "vt", "pos")


@query(f"WITH {_LATEST} SELECT key, value, row_number() OVER (ORDER BY key) AS pos FROM state")
def forward_scan(spark, d):
    state = written(reads.latest(log(spark, d)).select("key", "value"), "state")  # else the sampling for the order would make it once more
    return in_order(state, F.col("key")).select("key", "value", "pos")


@query(f"WITH {_LATEST} SELECT key, value, row_number() OVER (ORDER BY key DESC) AS pos FROM state")
def reverse_scan(spark, d):
    state = written(reads.latest(log(spark, d)).select("key", "value"), "state")
    return in_order(state, F.col("key").desc()).select("key", "value", "pos")


@query(f"WITH {_LATEST} SELECT key, value FROM state WHERE key >= '00000020' AND key < '00000060'")
def range_scan(spark, d):
    return reads.scan(log(spark, d), "00000020", "00000060").select("key", "value")


@query(f"WITH {_LATEST}, {_TARGETS} SELECT target, (SELECT min(key) FROM state WHERE key >= target) AS found FROM targets")
def seek_ge(spark, d):
    return reads.seek_many(reads.latest(log(spark, d)), targets(spark, d), "ge")


@query(f"WITH {_LATEST}, {_TARGETS} SELECT target, (SELECT max(key) FROM state WHERE key < target) AS found FROM targets")
def seek_lt(spark, d):
    return reads.seek_many(reads.latest(log(spark, d)), targets(spark, d), "lt")


@query(f"WITH {_LATEST} SELECT key, value FROM state WHERE key = (SELECT min(key) FROM state)")
def seek_first(spark, d):
    return reads.seek(reads.latest(log(spark, d)).select("key", "value"), None, "first")


@query(f"WITH {_LATEST} SELECT key, value FROM state WHERE key = (SELECT max(key) FROM state)")
def seek_last(spark, d):
    return reads.seek(reads.latest(log(spark, d)).select("key", "value"), None, "last")


@query(f"WITH {_LATEST}, {_TARGETS} SELECT target AS key FROM targets WHERE target IN (SELECT key FROM state)")
def contains_keys(spark, d):
    return reads.contains(reads.latest(log(spark, d)), targets(spark, d).withColumnRenamed("target", "key"))


@query(f"WITH {_LATEST} SELECT count(*) AS n_keys, CAST(sum(strlen(key) + strlen(value)) AS BIGINT) AS n_bytes FROM state")
def memdb_stats(spark, d):
    return reads.latest(log(spark, d)).agg(F.count("*").alias("n_keys"), F.sum(F.octet_length("key") + F.octet_length("value")).alias("n_bytes"))


# Batches


@query(f"WITH {_OPS}, n AS (SELECT batch_id, count(*) AS n_ops FROM ops GROUP BY 1) SELECT batch_id, n_ops, CAST(1 + coalesce(sum(n_ops) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_seq FROM n")
def batch_sequence(spark, d):
    return batches.sequence_batches(ops(spark, d).groupBy("batch_id").agg(F.count("*").alias("n_ops")), group=100).select("batch_id", "n_ops", "first_seq")


@query(f"WITH {_OPS} SELECT key, batch_id * 10 + i + 1 AS seq, vt, value FROM ops")
def batch_apply(spark, d):
    made = ops(spark, d).groupBy("batch_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "vt", "key", "value"))), lambda x: F.struct(x["vt"].alias("vt"), x["key"].alias("key"), x["value"].alias("value"))).alias("ops"))
    return batches.to_log(made)


@query(f"WITH {_OPS} SELECT batch_id // 5 AS group_id, count(*) AS n_ops, string_agg(vt || key, ',' ORDER BY batch_id, i) AS ops FROM ops GROUP BY 1")
def batch_concat(spark, d):
    rows = batches.concatenated(ops(spark, d).withColumn("group_id", F.floor(F.col("batch_id") / 5).cast("long")))
    return rows.select("group_id", "n_ops", F.array_join(F.transform("ops", lambda x: F.concat(x["vt"].cast("string"), x["key"])), ",").alias("ops"))


@query(f"WITH {_OPS} SELECT batch_id, count(*) AS n_ops, CAST(12 + sum(1 + {_vlen('strlen(key)')} + strlen(key) + CASE WHEN vt = 1 THEN {_vlen('strlen(value)')} + strlen(value) ELSE 0 END) AS BIGINT) AS n_bytes FROM ops GROUP BY 1")
def batch_sizes(spark, d):
    return batches.sizes(ops(spark, d))


@query(f"WITH {_OPLOG} SELECT (seq - 1) // 1000 AS part, CAST(sum({_BYTES}) AS BIGINT) AS n_bytes, count(*) AS n_entries FROM oplog GROUP BY 1")
def memtable_usage(spark, d):
    return batches.memory_usage(log(spark, d).withColumn("part", F.floor((F.col("seq") - 1) / 1000).cast("long")), ["part"])


# Scalar functions


@query(f"WITH {_OPLOG} SELECT seq, vt, seq * 256 + vt AS tag FROM oplog")
def pack_tag(spark, d):
    return log(spark, d).select("seq", "vt", keys.pack_tag(F.col("seq"), F.col("vt")).cast("long").alias("tag"))


@query(f"WITH {_OPLOG} SELECT seq * 256 + vt AS tag, seq, vt FROM oplog")
def unpack_tag(spark, d):
    tagged = log(spark, d).select(keys.pack_tag(F.col("seq"), F.col("vt")).alias("t"))
    return tagged.select(F.col("t").cast("long").alias("tag"), keys.unpack_seq(F.col("t")).alias("seq"), (F.col("t") % 256).cast("int").alias("vt"))


def _wide(*factors: Column) -> Column:
    """A product of whole numbers as a decimal(38,0)."""
    return functools.reduce(lambda a, b: (a * b.cast("decimal(38,0)")).cast("decimal(38,0)"), factors[1:], factors[0].cast("decimal(38,0)"))


@query(f"WITH {_OPLOG}, v AS (SELECT seq, seq * seq * seq * 1000 AS v FROM oplog) SELECT seq, {_vlen('v')} AS n FROM v")
def varint_len(spark, d):
    """From sequence number 209,716 on a long can't hold the value, and the SQL fails: decimals give its length as well."""
    return log(spark, d).select("seq", keys.wide_varint_length(_wide(F.col("seq"), F.col("seq"), F.col("seq"), F.lit(1000))).alias("n"))


@query(f"WITH {_OPLOG}, k AS (SELECT DISTINCT key FROM oplog) SELECT key, CASE WHEN key = '' THEN '' ELSE chr(ascii(substring(key, 1, 1)) + 1) END AS successor FROM k")
def short_successor(spark, d):
    return log(spark, d).select("key").distinct().select("key", keys.short_successor(F.col("key")).cast("string").alias("successor"))


@query("SELECT o_orderkey, greatest(1024, least(4194304, o_orderkey * 700)) AS block_size FROM orders")
def clip_options(spark, d):
    return table(spark, d, "orders").select("o_orderkey", keys.clip(F.col("o_orderkey") * 700, 1024, 4194304).cast("long").alias("block_size"))


@query("""WITH RECURSIVE seeds AS (SELECT DISTINCT user_id AS seed FROM events), r AS (SELECT seed, 0 AS i, CASE WHEN seed = 0 THEN 1 ELSE seed END AS s FROM seeds
  UNION ALL SELECT seed, i + 1, s * 16807 % 2147483647 FROM r WHERE i < 20) SELECT seed, s AS value FROM r WHERE i = 20""")
def lcg_sequence(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("seed")).distinct().select("seed", keys.park_miller(F.col("seed"), F.lit(20)).alias("value"))


_CRC = f"""bits AS (SELECT i AS n, i AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(c // 2, {codec.CASTAGNOLI_REVERSED}) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
steps AS MATERIALIZED (SELECT n, c FROM bits WHERE k = 8),
r AS (SELECT seq, value, 0 AS i, 4294967295 AS c FROM oplog WHERE value IS NOT NULL
  UNION ALL SELECT seq, value, i + 1, xor(steps.c, r.c // 256) FROM r JOIN steps ON steps.n = xor(r.c, ascii(substring(value, i + 1, 1))) % 256 WHERE i < strlen(value))"""


@query(f"""WITH RECURSIVE {_OPLOG}, {_CRC} SELECT seq, CAST(xor(c, 4294967295) AS BIGINT) AS crc32c FROM r WHERE i = strlen(value) UNION ALL SELECT seq, NULL FROM oplog WHERE value IS NULL""")
def crc32c_values(spark, d):
    @F.pandas_udf("long")
    def crc(values: pd.Series) -> pd.Series:
        return pd.Series(codec.crc32c_many(None if v is None else v.encode() for v in values), dtype="Int64")

    return log(spark, d).select("seq", crc("value").alias("crc32c"))


_RANDOM = """WITH RECURSIVE seeds AS (SELECT DISTINCT user_id AS seed FROM events), r AS (SELECT seed, 0 AS i, CASE WHEN seed = 0 THEN 1 ELSE seed END AS s FROM seeds
  UNION ALL SELECT seed, i + 1, s * 16807 % 2147483647 FROM r WHERE i < 20)"""


@query(f"{_RANDOM} SELECT seed, s % 1000 AS value FROM r WHERE i = 20")
def uniform_sequence(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("seed")).distinct().select("seed", keys.uniform(F.col("seed"), F.lit(20), F.lit(1000)).alias("value"))


@query(f"{_RANDOM} SELECT a.seed, b.s % CAST(pow(2, a.s % 11) AS BIGINT) AS value FROM r a JOIN r b USING (seed) WHERE a.i = 19 AND b.i = 20")
def skewed_sequence(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("seed")).distinct().select("seed", keys.skewed(F.col("seed"), F.lit(10), 10).alias("value"))


def _varint_sql(v: str) -> str:
    return f"array_to_string(list_transform(range({_vlen(v)}), lambda j: printf('%02x', (({v}) >> (7 * j)::INT) & 127 | CASE WHEN j + 1 < {_vlen(v)} THEN 128 ELSE 0 END)), '')"


def _fixed_sql(v: str, n: int) -> str:
    return f"array_to_string(list_transform(range({n}), lambda j: printf('%02x', (({v}) >> (8 * j)::INT) & 255)), '')"


def _coded(df: DataFrame, f, schema: str) -> DataFrame:
    """Rows made of rows by a function of the byte formats, a batch at a time."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([f(r) for r in pdf.itertuples(index=False)], columns=[c.split()[0] for c in schema.split(", ")], dtype=object)  # else a null makes longs floats

    return df.mapInPandas(run, schema)


@query(f"WITH {_OPLOG}, v AS (SELECT seq, seq * seq * seq * 1000 AS v FROM oplog) SELECT seq, {_varint_sql('v')} AS coded, v AS decoded, {_vlen('v')} AS n FROM v")
def varint_bytes(spark, d):
    """From sequence number 209,716 on a long can't hold the value, and the SQL fails: its bytes are right all the same, ``decoded`` is null."""
    def code(r):
        v = r.seq ** 3 * 1000
        raw = codec.put_varint(v)
        value, at = codec.get_varint(raw + b"rest", bits=max(64, v.bit_length()))
        return r.seq, raw.hex(), _long(value), at

    return _coded(log(spark, d).select("seq"), code, "seq long, coded string, decoded long, n int")


def _long(v: int) -> int | None:
    """A value that a column of longs can hold, else null."""
    return v if v < 1 << 63 else None


@query(f"WITH {_OPLOG}, v AS (SELECT seq, seq * 40503 % 4294967296 AS a, seq * seq * 1000003 AS b FROM oplog) SELECT seq, {_fixed_sql('a', 4)} AS fixed32, {_fixed_sql('b', 8)} AS fixed64, a, b FROM v")
def fixed_bytes(spark, d):
    """From sequence number 3,036,996 on a long can't hold b, and the SQL fails: ``b`` is null, and ``fixed64`` too where 64 bits can't hold it."""
    def code(r):
        v = r.seq ** 2 * 1000003
        a, b = codec.put_fixed32(r.seq * 40503 % (1 << 32)), codec.put_fixed64(v) if v < 1 << 64 else None
        return r.seq, a.hex(), b.hex() if b else None, codec.get_fixed32(a), _long(codec.get_fixed64(b)) if b else None

    return _coded(log(spark, d).select("seq"), code, "seq long, fixed32 string, fixed64 string, a long, b long")


def _hex(x: str) -> str:
    return f"lower(hex(encode({x})))"


@query(f"WITH {_OPLOG} SELECT seq, {_varint_sql('strlen(key)')} || {_hex('key')} || {_varint_sql('coalesce(strlen(value), 0)')} || {_hex("coalesce(value, '')")} AS coded, key, coalesce(value, '') AS value FROM oplog")
def slice_bytes(spark, d):
    def code(r):
        raw = codec.put_slice(r.key.encode()) + codec.put_slice((r.value or "").encode())
        key, at = codec.get_slice(raw)
        value, _ = codec.get_slice(raw, at)
        return r.seq, raw.hex(), key.decode(), value.decode()

    return _coded(log(spark, d).select("seq", "key", "value"), code, "seq long, coded string, key string, value string")


@query(f"WITH {_OPLOG} SELECT seq, {_hex('key')} || {_fixed_sql('seq * 256 + vt', 8)} AS coded, key, vt FROM oplog")
def internal_key_bytes(spark, d):
    def code(r):
        raw = codec.encode_internal(r.key.encode(), r.seq, r.vt)
        key, seq, vt = codec.decode_internal(raw)
        return seq, raw.hex(), key.decode(), vt

    return _coded(log(spark, d).select("seq", "key", "vt"), code, "seq long, coded string, key string, vt int")


@query(f"""WITH {_OPS}, parts AS (SELECT *, CASE WHEN vt = 1 THEN '01' ELSE '00' END || {_varint_sql('strlen(key)')} || {_hex('key')} || CASE WHEN vt = 1 THEN {_varint_sql('strlen(value)')} || {_hex('value')} ELSE '' END AS part FROM ops)
SELECT batch_id, {_fixed_sql('batch_id * 10 + 1', 8)} || {_fixed_sql('count(*)', 4)} || string_agg(part, '' ORDER BY i) AS coded FROM parts GROUP BY batch_id""")
def batch_bytes(spark, d):
    def run(found):
        coded = ((n, b.contents().hex()) for n, b in _batches(found))
        return record_batches(coded, ["batch_id", "coded"], [pa.int64(), pa.string()])

    return _in_batches(spark, d).mapInArrow(run, "batch_id long, coded string")


def _in_batches(spark, d) -> DataFrame:
    """Operations side by side with those of their batch, in order: batches are so small that a call of Python for each would cost more than its work."""
    rows = ops(spark, d).select("batch_id", "i", "vt", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
    return rows.repartition("batch_id").sortWithinPartitions("batch_id", "i")


def _batches(found):
    """The number and the write batch of each group of such rows."""
    for n, rows in row_groups(found):
        yield n, codec.WriteBatch(((vt, key, value) for _, _, vt, key, value in rows), n * 10 + 1)


@query(f"WITH {_OPS} SELECT key, batch_id * 10 + i + 1 AS seq, vt, value FROM ops")
def batch_iterate(spark, d):
    """The batches as the bytes of a log, and back to rows."""
    def run(found):
        return record_batches(((b.contents(),) for _, b in _batches(found)), ["payload"], [pa.binary()])

    rows = wal.batches_of(_in_batches(spark, d).mapInArrow(run, "payload binary"))
    return rows.where("error is null").select(F.col("key").cast("string").alias("key"), "seq", F.col("vt").cast("int").alias("vt"), F.col("value").cast("string").alias("value"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 7 THEN o_orderkey % 10 END AS level, CASE WHEN o_orderkey % 10 >= 7 THEN 'level out of range' END AS error FROM orders")
def edit_levels(spark, d):
    def code(r):
        try:
            (level, _), = codec.decode_edit(codec.encode_edit({"deleted_files": [(r.level, 5)]}))["deleted_files"]
            return r.o_orderkey, level, None
        except codec.Corruption as e:
            return r.o_orderkey, None, e.message

    return _coded(table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 10).alias("level")), code, "o_orderkey long, level int, error string")


_DIGESTS = "digests AS (SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS h, lead(md5(CAST(event_id AS VARCHAR))) OVER (ORDER BY md5(CAST(event_id AS VARCHAR))) AS g FROM events)"
_BYTE = "list_position(list_transform(range(256), lambda j: printf('%02x', j)), substring({x}, 2 * ({i}) + 1, 2)) - 1"


@query(f"""WITH {_DIGESTS}, n AS (SELECT *, (SELECT min(j) FROM range(16) t(j) WHERE substring(h, 2 * j + 1, 2) <> substring(g, 2 * j + 1, 2)) AS n FROM digests WHERE g IS NOT NULL),
b AS (SELECT *, {_BYTE.format(x='h', i='n')} AS bh, {_BYTE.format(x='g', i='n')} AS bg FROM n)
SELECT event_id, n AS shared, CASE WHEN bh < 255 AND bh + 1 < bg THEN substring(h, 1, 2 * n) || printf('%02x', bh + 1) ELSE h END AS separator FROM b""")
def binary_separator(spark, d):
    rows = table(spark, d, "events").select("event_id", F.unhex(F.md5(F.col("event_id").cast("string"))).alias("key"))
    following = with_previous(in_order(rows, F.col("key").desc()), "key", "next").where("next is not null")
    sep = keys.shortest_separator(F.col("key"), F.col("next"))
    return following.select("event_id", keys.shared_prefix(F.col("key"), F.col("next")).cast("long").alias("shared"), F.lower(F.hex(sep)).alias("separator"))


@query(f"""WITH k AS (SELECT event_id, repeat('ff', (event_id % 4)::INT) || CASE WHEN event_id % 5 = 0 THEN '' ELSE substring(md5(CAST(event_id AS VARCHAR)), 1, 6) END AS h FROM events),
n AS (SELECT *, (SELECT min(j) FROM range(len(h) // 2) t(j) WHERE substring(h, 2 * j + 1, 2) <> 'ff') AS n FROM k)
SELECT event_id, CASE WHEN n IS NULL THEN h ELSE substring(h, 1, 2 * n) || printf('%02x', {_BYTE.format(x='h', i='n')} + 1) END AS successor FROM n""")
def binary_successor(spark, d):
    tail = F.when(F.col("event_id") % 5 == 0, "").otherwise(F.substring(F.md5(F.col("event_id").cast("string")), 1, 6))
    rows = table(spark, d, "events").select("event_id", F.unhex(F.concat(F.repeat(F.lit("ff"), (F.col("event_id") % 4).cast("int")), tail)).alias("key"))
    return rows.select("event_id", F.lower(F.hex(keys.short_successor(F.col("key")))).alias("successor"))


_SEEKS = "state AS (SELECT DISTINCT md5(CAST(user_id AS VARCHAR)) AS key FROM events), asked AS (SELECT DISTINCT md5(CAST(c_custkey AS VARCHAR)) AS target FROM customer)"


def _binary_seek(spark, d, how: str) -> DataFrame:
    h = lambda name, c: table(spark, d, name).select(F.unhex(F.md5(F.col(c).cast("string"))).alias("k")).distinct()
    found = reads.seek_many(h("events", "user_id").withColumnRenamed("k", "key"), h("customer", "c_custkey").withColumnRenamed("k", "target"), how)
    return found.select(*[F.lower(F.hex(c)).alias(c) for c in ("target", "found")])


@query(f"WITH {_SEEKS} SELECT target, (SELECT min(key) FROM state WHERE key >= target) AS found FROM asked")
def binary_seek_ge(spark, d):
    return _binary_seek(spark, d, "ge")


@query(f"WITH {_SEEKS} SELECT target, (SELECT max(key) FROM state WHERE key < target) AS found FROM asked")
def binary_seek_lt(spark, d):
    return _binary_seek(spark, d, "lt")


@query(f"WITH {_LATEST}, none AS (SELECT * FROM state WHERE key > '~') SELECT (SELECT count(*) FROM none) AS n_rows, (SELECT min(key) FROM none WHERE key >= '0') AS seek_ge, (SELECT max(key) FROM none) AS last_key, (SELECT count(*) FROM none WHERE key = '00000042') AS n_found")
def empty_source(spark, d):
    """Every kind of read of a source without entries."""
    none = written(log(spark, d).where("key > '~'"), "none")
    state = reads.scan(none)
    ask = spark.range(1).select(F.lit("0").alias("target"))
    rows = state.agg(F.count("*").alias("n_rows"))
    seek = reads.seek_many(reads.latest(none), ask, "ge").select(F.col("found").alias("seek_ge"))
    last = reads.seek(state, None, "last").agg(F.max("key").alias("last_key"))
    found = reads.get(none, "00000042").agg(F.count("*").alias("n_found"))
    out = rows
    for one in (seek, last, found):  # each has one row
        out = out.join(F.broadcast(one))
    return out


# Runs and blocks


@query(f"WITH {_RUN} SELECT key, pos, file_no, restart, shared, entry_bytes FROM run")
def prefix_shared(spark, d):
    return order_run(spark, d).select("key", "pos", "file_no", "restart", "shared", "entry_bytes")


@query(f"WITH {_RUN} SELECT file_no, count(*) FILTER (WHERE restart) AS n_restarts, CAST(sum(entry_bytes) + 4 * count(*) FILTER (WHERE restart) + 4 AS BIGINT) AS n_bytes FROM run GROUP BY 1")
def restart_points(spark, d):
    r = order_run(spark, d).groupBy("file_no").agg(F.count_if("restart").alias("n_restarts"), F.sum("entry_bytes").alias("b"))
    return r.select("file_no", "n_restarts", (F.col("b") + 4 * F.col("n_restarts") + 4).alias("n_bytes"))


@query(f"WITH {_RUN} SELECT count(*) AS n_entries, count(*) FILTER (WHERE prev_key >= key) AS n_violations FROM run")
def run_order_check(spark, d):
    return runs.order_violations(order_run(spark, d))


@query(f"WITH RECURSIVE {_CUT} SELECT key, file_no, block_no FROM blocks")
def block_cut(spark, d):
    return runs.cut_blocks(order_run(spark, d), RUN_BLOCK).select("key", "file_no", "block_no")


@query(f'WITH RECURSIVE {_CUT} SELECT file_no, block_no, n_entries, first_key, last_key, size, "offset", separator FROM block_index')
def block_index(spark, d):
    return runs.block_index(runs.cut_blocks(order_run(spark, d), RUN_BLOCK))


@query(f"""WITH RECURSIVE {_CUT}, probes AS (SELECT DISTINCT lpad(CAST(c_custkey * 11 AS VARCHAR), 10, '0') AS key FROM customer), landed AS (SELECT p.key, (SELECT min(last_key) FROM block_index WHERE last_key >= p.key) AS last_key FROM probes p)
SELECT l.key, b.file_no, b.block_no, b.first_key <= l.key AS in_block FROM landed l LEFT JOIN block_index b USING (last_key)""")
def block_lookup(spark, d):
    index = runs.block_index(runs.cut_blocks(order_run(spark, d), RUN_BLOCK))
    return runs.lookup(index, table(spark, d, "customer").select(padded(F.col("c_custkey") * 11, 10).alias("key")))


@query("SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS key, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS rebuilt FROM orders")
def block_restore(spark, d):
    return runs.restored(order_run(spark, d))


# Files, levels and versions


@query(f"WITH {_FILES} SELECT level, number, n_entries, file_size, lo, hi, greatest(100, file_size // 16384) AS allowed_seeks FROM files")
def file_meta(spark, d):
    return level_files(spark, d).select("level", "number", "n_entries", "file_size", "lo", "hi", "allowed_seeks")


@query("SELECT o_orderkey, greatest(100, (o_orderkey * 100000) // 16384) AS allowed_seeks FROM orders")
def allowed_seeks(spark, d):
    return table(spark, d, "orders").select("o_orderkey", keys.allowed_seeks(F.col("o_orderkey") * 100000).alias("allowed_seeks"))


@query(f"""WITH {_FILES}, {_TARGETS}, landed AS (SELECT target AS key, (SELECT min(hi) FROM files WHERE level = 2 AND hi >= target) AS hi FROM targets)
SELECT l.key, f.number, f.lo <= l.key AS inside FROM landed l LEFT JOIN (SELECT * FROM files WHERE level = 2) f USING (hi)""")
def find_file(spark, d):
    return manifest.find_file(level_files(spark, d).where("level = 2"), targets(spark, d).withColumnRenamed("target", "key"))


@query(f"WITH {_FILES} SELECT level, number FROM files WHERE hi >= '00000047' AND lo <= '00000062'")
def overlapping_files(spark, d):
    return level_files(spark, d).where(manifest.overlaps(F.lit("00000047"), F.lit("00000062"))).select("level", "number")


@query(f"WITH {_FILES} SELECT level, number, CASE WHEN level = 0 THEN -number ELSE number END AS rank FROM files WHERE lo <= '00000042' AND hi >= '00000042'")
def probe_order(spark, d):
    return manifest.probe_order(level_files(spark, d), "00000042").select("level", "number", F.when(F.col("level") == 0, -F.col("number")).otherwise(F.col("number")).alias("rank"))


_ISLANDS = f"""{_FILES}, reach AS (SELECT *, max(hi) OVER (PARTITION BY level ORDER BY lo, hi, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM files),
isles AS (SELECT *, CAST(sum(CASE WHEN top IS NULL OR lo > top THEN 1 ELSE 0 END) OVER (PARTITION BY level ORDER BY lo, hi, number ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS island FROM reach)"""


@query(f"WITH {_ISLANDS} SELECT level, number, island FROM isles")
def overlap_islands(spark, d):
    return manifest.islands(level_files(spark, d)).select("level", "number", "island")


@query(f"WITH {_ISLANDS} SELECT level, number FROM isles i WHERE level = 0 AND EXISTS (SELECT 1 FROM isles h WHERE h.level = 0 AND h.island = i.island AND h.hi >= '00000047' AND h.lo <= '00000062')")
def l0_overlap_closure(spark, d):
    return manifest.overlap_closure(level_files(spark, d).where("level = 0"), "00000047", "00000062").select("level", "number")


@query(f"WITH {_FILES}, b AS (SELECT *, lag(hi) OVER (PARTITION BY level ORDER BY lo, number) AS before FROM files WHERE level > 0) SELECT count(*) AS n_files, count(*) FILTER (WHERE before >= lo) AS n_violations FROM b")
def level_overlap_check(spark, d):
    return manifest.overlap_violations(level_files(spark, d))


_EDIT = f"""{_FILES}, added AS (SELECT 1 AS level, 150000 + user_id // 30 AS number, CAST(sum({_BYTES}) AS BIGINT) AS file_size FROM oplog GROUP BY 2),
edited AS (SELECT level, number, file_size FROM files WHERE number % 7 <> 0 UNION ALL SELECT * FROM added)"""


def _edited(spark, d) -> tuple[DataFrame, DataFrame]:
    base = level_files(spark, d).select("level", "number", "file_size")
    size = F.octet_length("key") + 8 + F.coalesce(F.octet_length("value"), F.lit(0))
    added = oplog(spark, d).withColumn("number", (150000 + F.floor(F.col("user_id") / 30)).cast("long"))
    added = manifest.describe(added, ["number"], size).select(F.lit(1).alias("level"), "number", "file_size")
    return base, manifest.apply_edit(base, added, base.where("number % 7 = 0"))


@query(f"WITH {_EDIT} SELECT level, number, file_size FROM edited")
def version_apply(spark, d):
    return _edited(spark, d)[1]


@query(f"WITH {_EDIT} SELECT number FROM files UNION SELECT number FROM edited")
def live_files(spark, d):
    return manifest.live_files(*_edited(spark, d))


_LISTING = """listing AS (SELECT printf('db/%06d.ldb', number) AS path, 'TABLE' AS kind, number FROM files UNION ALL SELECT printf('db/%06d.log', o_orderkey), 'LOG', o_orderkey FROM orders WHERE o_orderkey < 40
  UNION ALL SELECT printf('db/MANIFEST-%06d', o_orderkey), 'MANIFEST', o_orderkey FROM orders WHERE o_orderkey < 9 UNION ALL SELECT printf('db/%06d.dbtmp', o_orderkey), 'TEMP', o_orderkey FROM orders WHERE o_orderkey < 4
  UNION ALL SELECT 'db/CURRENT', 'CURRENT', 0 UNION ALL SELECT 'db/LOCK', 'LOCK', 0 UNION ALL SELECT 'db/LOG.old', 'INFO_LOG', 0 UNION ALL SELECT 'db/notes.txt', NULL, NULL)"""


def _listing(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("n"))
    out = level_files(spark, d).select(keys.file_name("db", F.col("number"), "ldb").alias("path"))
    out = out.union(o.where("n < 40").select(keys.file_name("db", F.col("n"), "log"))).union(o.where("n < 9").select(F.format_string("db/MANIFEST-%06d", "n"))).union(o.where("n < 4").select(keys.file_name("db", F.col("n"), "dbtmp")))
    return out.union(spark.range(1).select(F.explode(F.array(*map(F.lit, ("db/CURRENT", "db/LOCK", "db/LOG.old", "db/notes.txt"))))))


@query(f"WITH {_FILES}, {_LISTING} SELECT path, kind, number FROM listing")
def file_name_parse(spark, d):
    return _listing(spark, d).select("path", keys.file_type(F.col("path")).alias("kind"), keys.file_number(F.col("path")).alias("number"))


@query(f"""WITH {_EDIT}, {_LISTING} SELECT path, kind, number FROM listing WHERE (kind = 'LOG' AND number < 20 AND number <> 12) OR (kind = 'MANIFEST' AND number < 5)
  OR (kind IN ('TABLE', 'TEMP') AND number NOT IN (SELECT number FROM edited))""")
def obsolete_files(spark, d):
    return manifest.obsolete(_listing(spark, d), manifest.live_files(_edited(spark, d)[1]), 20, 12, 5)


_SCORES = f"""{_FILES}, scores AS (SELECT level, count(*) AS n_files, CAST(sum(file_size) AS BIGINT) AS n_bytes,
  CAST(CASE WHEN level = 0 THEN count(*) * 1000 // 4 ELSE sum(file_size) * 1000 // (10485760 * CAST(pow(10, level - 1) AS BIGINT)) END AS BIGINT) AS score_milli FROM files GROUP BY level)"""


@query(f"WITH {_SCORES} SELECT level, n_files, n_bytes, score_milli, score_milli >= 1000 AS needs_compaction FROM scores")
def level_scores(spark, d):
    return manifest.level_scores(level_files(spark, d))


@query(f"WITH {_SCORES} SELECT level, score_milli, score_milli >= 1000 AS needs_compaction FROM scores ORDER BY score_milli DESC, level LIMIT 1")
def compaction_level(spark, d):
    return manifest.compaction_level(level_files(spark, d))


@query(f"""WITH {_FILES}, p(level, pointer) AS (VALUES (1, '00000045'), (2, '00000300')), r AS (SELECT f.level, f.number, row_number() OVER (PARTITION BY f.level ORDER BY CASE WHEN p.pointer IS NULL OR hi > p.pointer THEN 0 ELSE 1 END, lo, number) AS rn
  FROM files f LEFT JOIN p USING (level)) SELECT level, number FROM r WHERE rn = 1""")
def pick_file(spark, d):
    pointers = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.lit(k).alias("pointer")) for n, k in ((1, "00000045"), (2, "00000300"))])).alias("p")).select("p.*")
    return manifest.next_file(level_files(spark, d), pointers)


def _below(depth: int, of: int) -> str:
    return f"SELECT i.level, i.number, count(f.number) AS n_files, CAST(coalesce(sum(f.file_size), 0) AS BIGINT) AS n_bytes FROM files i LEFT JOIN files f ON f.level = i.level + {depth} AND f.lo <= i.hi AND f.hi >= i.lo WHERE i.level = {of} GROUP BY i.level, i.number"


@query(f"WITH {_FILES} {_below(2, 0)}")
def grandparent_overlap(spark, d):
    files = level_files(spark, d)
    return manifest.overlap_bytes(files.where("level = 0"), files, 2)


#: The files without the larger ones of level 1, so that there are gaps, and a limit that two files of level 2 pass.
_GAPS = f"""{_FILES}, gaps AS (SELECT * FROM files WHERE level <> 1 OR file_size * (SELECT count(*) FROM files WHERE level = 1) <= (SELECT sum(file_size) FROM files WHERE level = 1)),
bound AS (SELECT max(file_size) AS most FROM files WHERE level = 2)"""
_RANGES = "ranges AS (SELECT user_id // 7 AS number, min(key) AS lo, max(key) AS hi FROM oplog GROUP BY 1)"
_MET = """SELECT i.number, count(f.number) FILTER (WHERE f.level = 1) AS n1, count(f.number) FILTER (WHERE f.level = 2) AS n2, coalesce(sum(f.file_size) FILTER (WHERE f.level = 2), 0) AS beneath
  FROM {of} i LEFT JOIN gaps f ON f.level > 0 AND f.lo <= i.hi AND f.hi >= i.lo GROUP BY i.number"""


def _gaps(spark, d) -> tuple[DataFrame, int]:
    files = level_files(spark, d)
    one = files.where("level = 1").agg(F.count("*"), F.sum("file_size")).first()
    return files.where((F.col("level") != 1) | (F.col("file_size") * one[0] <= one[1])), files.where("level = 2").agg(F.max("file_size")).first()[0]


@query(f"""WITH {_GAPS}, l0 AS (SELECT * FROM files WHERE level = 0), b AS ({_MET.format(of="l0")}) SELECT number, n1 = 0 AND beneath <= most AS trivial FROM b, bound""")
def trivial_move(spark, d):
    files, most = _gaps(spark, d)
    below, beneath = (manifest.overlap_bytes(files.where("level = 0"), files, n).select("number", F.col("n_files").alias(f"n{n}"), F.col("n_bytes").alias(f"b{n}")) for n in (1, 2))
    return below.join(beneath, "number").select("number", ((F.col("n1") == 0) & (F.col("b2") <= most)).alias("trivial"))


@query(f"""WITH {_GAPS}, {_RANGES}, b AS ({_MET.format(of="ranges")}) SELECT number, CASE WHEN n1 > 0 OR beneath > most THEN 0 WHEN n2 > 0 THEN 1 ELSE 2 END AS level FROM b, bound""")
def flush_level(spark, d):
    files, most = _gaps(spark, d)
    ranges = oplog(spark, d).groupBy(F.floor(F.col("user_id") / 7).cast("long").alias("number")).agg(F.min("key").alias("lo"), F.max("key").alias("hi")).withColumn("level", F.lit(0))
    one = manifest.overlap_bytes(ranges, files, 1).select("number", F.col("n_files").alias("n1"))
    two = manifest.overlap_bytes(ranges, files, 2).select("number", F.col("n_files").alias("n2"), "n_bytes")
    level = F.when((F.col("n1") > 0) | (F.col("n_bytes") > most), 0).when(F.col("n2") > 0, 1).otherwise(2)
    return one.join(two, "number").select("number", level.alias("level"))


@query(f"WITH {_HISTORY} SELECT key, seq, vt, value FROM versions WHERE {_KEPT} AND NOT (vt = 0 AND seq <= {min(SNAPSHOTS)})")
def merge_compaction(spark, d):
    every = log(spark, d)
    seq = F.col("seq")
    return compaction.merge([every.where(seq > 8000), every.where((seq > 4000) & (seq <= 8000)), every.where(seq <= 4000)], SNAPSHOTS)


_CHAIN = f"""{_OPLOG}, placed AS (SELECT key, seq, (row_number() OVER (ORDER BY key, seq DESC) - 1) // 7 AS number FROM oplog),
chained AS (SELECT number, min(key) AS lo, max_by(seq, struct_pack(a := -rank, b := seq)) AS lo_seq, max(key) AS hi FROM (SELECT *, row_number() OVER (PARTITION BY number ORDER BY key, seq DESC) AS rank FROM placed) GROUP BY number)"""


@query(f"""WITH {_CHAIN}, b AS (SELECT *, lag(hi) OVER (ORDER BY number) AS before FROM chained), i AS (SELECT *, sum(CASE WHEN before = lo THEN 0 ELSE 1 END) OVER (ORDER BY number) AS island FROM b)
SELECT number, max(number) OVER (PARTITION BY island) AS last_number, max(number) OVER (PARTITION BY island) - number + 1 AS n_files FROM i""")
def boundary_inputs(spark, d):
    placed = in_order(log(spark, d).select("key", "seq"), F.col("key"), F.col("seq").desc()).withColumn("number", F.floor((F.col("pos") - 1) / 7).cast("long"))
    files = placed.groupBy("number").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.min_by("seq", "pos").alias("lo_seq"))
    return manifest.boundary_closure(files)


_SOME_EDITS = "edits AS (SELECT event_id AS edit_no, user_id % 3 AS level, event_id % 700 AS number, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'add' END AS what, strlen(props) AS size FROM events)"


@query(f"WITH {_SOME_EDITS}, r AS (SELECT *, row_number() OVER (PARTITION BY level, number ORDER BY edit_no DESC) AS rn FROM edits) SELECT level, number, edit_no, size FROM r WHERE rn = 1 AND what = 'add'")
def version_fold(spark, d):
    what = F.when(F.col("event_type") == "error", "delete").otherwise("add")
    edits = table(spark, d, "events").select(F.col("event_id").alias("edit_no"), (F.col("user_id") % 3).alias("level"), (F.col("event_id") % 700).alias("number"), what.alias("what"), F.octet_length("props").cast("long").alias("size"))
    return tables.fold_edits(edits)


@query(f"WITH {_SOME_EDITS}, r AS (SELECT *, row_number() OVER (PARTITION BY level, number ORDER BY edit_no DESC) AS rn FROM edits) SELECT level, number, edit_no, size FROM r WHERE rn = 1 AND what = 'add'")
def edit_roundtrip(spark, d):
    """The same edits as the bytes of a manifest log, read back and folded."""
    def edit(event: int, user: int, kind: str, props: bytes) -> bytes:
        file, key = (user % 3, event % 700), (b"k", 1, 1)
        return codec.encode_edit({"last_sequence": event, "deleted_files": [file]} if kind == "error" else {"last_sequence": event, "new_files": [(*file, len(props), key, key)]})

    def run(batches):
        logs = ((str(part), wal.encode([edit(*r[1:]) for r in rows])) for part, rows in row_groups(batches))
        return record_batches(logs, ["path", "content"], [pa.string(), pa.binary()])

    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 500).cast("long").alias("part"), "event_id", "user_id", "event_type", F.col("props").cast("binary").alias("props"))
    found = tables.edits_of(e.repartition("part").sortWithinPartitions("part", "event_id").mapInArrow(run, "path string, content binary"))
    # The rows of an edit get its number side by side: a join with the numbers would decode the logs twice.
    last = F.max(F.when(F.col("what") == "last_sequence", F.col("number"))).over(Window.partitionBy("path", "edit_no"))
    edits = found.withColumn("last", last).where("what in ('add', 'delete') and last is not null").select(F.col("last").alias("edit_no"), "what", "level", "number", "size")
    return tables.fold_edits(edits)


@query(f"""WITH {_FILES}, hit AS (SELECT *, sum(file_size) OVER (ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM files WHERE level = 1 AND hi >= '00000015' AND lo <= '00000120')
SELECT level, number FROM hit WHERE before IS NULL OR before < 200000""")
def range_inputs(spark, d):
    files = level_files(spark, d).where("level = 1").where(manifest.overlaps(F.lit("00000015"), F.lit("00000120")))
    return manifest.cut_inputs(files, 200000).select("level", "number")


@query(f"WITH {_FILES} SELECT max(number) + 1 AS next_file_number FROM files")
def next_file_number(spark, d):
    return level_files(spark, d).agg((F.max("number") + 1).alias("next_file_number"))


_TABLES = """WITH t AS (SELECT o_orderkey // 2000 AS file_no, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS key, o_orderpriority AS value FROM orders)
SELECT file_no, count(*) AS n_entries, CAST(sum(strlen(key)) AS BIGINT) AS key_bytes, CAST(sum(strlen(value)) AS BIGINT) AS value_bytes, min(key) AS lo, max(key) AS hi FROM t GROUP BY file_no"""


@query(_TABLES)
def table_roundtrip(spark, d):
    return _tables(spark, d, "none")


@query(_TABLES)
def table_roundtrip_snappy(spark, d):
    return _tables(spark, d, "snappy")


def _tables(spark, d, compression: str) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        got = codec.decode_table(codec.encode_table([(k.encode(), v.encode()) for k, v in zip(pdf["key"], pdf["value"], strict=True)], compression=compression))
        found = {"n_entries": len(got), "key_bytes": sum(len(k) for _, k, _ in got), "value_bytes": sum(len(v) for _, _, v in got), "lo": got[0][1].decode(), "hi": got[-1][1].decode()}
        return pd.DataFrame({"file_no": [pdf["file_no"].iloc[0]]} | {k: [v] for k, v in found.items()})

    o = table(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 2000).cast("long").alias("file_no"), padded(F.col("o_orderkey"), 10).alias("key"), F.col("o_orderpriority").alias("value"))
    return o.groupBy("file_no").applyInPandas(run, "file_no long, n_entries long, key_bytes long, value_bytes long, lo string, hi string")


# Logs


def _end_sql(off: str, size: str) -> str:
    at = f"({off} + CASE WHEN 32768 - {off} % 32768 < 7 THEN 32768 - {off} % 32768 ELSE 0 END)"
    room = f"(32768 - {at} % 32768 - 7)"
    full = f"(({size} - {room} - 1) // 32761)"
    return f"CASE WHEN {size} <= {room} THEN {at} + 7 + {size} ELSE {at} + {room} + 7 + {full} * 32768 + 7 + {size} - {room} - {full} * 32761 END"


_RECORDS = "records AS (SELECT event_id // 500 AS file_no, event_id AS rec_no, CAST(strlen(props) * (event_id % 400) AS BIGINT) AS size, row_number() OVER (PARTITION BY event_id // 500 ORDER BY event_id) AS rn FROM events)"


@query(f"""WITH RECURSIVE {_RECORDS}, r AS (SELECT file_no, rec_no, size, rn, CAST(0 AS BIGINT) AS start, CAST({_end_sql("0", "size")} AS BIGINT) AS "end" FROM records WHERE rn = 1
  UNION ALL SELECT n.file_no, n.rec_no, n.size, n.rn, r."end", CAST({_end_sql('r."end"', "n.size")} AS BIGINT) FROM r JOIN records n ON n.file_no = r.file_no AND n.rn = r.rn + 1) SELECT file_no, rec_no, size, start, "end" FROM r""")
def wal_layout(spark, d):
    e = table(spark, d, "events")
    return wal.layout(e.select(F.floor(F.col("event_id") / 500).cast("long").alias("file_no"), F.col("event_id").alias("rec_no"), (F.octet_length("props") * (F.col("event_id") % 400)).cast("long").alias("size")))


@query("""WITH parts AS (SELECT event_id // 500 AS file_no, event_id * 7 AS off, CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE CASE WHEN event_id % 3 = 0 THEN 3 ELSE 1 END END AS type, strlen(props) AS len FROM events),
isles AS (SELECT *, sum(CASE WHEN type IN (1, 2) THEN 1 ELSE 0 END) OVER (PARTITION BY file_no ORDER BY off ROWS UNBOUNDED PRECEDING) AS rec FROM parts)
SELECT file_no, min(off) AS off, count(*) AS n_fragments, CAST(sum(len) AS BIGINT) AS n_bytes, regexp_full_match(string_agg(CAST(type AS VARCHAR), '' ORDER BY off), '1|23*4') AS whole FROM isles GROUP BY file_no, rec""")
def wal_reassemble(spark, d):
    kind = F.when(F.col("event_id") % 5 == 0, 1).when(F.col("event_id") % 5 == 1, 2).when(F.col("event_id") % 5 == 2, 3).when(F.col("event_id") % 5 == 3, 4).when(F.col("event_id") % 3 == 0, 3).otherwise(1)
    e = table(spark, d, "events")
    return wal.reassemble(e.select(F.floor(F.col("event_id") / 500).cast("long").alias("file_no"), (F.col("event_id") * 7).alias("off"), kind.alias("type"), F.octet_length("props").alias("len")))


def _replayed(spark, d, damage: bool) -> DataFrame:
    """Each file's records written as a log, the first one's type damaged or not, and read again."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        records = [p.encode() for p in pdf.sort_values("event_id")["props"]]
        data = bytearray(wal.encode(records))
        if damage:
            data[6] = (data[6] + 100) % 256
        got = wal.replay(bytes(data))
        return pd.DataFrame({"file_no": [pdf["file_no"].iloc[0]], "n_records": [len(got.records)], "n_bytes": [sum(len(r) for _, r in got.records)], "dropped_bytes": [got.dropped], "reason": ["; ".join(w for _, w in got.reports)]})

    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 500).cast("long").alias("file_no"), "event_id", "props")
    return e.groupBy("file_no").applyInPandas(run, "file_no long, n_records long, n_bytes long, dropped_bytes long, reason string")


@query("SELECT event_id // 500 AS file_no, count(*) AS n_records, CAST(sum(strlen(props)) AS BIGINT) AS n_bytes, CAST(0 AS BIGINT) AS dropped_bytes, '' AS reason FROM events GROUP BY 1")
def wal_roundtrip(spark, d):
    return _replayed(spark, d, damage=False)


@query("""SELECT event_id // 500 AS file_no, count(*) - 1 AS n_records, CAST(sum(strlen(props)) - min_by(strlen(props), event_id) AS BIGINT) AS n_bytes, CAST(min_by(strlen(props), event_id) AS BIGINT) AS dropped_bytes,
  'unknown record type' AS reason FROM events GROUP BY 1""")
def wal_corruption_report(spark, d):
    return _replayed(spark, d, damage=True)


@query("SELECT event_id // 500 AS file_no, count(*) AS n_records, CAST(sum(strlen(props)) AS BIGINT) AS n_bytes, CAST(0 AS BIGINT) AS dropped_bytes, '' AS reason FROM events GROUP BY 1")
def journal_roundtrip(spark, d):
    """The other kind of log, whose checksums cover the type too, read strictly."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = wal.replay(wal.encode([p.encode() for p in pdf.sort_values("event_id")["props"]], wal.TYPE_AND_PAYLOAD), wal.TYPE_AND_PAYLOAD, strict=True)
        return pd.DataFrame({"file_no": [pdf["file_no"].iloc[0]], "n_records": [len(got.records)], "n_bytes": [sum(len(r) for _, r in got.records)], "dropped_bytes": [got.dropped], "reason": [""]})

    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 500).cast("long").alias("file_no"), "event_id", "props")
    return e.groupBy("file_no").applyInPandas(run, "file_no long, n_records long, n_bytes long, dropped_bytes long, reason string")


@query(f"""WITH RECURSIVE records AS (SELECT event_id // 500 AS file_no, event_id AS rec_no, CAST(strlen(props) * 20 AS BIGINT) AS size, row_number() OVER (PARTITION BY event_id // 500 ORDER BY event_id) AS rn FROM events),
r AS (SELECT file_no, rec_no, size, rn, CAST(0 AS BIGINT) AS start, CAST({_end_sql("0", "size")} AS BIGINT) AS "end" FROM records WHERE rn = 1
  UNION ALL SELECT n.file_no, n.rec_no, n.size, n.rn, r."end", CAST({_end_sql('r."end"', "n.size")} AS BIGINT) FROM r JOIN records n ON n.file_no = r.file_no AND n.rn = r.rn + 1),
heads AS (SELECT *, start + CASE WHEN 32768 - start % 32768 < 7 THEN 32768 - start % 32768 ELSE 0 END AS head FROM r)
SELECT file_no, count(*) AS n_records, CAST(sum(size) AS BIGINT) AS n_bytes, min(head) AS first_offset FROM heads WHERE head >= 50000 GROUP BY file_no""")
def wal_initial_offset(spark, d):
    """Logs read from byte 50,000 on: records that begin before it are left out."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = wal.replay(wal.encode([p.encode() * 20 for p in pdf.sort_values("event_id")["props"]]), start=50_000).records
        out = {"file_no": [pdf["file_no"].iloc[0]], "n_records": [len(got)], "n_bytes": [sum(len(r) for _, r in got)], "first_offset": [got[0][0] if got else None]}
        return pd.DataFrame(out) if got else pd.DataFrame({k: [] for k in out})

    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 500).cast("long").alias("file_no"), "event_id", "props")
    return e.groupBy("file_no").applyInPandas(run, "file_no long, n_records long, n_bytes long, first_offset long")


# Streams


@query(f"WITH {_LATEST} SELECT key, seq, value FROM state")
def stream_latest(spark, d):
    schema = table(spark, d, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    put = F.col("event_type") != "error"
    rows = events.select(padded(F.col("user_id")).alias("key"), (F.col("event_id") + 1).alias("seq"), F.when(put, 1).otherwise(0).alias("vt"), F.when(put, F.col("props")).alias("value"))
    state = ingest.drain(ingest.latest_state(rows), f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}")
    return ingest.live(state).select("key", "seq", "value")


@query(f"WITH {_LATEST} SELECT key, value FROM state")
def stream_into_store(spark, d):
    """The events as a stream of operations that is appended to a store, drained twice: the second time there is nothing new."""
    root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    db = open_store(spark, f"{root}/db", Options(create_if_missing=True))
    put = F.col("event_type") != "error"
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    rows = events.select(padded(F.col("user_id")).alias("key"), F.col("event_id").alias("order"), F.when(put, 1).otherwise(0).alias("vt"), F.when(put, F.col("props")).alias("value"))
    for _ in range(2):
        ingest.into_store(rows, db, f"{root}/checkpoint").awaitTermination()
    return _text(db.scan())


# Stores


def _text(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("string") for c in ("key", "value")})


def _filled(spark, d, keep: int | None = None):
    """A store that got the log in four appends, compacted after each, and was closed and opened again; a snapshot is held from sequence number ``keep`` on."""
    root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    db = open_store(spark, root, Options(create_if_missing=True, max_file_size=1 << 20))
    rows = written(log(spark, d), "log")
    last = rows.agg(F.max("seq")).first()[0]
    edges = sorted({0, last // 3, *([keep] if keep else []), 2 * last // 3, last})
    for lo, hi in zip(edges, edges[1:], strict=False):
        db.append(rows.where((F.col("seq") > lo) & (F.col("seq") <= hi)).select("key", "vt", "value", (F.col("seq") - lo - 1).alias("pos")))
        if hi == keep:
            db.snapshot()
        db.maintain()
    db.compact_range()
    return open_store(spark, root, Options(max_file_size=1 << 20))


@query(f"WITH {_LATEST} SELECT key, value FROM state")
def store_scan(spark, d):
    return _text(_filled(spark, d).scan())


@query(f"WITH {_LATEST.replace('FROM oplog)', 'FROM oplog WHERE seq <= (SELECT max(seq) // 2 FROM oplog))')} SELECT key, value FROM state")
def store_snapshot(spark, d):
    """The state of a snapshot that compactions and a new handle leave as it was."""
    half = log(spark, d).agg(F.max("seq")).first()[0] // 2
    db = _filled(spark, d, half)
    return _text(db.scan(snapshot=db.snapshots[0]))


@query(f"""WITH {_LATEST}, probes AS (SELECT c_custkey AS probe_id, lpad(CAST(c_custkey % 300 AS VARCHAR), 8, '0') AS key FROM customer)
SELECT p.probe_id, p.key, o.seq, o.vt, o.value, CASE WHEN o.seq IS NULL THEN 'missing' ELSE 'found' END AS status FROM probes p LEFT JOIN (SELECT * FROM newest WHERE vt = 1) o ON p.key = o.key""")
def store_multi_get(spark, d):
    """Probes of a store whose compactions have dropped what deletions left."""
    probes = table(spark, d, "customer").select(F.col("c_custkey").alias("probe_id"), padded(F.col("c_custkey") % 300).cast("binary").alias("key"), F.lit(None).cast("long").alias("snapshot_seq"))
    return _text(_filled(spark, d).multi_get(probes)).drop("snapshot_seq")


@query(f"WITH {_OPLOG} SELECT CAST(0 AS BIGINT) AS n_overlaps, true AS in_bounds, max(seq) AS last_seq FROM oplog")
def store_levels(spark, d):
    """Files of a compacted store: none below level 0 overlap, none is over twice the size that they are cut at, and no sequence number is lost."""
    db = _filled(spark, d)
    rows = [(f["level"], f["number"], bytes.fromhex(f["lo"]), bytes.fromhex(f["hi"]), f["size"]) for f in db.state["files"]]
    files = spark.createDataFrame(rows, "level int, number long, lo binary, hi binary, size long")
    size = files.agg((F.max("size") <= 2 * db.options.max_file_size).alias("in_bounds"))
    return manifest.overlap_violations(files).select(F.col("n_violations").alias("n_overlaps")).join(F.broadcast(size)).withColumn("last_seq", F.lit(db.state["last_seq"]).cast("long"))


@query("SELECT n_name AS key, CAST(n_nationkey AS VARCHAR) AS value FROM nation WHERE n_regionkey <> 1")
def store_recover(spark, d):
    """Single writes, some of them deleted again, that a new handle reads back from the log."""
    root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    db = open_store(spark, root, Options(create_if_missing=True))
    nations = table(spark, d, "nation").select("n_name", "n_nationkey", "n_regionkey").collect()
    db.write(functools.reduce(lambda b, r: b.put(r.n_name.encode(), str(r.n_nationkey).encode()), nations, codec.WriteBatch()))
    for r in nations:
        if r.n_regionkey == 1:
            db.delete(r.n_name.encode())
    return _text(open_store(spark, root).scan())
