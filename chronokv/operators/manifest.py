"""File metadata as rows: levels, overlaps, versions and what may be deleted.

Files have ``level``, ``number``, ``file_size``, ``lo`` and ``hi`` (smallest and largest key).  A manifest has one row for
each file, of megabytes, so windows over a level are small beside the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import allowed_seeks, file_number, file_type, max_bytes_for_level
from ..functions.model import L0_TRIGGER
from ..functions.tables import written


def describe(entries: DataFrame, by: list[str], size: Column) -> DataFrame:
    """The metadata row of each file: entries, size, smallest and largest key, allowed seeks."""
    out = entries.groupBy(*by).agg(F.count("*").alias("n_entries"), F.sum(size).cast("long").alias("file_size"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    return out.withColumn("allowed_seeks", allowed_seeks(F.col("file_size")))


def overlaps(low: Column | None, high: Column | None) -> Column:
    """Whether a file meets [low, high]; a null or absent bound is open."""
    out = F.lit(True)
    if low is not None:
        out = out & (low.isNull() | (F.col("hi") >= low))
    if high is not None:
        out = out & (high.isNull() | (F.col("lo") <= high))
    return out


def islands(files: DataFrame) -> DataFrame:
    """``island``: files of a level that chains of overlaps join share a number, from 0 in key order."""
    order = Window.partitionBy("level").orderBy("lo", "hi", "number")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("lo") > reach), 1).otherwise(0)
    rows = files.withColumn("_fresh", fresh)
    return rows.withColumn("island", (F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("long")).drop("_fresh")


def overlap_closure(files: DataFrame, low, high) -> DataFrame:
    """Files of a level with overlaps that a compaction of [low, high] must take: the least set that no other file meets.

    That set is made of the islands that the range meets, so no search for a fixed point is needed.
    """
    marked = islands(files)
    hit = marked.where(overlaps(None if low is None else F.lit(low), None if high is None else F.lit(high)))
    return marked.join(hit.select("level", "island").distinct(), ["level", "island"], "left_semi")


def cut_inputs(files: DataFrame, max_bytes: int) -> DataFrame:
    """A range compaction's inputs in a level without overlaps: files in key order until they have ``max_bytes``."""
    before = F.sum("file_size").over(Window.partitionBy("level").orderBy("lo", "number").rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") < max_bytes)).drop("_before")


def overlap_violations(files: DataFrame) -> DataFrame:
    """Files below level 0, and how many begin before the one before them in their level ends."""
    before = F.lag("hi").over(Window.partitionBy("level").orderBy("lo", "number"))
    rows = files.where("level > 0").withColumn("_before", before)
    return rows.agg(F.count("*").alias("n_files"), F.coalesce(F.sum(F.when(F.col("_before") >= F.col("lo"), 1).otherwise(0)), F.lit(0)).cast("long").alias("n_violations"))


def find_file(files: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probe ``key`` the file of a level without overlaps that may hold it: the first whose largest key is not below it."""
    from .reads import seek_many

    files = written(files.select("number", "lo", "hi"), "files")
    ends = files.select(F.col("hi").alias("key"))
    landed = seek_many(ends, probes.select(F.col("key").alias("target")).distinct(), "ge")
    return landed.join(files.select("number", "lo", "hi"), landed["found"] == files["hi"], "left").select(F.col("target").alias("key"), "number", (F.col("lo") <= F.col("target")).alias("inside"))


def probe_order(files: DataFrame, key) -> DataFrame:
    """Files that may hold a key, in the order to look: level 0 newest first, then deeper levels."""
    hit = files.where((F.col("lo") <= F.lit(key)) & (F.col("hi") >= F.lit(key)))
    return hit.orderBy("level", F.when(F.col("level") == 0, -F.col("number")).otherwise(F.col("number")))


def apply_edit(base: DataFrame, added: DataFrame, deleted: DataFrame) -> DataFrame:
    """The files after an edit: base and added ones but those deleted; a file that is added again after a deletion stays.

    Ordered use: an edit's deletions hold for the base only.
    """
    keys = ["level", "number"]
    left = base.join(deleted.select(*keys), keys, "left_anti").join(added.select(*keys), keys, "left_anti")
    return left.select(*base.columns).unionByName(added.select(*base.columns))


def boundary_closure(files: DataFrame) -> DataFrame:
    """For each file of a level the last file that goes on with older versions of its last user key, and of that one's, and so on.

    ``files`` has number, lo, hi (user keys) and lo_seq (of the first entry): in a level's order a file is followed by one that begins with the user key
    the first ends with.  Columns: number, last_number, n_files (1: the file stands alone).  A run of such files is an island, found by one pass over the level in order.
    """
    w = Window.orderBy("lo", F.col("lo_seq").desc(), "number")
    rows = files.withColumn("_new", F.when(F.lag("hi").over(w) == F.col("lo"), 0).otherwise(1)).withColumn("_at", F.row_number().over(w))
    rows = rows.withColumn("_island", F.sum("_new").over(w))
    last = rows.groupBy("_island").agg(F.max("_at").alias("_end"), F.max_by("number", "_at").alias("last_number"))
    return rows.join(last, "_island").select("number", "last_number", (F.col("_end") - F.col("_at") + 1).cast("long").alias("n_files"))


def live_files(*versions: DataFrame) -> DataFrame:
    """Numbers of the files of all versions in use."""
    out = versions[0].select("number")
    for v in versions[1:]:
        out = out.union(v.select("number"))
    return out.distinct()


def obsolete(listing: DataFrame, live: DataFrame, log_number: int, prev_log_number: int, manifest_number: int) -> DataFrame:
    """Files of a listing (``path``) that may be deleted: ``path``, ``kind``, ``number``.

    Tables and temporary files that no version names, logs older than the current one but for the previous, and older
    manifests.  Files of other kinds, and files that are not the store's, stay.
    """
    rows = listing.select("path", file_type(F.col("path")).alias("kind"), file_number(F.col("path")).alias("number"))
    named = live.select(F.col("number").alias("_live"))
    rows = rows.join(named, rows["number"] == named["_live"], "left")
    keep = (
        F.when(F.col("kind") == "LOG", (F.col("number") >= log_number) | (F.col("number") == prev_log_number))
        .when(F.col("kind") == "MANIFEST", F.col("number") >= manifest_number)
        .when(F.col("kind").isin("TABLE", "TEMP"), F.col("_live").isNotNull())
        .otherwise(True)
    )
    return rows.where(~keep).select("path", "kind", "number")


def level_scores(files: DataFrame) -> DataFrame:
    """Files, bytes and compaction score of each level: level 0 by files, the others by bytes; in thousandths, as whole numbers."""
    rows = files.groupBy("level").agg(F.count("*").alias("n_files"), F.sum("file_size").cast("long").alias("n_bytes"))
    limit = F.when(F.col("level") == 0, F.lit(L0_TRIGGER)).otherwise(max_bytes_for_level(F.col("level")))
    have = F.when(F.col("level") == 0, F.col("n_files")).otherwise(F.col("n_bytes"))
    return rows.withColumn("score_milli", F.floor(have * 1000 / limit).cast("long")).withColumn("needs_compaction", F.col("score_milli") >= 1000)


def compaction_level(files: DataFrame, deepest: int = 5) -> DataFrame:
    """The level to compact: the highest score; at a tie the lowest level.  One row, or none without files."""
    scores = level_scores(files).where(F.col("level") <= deepest)
    return scores.orderBy(F.col("score_milli").desc(), "level").limit(1).select("level", "score_milli", "needs_compaction")


def next_file(files: DataFrame, pointers: DataFrame) -> DataFrame:
    """The file that each level compacts next: the first past its pointer (``level``, ``pointer``), else the first."""
    rows = files.join(pointers, "level", "left")
    past = F.when(F.col("pointer").isNull() | (F.col("hi") > F.col("pointer")), 0).otherwise(1)
    return rows.groupBy("level").agg(F.min_by("number", F.struct(past, "lo", "number")).alias("number"))


def overlap_bytes(inputs: DataFrame, files: DataFrame, depth: int) -> DataFrame:
    """For each input file the files ``depth`` levels below that it overlaps: their number and bytes.

    Levels below 0 don't overlap themselves, so with their running totals in key order two searches answer each input.
    """
    below = files.select((F.col("level") - depth).alias("level"), "lo", "hi", "file_size")
    some = inputs.select("level", "number", "lo", "hi")
    order = Window.partitionBy("level").orderBy("k", "kind").rowsBetween(Window.unboundedPreceding, 0)
    nil = F.lit(0).cast("long")

    def running(at: str, ask: str, first: int) -> DataFrame:
        """Totals of the files whose ``at`` is before each input's ``ask``."""
        marks = below.select("level", F.col(at).alias("k"), F.lit(1 - first).alias("kind"), F.lit(1).cast("long").alias("n"), F.col("file_size").cast("long").alias("b"), F.lit(None).cast("long").alias("number"))
        asks = some.select("level", F.col(ask).alias("k"), F.lit(first).alias("kind"), nil.alias("n"), nil.alias("b"), "number")
        rows = marks.unionByName(asks).withColumn("n", F.sum("n").over(order)).withColumn("b", F.sum("b").over(order))
        return rows.where("number is not null").select("level", "number", "n", "b")

    begun = running("lo", "hi", 1).withColumnsRenamed({"n": "n1", "b": "b1"})
    ended = running("hi", "lo", 0).withColumnsRenamed({"n": "n0", "b": "b0"})
    both = begun.join(ended, ["level", "number"])
    return both.select("level", "number", (F.col("n1") - F.col("n0")).alias("n_files"), (F.col("b1") - F.col("b0")).alias("n_bytes"))
