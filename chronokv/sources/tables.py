"""Raw sorted tables and manifests as rows; whatever Spark's binary file source can open."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.model import Corruption
from ..functions.tables import record_batches
from . import wal


def read_tables(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """Entries of the tables at ``path``: path, block, key, value; a damaged table gives one row with ``error`` instead.

    Tables are decoded side by side; one is as large as an option allows.
    """

    def rows_of(batches):
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                try:
                    rows = [(name.as_py(), n, k, v, None) for n, k, v in codec.decode_table(content.as_py(), verify)]
                except Corruption as e:
                    rows = [(name.as_py(), None, None, None, e.message)]
                yield from rows

    def run(batches):
        return record_batches(rows_of(batches), ["path", "block", "key", "value", "error"], [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.string()])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, block long, key binary, value binary, error string")


def read_edits(spark: SparkSession, path: str) -> DataFrame:
    """Version edits of the manifest logs at ``path``, as :func:`edits_of` gives them."""
    return edits_of(spark.read.format("binaryFile").load(path).select("path", "content"))


def edits_of(files: DataFrame) -> DataFrame:
    """Version edits of manifest logs given as ``path`` and ``content``: path, edit_no, what (``add``, ``delete``, ``pointer``, ``error`` or a counter's name), and its values.

    Columns level, number, size, lo, hi (user keys), text (comparator or error).
    """
    names = ["path", "edit_no", "what", "level", "number", "size", "lo", "hi", "text"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string()]

    def rows_of(name: str, n: int, record: bytes) -> list[tuple]:
        try:
            edit = codec.decode_edit(record)
        except Corruption as e:
            return [(name, n, "error", None, None, None, None, None, e.message)]
        out = [(name, n, "pointer", level, None, None, key[0], None, None) for level, key in edit["compact_pointers"]]
        out += [(name, n, "delete", level, number, None, None, None, None) for level, number in edit["deleted_files"]]
        out += [(name, n, "add", level, number, size, low[0], high[0], None) for level, number, size, low, high in edit["new_files"]]
        out += [(name, n, k, None, edit[k], None, None, None, None) for k in ("log_number", "prev_log_number", "next_file_number", "last_sequence") if k in edit]
        return out + [(name, n, "comparator", None, None, None, None, None, edit.get("comparator_name"))] * ("comparator_name" in edit)

    def found(batches):
        for b in batches:
            for name, content in ((n.as_py(), c.as_py()) for n, c in zip(b.column(0), b.column(1), strict=True)):
                got = wal.replay(content)
                for n, (_, record) in enumerate(got.records):
                    yield from rows_of(name, n, record)
                yield from ((name, None, "error", None, None, None, None, None, why) for _, why in got.reports)

    def run(batches):
        return record_batches(found(batches), names, kinds)

    return files.mapInArrow(run, "path string, edit_no long, what string, level int, number long, size long, lo binary, hi binary, text string")


def fold_edits(edits: DataFrame) -> DataFrame:
    """The files that a manifest's edits (``edit_no``, ``what``, ``level``, ``number`` and more) leave: those whose last edit adds them.

    Within one edit a deletion comes before an addition.
    """
    rest = [c for c in edits.columns if c not in ("level", "number")]
    order = F.struct("edit_no", F.when(F.col("what") == "add", 1).otherwise(0))
    last = edits.where(F.col("what").isin("add", "delete")).groupBy("level", "number").agg(F.max_by(F.struct(*rest), order).alias("_e"))
    return last.where(F.col("_e.what") == "add").select("level", "number", *[F.col(f"_e.`{c}`").alias(c) for c in rest if c != "what"])
