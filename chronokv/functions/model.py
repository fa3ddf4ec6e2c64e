"""Schemas, options and errors of the change log."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import types as T

# Fixed values of the formats and of the level rules.
DELETE, PUT = 0, 1
MAX_SEQ = (1 << 56) - 1
LEVELS, L0_TRIGGER, L0_SLOWDOWN = 7, 4, 8
MAX_FLUSH_LEVEL = 2  # the deepest level that a flush may go to

OPLOG = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("seq", T.LongType()), T.StructField("vt", T.ByteType()), T.StructField("value", T.BinaryType())])
INTERNAL_KEY = T.StructType([T.StructField("user_key", T.BinaryType()), T.StructField("seq", T.LongType()), T.StructField("vt", T.ByteType())])
FILE = T.StructType(
    [T.StructField("level", T.IntegerType()), T.StructField("number", T.LongType()), T.StructField("file_size", T.LongType()), T.StructField("smallest", INTERNAL_KEY), T.StructField("largest", INTERNAL_KEY), T.StructField("allowed_seeks", T.LongType())]
)


class StoreError(Exception):
    """Base of all errors; ``because`` puts a message in front."""

    prefix = "error"

    def __init__(self, message: str = ""):
        super().__init__(message)
        self.message = message

    def because(self, text: str) -> StoreError:
        return type(self)(f"{text}: {self.message}" if self.message else text)

    def __str__(self) -> str:
        return f"{self.prefix}: {self.message}" if self.message else self.prefix


class NotFound(StoreError):
    """No live value: never written, or deleted (``deleted`` is True)."""

    prefix = "not found"

    def __init__(self, message: str = "", deleted: bool = False):
        super().__init__(message)
        self.deleted = deleted


class Corruption(StoreError):
    prefix = "corruption"


class InvalidArgument(StoreError):
    prefix = "invalid argument"


class Fenced(StoreError):
    """Another writer has taken the store over: open it anew; what was not acknowledged is not in it."""

    prefix = "fenced"


class NotSupported(StoreError):
    prefix = "not supported"


class StoreIO(StoreError):
    prefix = "i/o"


@dataclass(frozen=True)
class Options:
    """Settings of a store; :meth:`clamped` brings sizes into their ranges."""

    block_restart_interval: int = 16
    block_size: int = 4 << 10
    compression: str = "snappy"
    comparator: str = "bytewise"
    paranoid_checks: bool = False
    max_open_files: int = 1000
    write_buffer_size: int = 4 << 20
    max_file_size: int = 2 << 20
    create_if_missing: bool = False
    error_if_exists: bool = False

    RANGES = {"max_open_files": (74, 50_000), "write_buffer_size": (64 << 10, 1 << 30), "max_file_size": (1 << 20, 1 << 30), "block_size": (1 << 10, 4 << 20)}

    def clamped(self) -> Options:
        return replace(self, **{k: min(max(getattr(self, k), lo), hi) for k, (lo, hi) in self.RANGES.items()})

    def names(self) -> list[str]:
        return [f.name for f in fields(self)]


@dataclass(frozen=True)
class ReadOptions:
    verify_checksums: bool = False
    fill_cache: bool = True
    snapshot: int | None = None


@dataclass(frozen=True)
class WriteOptions:
    sync: bool = False
