"""Column expressions over keys and sizes; all stay in the JVM."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def varint_length(v: Column) -> Column:
    """Bytes that a non-negative value, a long at most, takes as a varint."""
    out = F.lit(9)
    for n in range(8, 0, -1):
        out = F.when(v < F.lit(1 << 7 * n), n).otherwise(out)
    return out


def wide_varint_length(v: Column) -> Column:
    """:func:`varint_length` of a decimal(38,0), which may pass a long."""
    out = F.lit(19)
    for n in range(18, 0, -1):
        out = F.when(v < F.lit(Decimal(1 << 7 * n)), n).otherwise(out)
    return out


def pack_tag(seq: Column, vt: Column) -> Column:
    """seq * 256 + vt as a decimal, which no sequence number overflows."""
    return (seq.cast("decimal(20,0)") * 256 + vt).cast("decimal(20,0)")


def unpack_seq(tag: Column) -> Column:
    return F.floor(tag / 256).cast("long")


def clip(v: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def allowed_seeks(size: Column) -> Column:
    """A file pays for its compaction after as many wasted seeks: one for each 16 KiB, 100 at least."""
    return F.greatest(F.lit(100).cast("long"), F.floor(size / 16384).cast("long"))


def max_bytes_for_level(level: Column) -> Column:
    """10 MiB for levels 0 and 1, ten times more for each level below."""
    return (F.lit(10485760) * F.pow(F.lit(10), F.greatest(level - 1, F.lit(0)))).cast("long")


def shared_prefix(a: Column, b: Column) -> Column:
    """Bytes that two keys (strings or binary) have in common at the front; a null shares none."""
    a, b = a.cast("binary"), b.cast("binary")
    most = F.least(F.octet_length(a), F.octet_length(b))
    differ = F.filter(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda i: (i <= most) & (F.substring(a, i, 1) != F.substring(b, i, 1)))
    return F.when(a.isNull() | b.isNull(), 0).otherwise(F.coalesce(F.get(differ, 0) - 1, most))


def byte_at(key: Column, i: Column) -> Column:
    """The byte of a binary key at a place from 1, as a number."""
    return F.conv(F.hex(F.substring(key, i, 1)), 16, 10).cast("int")


def _up_to(key: Column, n: Column, last: Column) -> Column:
    """The first n bytes of a binary key, and one byte more."""
    return F.concat(F.substring(key, F.lit(1), n), F.unhex(F.lpad(F.hex(last.cast("long")), 2, "0")))


def shortest_separator(a: Column, b: Column) -> Column:
    """The short key s, as bytes, with a <= s < b that this rule makes: a's common part with b and its next byte plus one.

    ``a`` itself where one is a prefix of the other, or the next byte is not smaller by two.
    """
    x, y = a.cast("binary"), b.cast("binary")
    n = shared_prefix(x, y)
    bx, by = byte_at(x, n + 1), byte_at(y, n + 1)
    fits = (n < F.least(F.octet_length(x), F.octet_length(y))) & (bx < 255) & (bx + 1 < by)
    return F.when(fits, _up_to(x, n, bx + 1)).otherwise(x)


def short_successor(a: Column) -> Column:
    """A short key, as bytes, that is not less than ``a``: up to its first byte that isn't 0xFF, plus one; a key without such a byte stays."""
    x = a.cast("binary")
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.octet_length(x), F.lit(1))), lambda i: (i <= F.octet_length(x)) & (F.substring(x, i, 1) != F.unhex(F.lit("FF"))))
    first = F.get(places, 0)
    return F.when(first.isNull(), x).otherwise(_up_to(x, first - 1, byte_at(x, first) + 1))


def park_miller(seed: Column, n: Column) -> Column:
    """The n-th value of the generator from ``seed``."""
    start = F.when(seed.isin(0, 2147483647), F.lit(1)).otherwise(seed).cast("long")
    return F.aggregate(F.sequence(F.lit(1), n), start, lambda s, _: s * 16807 % 2147483647)


def uniform(seed: Column, n: Column, below: Column) -> Column:
    """The n-th value of the generator, modulo ``below``."""
    return park_miller(seed, n) % below


def skewed(seed: Column, n: Column, max_log: int) -> Column:
    """The n-th value that is small more often than large: a draw says how many bits, up to ``max_log``, the next one keeps."""
    bits = park_miller(seed, 2 * n - 1) % (max_log + 1)
    return park_miller(seed, 2 * n) % F.pow(F.lit(2), bits).cast("long")


def file_name(db: str, number: Column, suffix: str) -> Column:
    return F.format_string(f"{db}/%06d.{suffix}", number)


def file_type(path: Column) -> Column:
    """What a store's file is, by its base name: CURRENT, LOCK, INFO_LOG, MANIFEST, LOG, TABLE, TEMP; null for others."""
    base = F.regexp_extract(path, "([^/]*)$", 1)
    return (
        F.when(base == "CURRENT", "CURRENT").when(base == "LOCK", "LOCK").when(base.isin("LOG", "LOG.old"), "INFO_LOG")
        .when(base.rlike("^MANIFEST-[0-9]+$"), "MANIFEST").when(base.rlike("^[0-9]+\\.log$"), "LOG").when(base.rlike("^[0-9]+\\.(sst|ldb)$"), "TABLE").when(base.rlike("^[0-9]+\\.dbtmp$"), "TEMP")
    )


def file_number(path: Column) -> Column:
    """The number in a store's file name; 0 for files that are one of a kind, null for others."""
    digits = F.regexp_extract(path, "(?:^|/)(?:MANIFEST-([0-9]+)|([0-9]+)\\.(?:log|sst|ldb|dbtmp))$", 0)
    return F.when(file_type(path).isin("CURRENT", "LOCK", "INFO_LOG"), F.lit(0)).when(file_type(path).isNotNull(), F.regexp_extract(digits, "([0-9]+)", 1)).cast("long")
