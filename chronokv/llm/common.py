"""Shared parts of the text operators: written tables, vectorised words, skew-safe ranks.

Texts travel to Python as Arrow record batches.  :func:`pieces` cuts a batch into
slices of a few megabytes, so that the scratch arrays of a worker stay bounded however
long the documents are; :class:`Words` finds and hashes every word of such a slice
with numpy, without building a Python object per word.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..functions.tables import shared_dir, written  # noqa: F401  the operators take them from here

U64 = np.uint64
#: Bytes of text whose scratch arrays a worker holds at once.
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch between the JVM and a worker, and bytes, beyond which one row may go.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def in_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, as a batch of very long texts must fit a worker, and give workers the package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What a worker's operator keeps from one partition to the next: functions with a cache.
_kept: list = []


def keep_only(f=None) -> None:
    """Forget what other operators kept in this worker: workers outlive stages, and their caches would add up.  ``f`` keeps its own."""
    others = [g for g in _kept if g is not f]
    for g in others:
        g.cache_clear()
    _kept[:] = [f] if f else []
    if others:
        give_back()


def give_back() -> None:
    """Return free memory to the system: scratch arrays of one partition are not held while the worker waits for the next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do without
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def pieces(batches, text: str = "text", limit: int = SLICE_BYTES, keep=None) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text; a longer text is a slice of its own.  ``keep`` is the function whose cache stays."""
    keep_only(keep)
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        size = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
        total = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end
    give_back()


def larger(batches, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The batches joined to ones of about ``rows`` rows: for narrow rows, whose small batches would cost more than the work on them."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield joined(held)
            held, n = [], 0
    if n:
        yield joined(held)


def filled(batches, limit: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches joined until their texts have ``limit`` bytes: what is kept of one slice then serves many documents."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += pc.sum(pc.binary_length(column(b, text))).as_py() or 0
        if size >= limit:
            yield joined(held)
            held, size = [], 0
    if any(b.num_rows for b in held):
        yield joined(held)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64, on unsigned 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: The prime 2**61 - 1, and a base of windows' hashes modulo it.
PRIME = (1 << 61) - 1
BASE = 0x1D8AF066B1F2D3C9
#: Words of more bytes are hashed one by one.
LONG_WORD = 256
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def times(x: np.ndarray, c: int) -> np.ndarray:
    """A number below 2**62 that is x * c modulo ``PRIME``, for x below 2**62 + 2**6 and c below ``PRIME``: products of 31-bit halves fit 64 bits."""
    low, half = U64((1 << 31) - 1), U64(31)
    c1, c0 = U64(c >> 31), U64(c & ((1 << 31) - 1))
    x1, x0 = x >> half, x & low
    mid = x1 * c0
    mid += x0 * c1
    x1 *= c1
    x1 <<= U64(1)
    x0 *= c0
    x1 += x0
    x1 += mid >> U64(30)
    mid &= U64((1 << 30) - 1)
    mid <<= half
    x1 += mid
    return _folded(x1)


def _folded(x: np.ndarray) -> np.ndarray:
    """A number below 2**61 + 8 that is x modulo ``PRIME``."""
    out = x & U64(PRIME)
    out += x >> U64(61)
    return out


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo ``PRIME``."""
    out = _folded(_folded(x))
    out[out >= U64(PRIME)] -= U64(PRIME)
    return out


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an Arrow column in one array, and where each text begins; a null is empty."""
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, at, data = col.buffers()
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(at, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


class Words:
    """All words ``[^\\x20\\x09-\\x0D]+`` of a slice of texts.

    raw, bounds: the bytes, and where texts begin.  start, end: byte range of each word.
    doc: index of its text.  n: words of each text.  first: index of each text's first word.
    """

    def __init__(self, col: pa.Array):
        self.raw, self.bounds = text_bytes(col)
        raw, bounds = self.raw, self.bounds
        n = len(raw)
        self.docs = len(bounds) - 1
        self.inside = ~_SPACE[raw]
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        inside = self.inside
        if n:
            before = np.empty(n, bool)
            before[0], before[1:] = False, inside[:-1]
            self.start = np.flatnonzero(inside & (~before | edge[:-1]))
            after = np.empty(n, bool)
            after[-1], after[:-1] = False, inside[1:]
            self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.doc = np.searchsorted(bounds, self.start, side="right") - 1
        self.n = np.bincount(self.doc, minlength=self.docs).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n)[:-1]]) if self.docs else np.zeros(0, np.int64)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word; equal bytes, equal hashes.

        Eight bytes at a time go through splitmix64's steps, for all words at once, which leaves no structure by which
        texts of few letters would meet; long words get XXH64 of their bytes.
        """
        size = self.end - self.start
        out = mix(size.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(0x9E3779B97F4A7C15))
        if not len(size):
            return out
        padded = np.concatenate([self.raw, np.zeros(8, np.uint8)])
        eight = np.lib.stride_tricks.as_strided(padded, (len(self.raw), 8), (1, 1))
        at, left, live = self.start, size, np.arange(len(size))
        long = np.flatnonzero(size > LONG_WORD)
        if len(long):
            live = np.flatnonzero(size <= LONG_WORD)
            at, left = at[live], left[live]
        while len(live):
            chunk = np.ascontiguousarray(eight[at]).view("<u8").ravel()
            short = left < 8
            if short.any():
                chunk[short] &= (U64(1) << (left[short].astype(U64) * U64(8))) - U64(1)
            out[live] = mix((out[live] ^ chunk) * U64(0xFF51AFD7ED558CCD) + U64(0x9E3779B97F4A7C15))
            more = left > 8
            at, left, live = at[more] + 8, left[more] - 8, live[more]
        for i in long.tolist():
            out[i] = xxhash.xxh64_intdigest(self.raw[self.start[i] : self.end[i]].tobytes(), 42)
        return out

    def per_doc(self, marks: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


# Fixed values of XXH64.
_P1, _P2, _P3, _P4, _P5 = map(U64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U64(n)) | (x >> U64(64 - n))


def xxh64(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of many byte ranges, of which none overlaps the end of ``raw``; all take a step together, and those that are done drop out."""
    size = end - start
    padded = np.concatenate([raw, np.zeros(32, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (len(raw) + 25, 8), (1, 1))
    word = lambda at: np.ascontiguousarray(eight[at]).view("<u8").ravel()
    taken = lambda x: _turned(x * _P2, 31) * _P1
    h = np.full(len(size), U64(seed) + _P5, U64)
    at = start.copy()
    with np.errstate(over="ignore"):
        long = np.flatnonzero(size >= 32)
        if len(long):
            base = np.array([seed], U64)
            lanes = [np.repeat(x, len(long)) for x in (base + _P1 + _P2, base + _P2, base, base - _P1)]
            live, stripes = np.arange(len(long)), size[long] // 32
            for t in range(int(stripes.max())):
                live = live[stripes[live] > t]
                for j in range(4):
                    lanes[j][live] = _turned(lanes[j][live] + word(at[long[live]] + 8 * j) * _P2, 31) * _P1
                at[long[live]] += 32
            whole = _turned(lanes[0], 1) + _turned(lanes[1], 7) + _turned(lanes[2], 12) + _turned(lanes[3], 18)
            for lane in lanes:
                whole = (whole ^ taken(lane)) * _P1 + _P4
            h[long] = whole
        h += size.astype(U64)
        for t in range(3):
            some = np.flatnonzero(end - at >= 8)
            if not len(some):
                break
            h[some] = _turned(h[some] ^ taken(word(at[some])), 27) * _P1 + _P4
            at[some] += 8
        some = np.flatnonzero(end - at >= 4)
        h[some] = _turned(h[some] ^ (word(at[some]) & U64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
        at[some] += 4
        for t in range(3):
            some = np.flatnonzero(end > at)
            h[some] = _turned(h[some] ^ padded[at[some]].astype(U64) * _P5, 11) * _P1
            at[some] += 1
        h = (h ^ (h >> U64(33))) * _P2
        h = (h ^ (h >> U64(29))) * _P3
    return h ^ (h >> U64(32))


def windows(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of every k consecutive words of one text, and the index of each one's first word.

    The polynomial of the words' hashes (their low 61 bits) is taken modulo the prime 2**61 - 1; windows of 2n words come from two of n.
    """
    m = len(hashes) - k + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:m] == doc[k - 1 :])
    one = _reduced(hashes & U64(PRIME))
    rolling, n = one, 1
    for bit in bin(k)[3:]:
        size = len(rolling) - n
        rolling = times(rolling[:size], pow(BASE, n, PRIME)) + rolling[n : n + size]
        n *= 2
        if bit == "1":
            size = len(rolling) - 1
            rolling = times(rolling[:size], BASE) + one[n : n + size]
            n += 1
    return mix(_reduced(rolling[at]) + U64(k)), at


#: Slots of a screen, as a power of two: it takes 2**17 rows of 16 bytes at most, whatever it screens.
SCREEN_BITS = 23


def screened(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``df`` in two: rows whose ``key`` may be among those of ``ids``, and rows whose key surely isn't, or is null.

    The screen has a bit for each slot of a hash that some id falls into, and a fixed greatest size, so all tasks get it.  Of a large ``df`` only the
    first part then has to be shuffled to meet ``ids``; where ids are very many, that is most of it.
    """
    name = "_screen"
    while any(c.lower().startswith(name) for c in df.columns):
        name += "_"
    def slot(k: str) -> tuple[Column, Column]:
        at = F.pmod(F.xxhash64(F.col(k).cast("long")), F.lit(1 << SCREEN_BITS))
        return F.shiftright(at, 6).cast("int"), at.bitwiseAND(F.lit(63)).cast("int")

    word, bit = slot(key)
    marks = ids.select(word.alias(f"{name}w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("m")).groupBy(f"{name}w").agg(F.bit_or("m").alias(f"{name}m"))
    marks = F.broadcast(marks)
    there = F.call_function("shiftrightunsigned", F.coalesce(F.col(f"{name}m"), F.lit(0).cast("long")), bit).bitwiseAND(F.lit(1)) == 1
    hit = F.col(key).isNotNull() & there
    both = df.join(marks, word == F.col(f"{name}w"), "left")
    return both.where(hit).select(*df.columns), both.where(~hit).select(*df.columns)


def without(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose ``key`` isn't among those of ``ids``, a written table; null keys stay.  Only rows that :func:`screened` can't tell are shuffled."""
    maybe, surely = screened(df, ids, key)
    return surely.union(maybe.join(ids.hint("merge"), key, "left_anti").select(*df.columns))


def settle(root: np.ndarray) -> np.ndarray:
    """Pointers followed to their ends."""
    while True:
        up = root[root]
        if (up == root).all():
            return root
        root = up


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Settled pointers to the least member after the links (a, b) are added."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        root = settle(root)


def gapless(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """A rank from 0 without gaps within each group, as column ``out``; no group is sorted by one task.

    Rows of a group are dealt over as many salts as there are shuffle partitions by the hash
    of what orders them; each (group, salt) is ranked alone and moved up by the number of rows in
    the salts before it.  ``df`` is read twice: give a written table.  Group keys must not be null.
    """
    salts = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy(*keys, "_salt").count().select(*keys, "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    local = Window.partitionBy(*keys, "_salt").orderBy(*order)
    ranked = salted.withColumn("_at", F.row_number().over(local))
    return ranked.join(base, [*keys, "_salt"]).withColumn(out, F.col("_base") + F.col("_at") - 1).drop("_salt", "_base", "_at")
