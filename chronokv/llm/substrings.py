"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark; repeated windows merge into removal intervals.

Hashes travel packed: a row holds, for a slice of documents and a bucket of hashes, the windows' hashes and how
many of them each document has.  Within a slice all but the smallest document of a hash are settled on the
spot, so a window that very many documents share costs one entry a slice.  A bucket finds each hash's smallest document and
answers the others; a document's answered windows are found again in its text and merged into intervals.  Only documents that may have answers
are shuffled to meet them.
Windows are told apart by the polynomial of their words' 64-bit hashes modulo the prime 2**61 - 1: among n different windows, one is expected to meet a
stranger with a chance of about n / 2**61, whatever the texts look like.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, column, in_batches, mix, pieces, screened, windows, written

WINDOW = 13
#: Windows that a bucket should get; a task holds about 50 bytes for each of one bucket's.
BUCKET_WINDOWS = 3 << 20
#: At least so many buckets, that small tables too are spread over tasks.
LEAST_BUCKETS = 64
#: Bytes of text to a slice.
SLICE = 4 << 20


def _hashes(text: pa.Array, k: int) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words of some texts, and each window's hash and first word."""
    w = Words(text)
    h, at = windows(w.hashes(), w.doc, k)
    return w, h, at


def _rows(bucket: np.ndarray, h: np.ndarray, doc: np.ndarray, settled: bool) -> pa.RecordBatch:
    """One row for each bucket; bucket ascends, and doc does within a bucket."""
    n = len(h)
    first = np.flatnonzero(np.diff(bucket, prepend=-1)) if n else np.zeros(0, np.int64)
    run = np.flatnonzero((np.diff(bucket, prepend=-1) != 0) | (np.diff(doc, prepend=doc[:1] - 1) != 0)) if n else first
    ends = np.append(first, n)
    runs = np.searchsorted(run, ends).astype(np.int32)
    count = np.diff(np.append(run, n)).astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((ends * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(h))])
    docs = pa.ListArray.from_arrays(pa.array(runs), pa.array(doc[run]))
    counts = pa.ListArray.from_arrays(pa.array(runs), pa.array(count))
    return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), packed, docs, counts, pa.array(np.full(len(first), settled))], ["bucket", "hashes", "docs", "counts", "settled"])


def repeated(docs: DataFrame, k: int, buckets: int) -> DataFrame:
    """doc_id and ``hashes``, the packed hashes of those of its windows that also start in a document of a smaller doc_id.

    A document has a row for each bucket with such windows.  ``docs`` has doc_id (long, not null) and text.
    """
    shift = U64(64 - buckets.bit_length() + 1)  # buckets is a power of two

    def emit(batches):
        for b in pieces(batches, limit=SLICE):
            w, h, at = _hashes(column(b, "text"), k)
            doc = np.asarray(column(b, "doc_id"))[w.doc[at]]
            by = np.lexsort((doc, h))
            h, doc = h[by], doc[by]
            head = np.ones(len(h), bool)
            head[1:] = h[1:] != h[:-1]
            least = np.repeat(doc[head], np.diff(np.append(np.flatnonzero(head), len(h))))
            # A document's further windows of a hash need no second answer; later documents' are settled.
            new = head.copy()
            new[1:] |= doc[1:] != doc[:-1]
            for chosen, settled in ((head, False), (new & (doc > least), True)):
                x, d = h[chosen], doc[chosen]
                bucket = (x >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(x), np.int64)
                order = np.lexsort((d, bucket))
                yield _rows(bucket[order], x[order], d[order], settled)

    def answer(batches):
        for rows in _by_bucket(batches):
            h = np.frombuffer(b"".join(rows["hashes"].to_pylist()), U64)
            doc = np.repeat(rows["docs"].combine_chunks().flatten().to_numpy(), rows["counts"].combine_chunks().flatten().to_numpy())
            sizes = np.asarray(rows["counts"].combine_chunks().value_lengths())
            entry = np.repeat(np.repeat(np.asarray(rows["settled"]), sizes), rows["counts"].combine_chunks().flatten().to_numpy())
            by = np.argsort(h, kind="stable")
            h, doc, entry = h[by], doc[by], entry[by]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
            least = np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, len(h)))) if len(h) else doc
            late = (doc > least) | entry
            h, doc = h[late], doc[late]
            order = np.argsort(doc, kind="stable")
            h, doc = h[order], doc[order]
            start = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
            ends = np.append(start, len(doc))
            packed = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer((ends * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(h))])
            yield pa.RecordBatch.from_arrays([pa.array(doc[start]), packed], ["doc_id", "hashes"])

    sent = docs.mapInArrow(emit, "bucket int, hashes binary, docs array<long>, counts array<int>, settled boolean")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets)
    return sent.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(answer, "doc_id long, hashes binary")


def _by_bucket(batches):
    """Tables of all the rows of one bucket, from sorted batches."""
    held, at = [], None
    for b in batches:
        bucket = np.asarray(column(b, "bucket"))
        edge = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        for lo, hi in zip(edge, edge[1:], strict=False):
            if lo == hi:
                continue
            if held and bucket[lo] != at:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            at = bucket[lo]
    if held:
        yield pa.Table.from_batches(held)


def buckets_for(docs: DataFrame, text: str = "text") -> int:
    """A power of two of buckets for all windows of the table, from its bytes."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(LEAST_BUCKETS, 1 << (int(total) // 6 // BUCKET_WINDOWS).bit_length())


def _answered(docs: DataFrame, k: int, text: str) -> tuple[DataFrame, str]:
    """``docs`` with a further last column, the lists of their windows that are to go, and its name."""
    name = "_hashes"
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    late = written(repeated(own.where("doc_id is not null and text is not null"), k, buckets_for(own)), "answers")
    answers = late.groupBy(F.col("doc_id").alias(f"{name}id")).agg(F.collect_list("hashes").alias(name))
    maybe, surely = screened(docs, late)
    met = maybe.join(answers, maybe["doc_id"] == answers[f"{name}id"], "left").drop(f"{name}id")
    return met.union(surely.withColumn(name, F.lit(None).cast("array<binary>"))), name


def _gone(batch: pa.RecordBatch, text: str, k: int, name: str) -> tuple[Words, np.ndarray]:
    """The words of a slice of answered documents, and which of them a repeated window covers."""
    w, h, at = _hashes(column(batch, text), k)
    lists = [b"".join(x) if x else b"" for x in column(batch, name).to_pylist()]
    size = np.array([len(x) // 8 for x in lists], np.int64)
    salt = np.arange(w.docs, dtype=np.int64).view(U64) * U64(0x9E3779B97F4A7C15)
    wanted = np.sort(mix(np.frombuffer(b"".join(lists), U64) + np.repeat(salt, size)))
    mine = mix(h + salt[w.doc[at]])
    if len(wanted):
        found = wanted[np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)] == mine
    else:
        found = np.zeros(len(mine), bool)
    steps = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(steps, at[found], 1)
    np.add.at(steps, at[found] + k, -1)
    return w, np.cumsum(steps[:-1]) > 0


def remove_repeats(docs: DataFrame, k: int = WINDOW, text: str = "text") -> DataFrame:
    """Each document's removal intervals, and a digest of the words that they leave.

    Columns: doc_id, n_words, n_removed, intervals (array of [first word, last word + 1]), kept_sha256 (of the kept
    words, joined by one space).  A window is ``k`` consecutive words ``[^\\x20\\x09-\\x0D]+`` of one
    document; it is removed if its words also start in a document of a smaller doc_id.  Windows
    are judged on the input.  A null text has no words; a document without doc_id has no place in
    the order: it is kept whole and takes nothing from others.  Ids are whole numbers, or are cast to such.  Rows of one doc_id don't
    take from each other.  An empty table gives no rows; other columns are not read.
    """
    in_batches(docs.sparkSession)
    joined, name = _answered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")), k, "text")

    def strip(batches):
        for b in pieces(batches):
            w, gone = _gone(b, "text", k, name)
            removed = np.bincount(w.doc[gone], minlength=w.docs)
            same = w.doc[1:] == w.doc[:-1]
            first = np.flatnonzero(gone & ~(np.append(False, gone[:-1] & same) if len(gone) else gone))
            stop = np.flatnonzero(gone & ~(np.append(gone[1:] & same, False) if len(gone) else gone)) + 1
            base = w.first[w.doc[first]]
            spans = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(first) + 1, 2, dtype=np.int32)), pa.array(np.stack([first - base, stop - base], 1).ravel()))
            spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(w.doc[first], minlength=w.docs))]).astype(np.int32)), spans)
            kept = _joined(w, ~gone)
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id"), pa.array(w.n), pa.array(removed.astype(np.int64)), spans, pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())],
                ["doc_id", "n_words", "n_removed", "intervals", "kept_sha256"],
            )

    return joined.mapInArrow(strip, "doc_id long, n_words long, n_removed long, intervals array<array<long>>, kept_sha256 string")


def without_repeats(docs: DataFrame, k: int = WINDOW, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` with repeated windows cut out of their texts; all columns stay, in order.

    A cut goes from a removed word to the next kept one; what is left keeps its white space, so a text without repeats
    stays as it is.  A column ``chars``, where there is one, counts the new text's code points for rows with a text.  Rules and odd cases are
    those of :func:`remove_repeats`.
    """
    in_batches(docs.sparkSession)
    joined, name = _answered(docs, k, text)
    names = docs.columns

    def strip(batches):
        for b in pieces(batches, text):
            w, gone = _gone(b, text, k, name)
            old = column(b, text)
            new = old
            if gone.any():
                # Everything from a removed word to the next word, or to the text's end, goes.
                after = np.append(w.start[1:], len(w.raw))
                after = np.minimum(after, w.bounds[w.doc + 1])
                mark = np.zeros(len(w.raw) + 1, np.int64)
                np.add.at(mark, w.start[gone], 1)
                np.add.at(mark, after[gone], -1)
                stays = np.cumsum(mark[:-1]) == 0
                total = np.concatenate([[0], np.cumsum(stays)])
                flat, edge = w.raw[stays].tobytes(), total[w.bounds]
                touched = np.bincount(w.doc[gone], minlength=w.docs) > 0
                cut = [flat[s:e].decode().rstrip(" \t\n\r\x0b\x0c") if t else flat[s:e].decode() for s, e, t in zip(edge[:-1].tolist(), edge[1:].tolist(), touched.tolist(), strict=True)]
                new = pa.array([c if there else None for there, c in zip(old.is_valid().to_pylist(), cut, strict=True)], old.type)
            cols = {n: column(b, n) for n in names} | {text: new}
            if chars in cols and pa.types.is_integer(cols[chars].type):
                cols[chars] = pc.if_else(old.is_valid(), pc.utf8_length(new).cast(cols[chars].type), cols[chars])
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names)

    return joined.mapInArrow(strip, docs.schema)


def _joined(w: Words, kept: np.ndarray) -> list[bytes]:
    """Each document's kept words, joined by one space."""
    size = (w.end - w.start)[kept] + 1
    ends = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(len(w.raw) + 1, np.int8)
    mark[w.start[kept]] += 1
    mark[w.end[kept]] -= 1
    inside = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
    out = np.full(ends[-1], 32, np.uint8)
    at = np.ones(ends[-1], bool)
    at[ends[1:] - 1] = False
    out[at] = w.raw[inside]
    flat = out.tobytes()
    last = np.cumsum(np.bincount(w.doc[kept], minlength=w.docs))
    edge = ends[np.concatenate([[0], last])]
    return [flat[s : max(s, e - 1)] for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def oracle_sql(k: int = WINDOW, source: str = "documents") -> str:
    """DuckDB SQL with doc_id, n_words, n_removed and kept_sha256 of :func:`remove_repeats`, for ids that are unique and not null."""
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM {source}),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {k} + 2)) AS i FROM w WHERE len(ws) >= {k}),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + {k - 1}], ' ') AS s FROM starts),
least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT win.doc_id, win.i + j AS pos FROM win JOIN least USING (s), range({k}) t(j) WHERE least.m < win.doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
marked AS (SELECT words.*, gone.pos IS NOT NULL AS out FROM words LEFT JOIN gone USING (doc_id, pos)),
left_over AS (SELECT doc_id, count(*) FILTER (WHERE out) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT out), '') AS kept FROM marked GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN left_over USING (doc_id)"""
