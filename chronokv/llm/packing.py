"""Packing token sequences by shortest-pack-first over the histogram of lengths.

After Krell et al. 2021: lengths are placed longest first, each into the open packs with the
most room; only counts of packing patterns are kept, so the work follows the number of distinct
lengths, not of documents.  Patterns are joined back to documents by their rank within a length.
"""

from __future__ import annotations

import bisect
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, gapless, in_batches, pieces, written

TOKENS = 1024
END_ID = 0
#: Distinct words whose ids a worker keeps between slices.
CACHED_WORDS = 300_000
_UNIT = re.compile(r"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")
#: Space characters beyond ASCII's: a text with one of them is encoded in one go.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")


class ByteBpe:
    """Ids of a byte-level BPE file, encoded once per distinct word that a worker still holds.

    The pre-tokenizer never joins a word to the white space after it, so a text's ids are those of its
    words, each with the white space before it.  A text with unusual white space or the
    string of a special token goes to the tokenizers library whole.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = (b for b in range(256) if b not in set(visible))
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("of-file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.units = _Units(self.fast)
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = []
        flat: list[int] = []
        size = []
        if len(self.units) > CACHED_WORDS:
            self.units = _Units(self.fast)
        units = self.units
        for t in texts:
            if _ODD.search(t) or self.special and self.special.search(t):
                out.append(np.array(self.whole.encode(t, add_special_tokens=False).ids, np.uint32))
                size.append(0)
            else:
                before = len(flat)
                flat.extend(map(units.__getitem__, _UNIT.findall(t)))
                out.append(None)
                size.append(len(flat) - before)
        ids, ends = units.ids_of(np.array(flat, np.int64))
        end = ends[np.cumsum(size)]
        return [ids[e - n : e] if x is None else x for x, e, n in zip(out, end, np.diff(end, prepend=0), strict=True)]


class _Units(dict):
    """Numbers of distinct words, given on first sight, and the ids of each."""

    def __init__(self, fast):
        super().__init__()
        self.encode = fast._core_bpe.encode_ordinary  # without the checks for special tokens, which come before
        self.pool = array("I")
        self.at = array("q", [0])

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        self.pool.extend(self.encode(unit))
        self.at.append(len(self.pool))
        return n

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these words, and where each word's ids end, with a 0 in front."""
        at = np.array(self.at, np.int64)
        pool = np.array(self.pool, np.uint32)
        first, size = at[numbers], at[numbers + 1] - at[numbers]
        ends = np.concatenate([[0], np.cumsum(size)])
        shift = np.repeat(first - ends[:-1], size)
        return pool[np.arange(ends[-1]) + shift], ends


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBpe:
    return ByteBpe(path)


def cut_pieces(docs: DataFrame, path: str, tokens: int = TOKENS, end_id: int = END_ID, text: str = "text") -> DataFrame:
    """Each text's ids and an end id, cut into pieces of ``tokens`` ids and one shorter rest.

    Columns: doc_id, start, length, ids_crc32, doc_tokens.  Null and empty texts are one piece of the end id.
    """
    in_batches(docs.sparkSession)
    d = docs.select("doc_id", docs[text].alias("text"))
    key = d.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encoder = tokenizer(path)
        for b in pieces(batches, keep=tokenizer):
            ids = encoder.encode([t or "" for t in column(b, "text").to_pylist()])
            row, start, length, crc, total = [], [], [], [], []
            for i, x in enumerate(ids):
                x = np.append(x, np.uint32(end_id)).astype("<u4")
                for s in range(0, len(x), tokens):
                    part = x[s : s + tokens]
                    row.append(i)
                    start.append(s)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(len(x))
            yield pa.RecordBatch.from_arrays([column(b, "doc_id").take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, length, crc, total))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return d.mapInArrow(run, f"doc_id {key}, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns and how many packs have each, for ``histogram``: length -> number of pieces.

    A pattern is the lengths of a pack in order.  Lengths are from 1 to ``size``.
    """
    if any(not 1 <= n <= size for n in histogram):
        raise ValueError(f"lengths must be from 1 to {size}")
    room: dict[int, list[list]] = {}  # space left -> patterns with their counts
    spaces: list[int] = []  # keys of room in order

    def put(left: int, pattern: tuple[int, ...], count: int) -> None:
        if left not in room:
            room[left] = []
            bisect.insort(spaces, left)
        room[left].append([pattern, count])

    for n in sorted(histogram, reverse=True):
        todo = histogram[n]
        while todo:
            left = spaces[-1] if spaces else 0
            if left < n:
                put(size - n, (n,), todo)
                break
            pattern, count = room[left][-1]
            used = min(count, todo)
            if used == count:
                room[left].pop()
                if not room[left]:
                    del room[left]
                    spaces.pop()
            else:
                room[left][-1][1] -= used
            put(left - n, (*pattern, n), used)
            todo -= used
    return [(tuple(p), c) for left in spaces for p, c in room[left]]


def pack(items: DataFrame, size: int = TOKENS, order: tuple[str, ...] = ("doc_id", "start", "ids_crc32")) -> DataFrame:
    """``items`` (a written table with ``length``) with sequence_id and offset.

    The histogram has at most ``size`` rows, which is all that reaches the driver; the patterns that
    come from it are fewer than a few thousand.  Ranks within a length come from :func:`gapless`, so
    a length that a third of the pieces share is not sorted by one task.  Ties of rows that are equal
    in every column of ``order`` may fall either way, with the same result.
    """
    histogram = {r["length"]: r["count"] for r in items.groupBy("length").count().collect()}
    slots: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for pattern, count in shortest_pack_first(histogram, size):
        at = 0
        for n in pattern:
            slots.setdefault(n, []).append((taken.get(n, 0), base, at))
            taken[n] = taken.get(n, 0) + count
            at += n
        base += count
    lookup = {n: tuple(np.array(c, np.int64) for c in zip(*s, strict=True)) for n, s in slots.items()}

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        by = np.argsort(n, kind="stable")
        edges = np.flatnonzero(np.diff(n[by])) + 1
        for part in np.split(by, edges) if len(by) else []:
            first, seq, at = lookup[int(n[part[0]])]
            k = np.searchsorted(first, r[part], side="right") - 1
            sequence[part], offset[part] = seq[k] + r[part] - first[k], at[k]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    ranked = gapless(items, ["length"], [F.col(f"`{c}`") for c in order], "_rank").withColumn("_slot", place("length", "_rank"))
    return ranked.select(*items.columns, "_slot.sequence_id", "_slot.offset")


def packed(docs: DataFrame, path: str, tokens: int = TOKENS) -> DataFrame:
    """Every piece of every document and its place in a sequence of at most ``tokens`` ids.

    Null doc_ids and repeated rows are packed like any other; an empty table gives no rows.
    """
    out = pack(written(cut_pieces(docs, path, tokens), "pieces"), tokens)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
