"""BPE encoding and decoding with a pair occurrence index.

A partition is taken in slices of ``INDEX_BYTES`` of text, and runs without white space are normalised once each; all words of a slice that its worker has not met yet are encoded together.  The index maps each adjacent pair of symbols to all
its positions; the active pair of the least rank is merged at every position at once, and
the lists of the pairs beside those positions are updated.  Positions that an earlier merge has changed are skipped
when their pair comes up.  A word's merges are those it would get alone, since a heap always yields the least
active rank.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Regex, normalizers, pre_tokenizers

from .common import column, filled, in_batches, pieces

#: White space of the normalizer's \s.
_GAP = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
#: Slots of the table of pairs, as a power of two.
SLOT_BITS = 19
#: Characters that str.split takes for white space and the normalizer doesn't.
_ODD = "\x1c\x1d\x1e\x1f"
#: Bytes of text that share an index: the more, the fewer passes over the active ranks.
INDEX_BYTES = 16 << 20
#: Distinct words whose ids a worker keeps from one slice to the next.
CACHED_WORDS = 600_000


def _class(kind: str) -> str:
    """The characters of a Unicode kind, as ranges for a pattern, by the tables of the tokenizers library: other libraries' are of other versions."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    spans = (at for _, at in pre_tokenizers.Split(Regex(f"[^\\p{{{kind}}}]+"), "removed").pre_tokenize_str(every))
    return "".join(f"{re.escape(every[a])}-{re.escape(every[b - 1])}" for a, b in spans)


@lru_cache(maxsize=1)
def tables() -> tuple[str, str]:
    """Two patterns: the rule by which the pre-tokenizer finds words in a run without white space, and the characters that Python's own tables don't know.

    They take seconds to make, so the driver does.
    """
    letter, digit = _class("L"), _class("N")
    gap = [unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)]
    edge = [c for c in range(0x110001) if (c < 0x110000 and gap[c]) != (c > 0 and gap[c - 1])]
    unknown = "".join(f"{re.escape(chr(a))}-{re.escape(chr(b - 1))}" for a, b in zip(edge[::2], edge[1::2], strict=True))
    return f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{digit}]|[^{letter}{digit}]+", f"[{unknown}]"


class WordBpe:
    """Encoder and decoder for a BPE file with word ends, lower case and no white space."""

    def __init__(self, path: str, patterns: tuple[str, str] | None = None):
        self.rule, self.unknown = map(re.compile, patterns or tables())
        #: For texts with characters of a later Unicode version than Python's, whose lower case and compositions Python can't tell.
        self.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._forget()
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [""] * self.size
        for t, i in chain(vocab.items(), self.special.items()):
            self.token[i] = t
        #: Of each id, its decimal number and its token.
        self.marks = pa.array(map(str, range(self.size)), pa.large_string()), pa.array(self.token, pa.large_string())
        left, right, made = [], [], []
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            left.append(vocab[a])
            right.append(vocab[b])
            made.append(vocab[a + b])
        self.left, self.right, self.made = (np.array(x, np.int64) for x in (left, right, made))
        key = self.left * self.size + self.right
        self.key_rank = np.argsort(key, kind="stable")
        self.keys = key[self.key_rank]
        # A table of ranks by a hash of the pair; a slot that two pairs share sends its askers to a binary search.
        slot = self._slot(key)
        self.slots = np.full(1 << SLOT_BITS, -1, np.int32)
        self.slots[slot] = np.arange(len(key))
        self.slots[np.flatnonzero(np.bincount(slot, minlength=1 << SLOT_BITS) > 1)] = -2
        self.pair = np.append(key, -1)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        char = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.inner = np.array([vocab[char[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[char[b] + self.suffix] for b in range(256)], np.int64)

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; -1 where the pair is never merged."""
        key = a.astype(np.int64) * self.size + b
        rank = self.slots[self._slot(key)]
        shared = np.flatnonzero(rank == -2)
        rank[self.pair[rank] != key] = -1
        if len(shared):
            some = key[shared]
            at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
            rank[shared] = np.where(self.keys[at] == some, self.key_rank[at], -1)
        return rank

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word, given as its bytes."""
        if not words:
            return []
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size)
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        symbol = self.inner[raw]
        symbol[ends - 1] = self.last[raw[ends - 1]]
        # Position n stands for "beyond the word"; its symbol -1 belongs to no pair.
        symbol = np.append(symbol, -1).astype(np.int32)
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[ends - 1] = n
        before[ends - size] = n
        before = np.append(before, np.int32(n))
        after[n] = n
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(at: np.ndarray) -> None:
            """Enter the pairs that begin at these positions."""
            rank = self.ranks(symbol[at], symbol[after[at]])
            good = rank >= 0
            at, rank = at[good], rank[good]
            if not len(at):
                return
            by = np.argsort(rank.astype(np.uint16) if len(self.made) <= 1 << 16 else rank, kind="stable")
            at, rank = at[by], rank[by]
            first = np.flatnonzero(np.diff(rank, prepend=-1))
            edge = [*first.tolist(), len(at)]
            for i, r in enumerate(rank[first].tolist()):
                part = at[edge[i] : edge[i + 1]]
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(active, r)

        note(np.flatnonzero(after[:n] < n))
        while active:
            r = heapq.heappop(active)
            held = index.pop(r)
            at = held[0] if len(held) == 1 else np.concatenate(held)
            a, b = self.left[r], self.right[r]
            nxt = after[at]
            at = at[(symbol[at] == a) & (symbol[nxt] == b)]
            if a == b and len(at) > 1:  # of a run of the same symbol, every other position from the left
                at = np.unique(at)
                joined = np.append(False, after[at[:-1]] == at[1:])
                order = np.arange(len(at))
                head = np.maximum.accumulate(np.where(joined, 0, order))
                at = at[(order - head) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            symbol[at] = self.made[r]
            beyond = after[gone]
            after[at] = beyond
            symbol[gone] = -1
            before[beyond[beyond < n]] = at[beyond < n]
            prior = before[at]
            note(np.concatenate([prior[prior < n], at]))
        kept = np.flatnonzero(symbol[:n] >= 0)
        ids = symbol[kept]
        return np.split(ids, np.searchsorted(kept, ends[:-1]))

    def _forget(self) -> None:
        self.known, self.ids, self.written = _Units(self.normal, self.special), [], ([], [], [])

    def units(self, text: str) -> list[str]:
        """Runs without white space, as they stand; a special token is a run of its own, and no other run is equal to one."""
        def plain(t: str) -> list[str]:
            return [u for u in _GAP.split(t) if u] if any(c in t for c in _ODD) else t.split()

        if not self.special_at or "<|" not in text and not self.special_at.search(text):
            return plain(text)
        return [u for k, part in enumerate(self.special_at.split(text)) for u in ([part] if k % 2 else plain(part))]

    def normal(self, unit: str) -> str:
        """What a run without white space is normalised to: no white space composes with what follows it, so this is its part of the normalised text."""
        if unit.isascii():
            return unit.lower()
        if self.unknown.search(unit):
            return self.normalizer.normalize_str(unit)
        return unicodedata.normalize("NFC", unit).replace("\u03a3", "\u03c3").lower()  # lower case is by character: no final sigma

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[np.ndarray]]:
        """Each text as numbers of units, and the ids of every unit; only units not seen lately are encoded."""
        if len(self.known) > CACHED_WORDS:
            self._forget()
        docs = [list(map(self.known.__getitem__, self.units(t))) for t in texts]
        words, rule = _Numbers(), self.rule
        made = []
        for u in islice(self.known.forms, len(self.ids), None):
            made.append(u if isinstance(u, int) else [words[w.encode()] for w in (_ASCII_WORD if u.isascii() else rule).findall(u)])
        ids = self.encode_words(list(words))
        none = np.zeros(0, np.int64)
        for m in made:
            self.ids.append(np.array([m]) if isinstance(m, int) else ids[m[0]] if len(m) == 1 else np.concatenate([ids[w] for w in m]) if m else none)
        return docs, self.ids

    def strings(self) -> tuple[list[int], list[str], list[str]]:
        """Of each known unit how many ids it has, the ids, and the unit decoded, as they stand in a text's."""
        new = self.ids[len(self.written[0]) :]
        if new:
            size = np.fromiter(map(len, new), np.int64, len(new))
            ids, ends = np.concatenate(new), np.concatenate([[0], np.cumsum(size)])
            self.written[0].extend(size.tolist())
            for to, marks in zip(self.written[1:], self.marks, strict=True):
                to.extend(pc.binary_join(pa.LargeListArray.from_arrays(ends, marks.take(pa.array(ids))), pa.scalar(" ", marks.type)).to_numpy(zero_copy_only=False).tolist())
        return self.written

    def encode_ids(self, text: str) -> list[int]:
        docs, ids = self.encode([text])
        return [int(i) for u in docs[0] for i in ids[u]]

    def decode(self, ids) -> str:
        """The tokens' strings joined by spaces: the file names no decoder; unknown ids are left out."""
        return " ".join(self.token[i] for i in ids if 0 <= i < self.size)


class _Numbers(dict):
    """Counts distinct keys in the order of their first sight."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


class _Units(dict):
    """Numbers of runs by what they are normalised to: each run is normalised once.  ``forms`` has the normal forms in the order of their numbers, and ids for special tokens."""

    def __init__(self, normal: Callable[[str], str], special: dict[str, int]):
        super().__init__()
        self.normal, self.special, self.forms = normal, special, _Numbers()

    def __missing__(self, unit: str) -> int:
        self[unit] = n = self.forms[self.special[unit] if unit in self.special else self.normal(unit)]
        return n


@lru_cache(maxsize=2)
def encoder(path: str, patterns: tuple[str, str] | None = None) -> WordBpe:
    return WordBpe(path, patterns)


def encoded(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id and ``ids``, the token ids of each whole text; null and empty texts have none.

    Rows stay as they are: null ids, repeated rows and clashing columns don't matter, as only the two columns are read.
    """
    in_batches(docs.sparkSession)
    d = docs.select("doc_id", docs[text].alias("text"))
    key = d.schema["doc_id"].dataType.simpleString()
    patterns = tables()

    def run(batches):
        e = encoder(path, patterns)
        for b in pieces(filled(batches, INDEX_BYTES), limit=INDEX_BYTES, keep=encoder):
            units, ids = e.encode([t or "" for t in column(b, "text").to_pylist()])
            rows = [np.concatenate([ids[u] for u in x]).astype(np.int32) if x else np.zeros(0, np.int32) for x in units]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return d.mapInArrow(run, f"doc_id {key}, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and the text that each row's ``ids`` decode to; null ids give a null."""
    key = rows.schema["doc_id"].dataType.simpleString()
    patterns = tables()

    def run(batches):
        e = encoder(path, patterns)
        for b in batches:
            out = [None if x is None else e.decode(x) for x in column(b, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {key}, text string")


def digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of each document's ids and of what they decode to.

    The same encoder and decoder as :func:`encoded` and :func:`decoded`; each unit's ids and decoded string are written out
    once in a slice, so that no id passes through a row.
    """
    in_batches(docs.sparkSession)
    d = docs.select("doc_id", docs[text].alias("text"))
    key = d.schema["doc_id"].dataType.simpleString()
    patterns = tables()

    def run(batches):
        e = encoder(path, patterns)
        for b in pieces(filled(batches, INDEX_BYTES), limit=INDEX_BYTES, keep=encoder):
            units, _ = e.encode([t or "" for t in column(b, "text").to_pylist()])
            n, number, string = e.strings()
            if 0 in n:
                units = [[u for u in x if n[u]] for x in units]
            sha = lambda part, x: hashlib.sha256(" ".join(map(part.__getitem__, x)).encode()).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id"), pa.array([sum(map(n.__getitem__, x)) for x in units], pa.int64()), pa.array([sha(number, x) for x in units]), pa.array([sha(string, x) for x in units])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return d.mapInArrow(run, f"doc_id {key}, n_tokens long, ids_sha256 string, decoded_sha256 string")
