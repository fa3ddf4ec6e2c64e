"""Greedy word-piece counts in linear time: a trie with failure links that carry counts (Song et al. 2021).

Where no edge leads on, a node's failure link leads to the node for what is left after the longest
pieces so far are popped; how many those are is worked out beforehand.  So a word's pieces are counted in one
pass over its bytes, and no piece is ever built.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONG_WORD, Words, column, in_batches, pieces

START, INNER, NONE = 0, 1, -1
SLICE = 2 << 20


class PieceAutomaton:
    """Counts pieces of words: ``first`` holds the pieces that may begin a word, ``inner`` those that may follow, as bytes."""

    def __init__(self, first: list[bytes], inner: list[bytes]):
        child: list[dict[int, int]] = [{}, {}]
        whole = [False, False]
        for root, some in ((START, first), (INNER, inner)):
            for piece in some:
                at = root
                for byte in piece:
                    nxt = child[at].get(byte)
                    if nxt is None:
                        nxt = child[at][byte] = len(child)
                        child.append({})
                        whole.append(False)
                    at = nxt
                if piece:
                    whole[at] = True
        fail, pops = [NONE] * len(child), [0] * len(child)
        layer = [START, INNER]
        while layer:
            below = []
            for parent in layer:
                for byte, v in child[parent].items():
                    below.append(v)
                    if whole[v]:
                        fail[v], pops[v] = INNER, 1
                        continue
                    z, n = fail[parent], pops[parent]
                    while z != NONE and byte not in child[z]:
                        n += pops[z]
                        z = fail[z]
                    if z != NONE:
                        fail[v], pops[v] = child[z][byte], n
            layer = below
        key = np.array([v * 256 + b for v, c in enumerate(child) for b in c], np.int64)
        to = np.array([x for c in child for x in c.values()], np.int64)
        by = np.argsort(key)
        self.key, self.to = key[by], to[by]
        self.fail, self.pops = np.array(fail, np.int64), np.array(pops, np.int64)
        #: The same tables for words that are counted one by one, made when the first of them comes.
        self.steps: tuple[dict[int, int], list[int], list[int]] | None = None

    def _step(self, at: np.ndarray, byte: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.full(len(at), NONE)
        key = at * 256 + byte
        i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[i] == key, self.to[i], NONE)

    def count(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pieces of each word raw[start:end]; 0 for a word that pieces don't cover.

        Words advance together, a byte at a time; those of more than ``LONG_WORD`` bytes, which would go on alone, are counted one by one.
        """
        n = np.zeros(len(start), np.int64)
        state = np.full(len(start), START)
        long = end - start > LONG_WORD
        if long.any():
            n[~long] = self.count(raw, start[~long], end[~long])
            for i in np.flatnonzero(long).tolist():
                n[i] = self.count_one(raw[start[i] : end[i]].tobytes())
            return n
        going = np.flatnonzero(end > start)
        at = start.copy()
        while len(going):
            byte = raw[at[going]].astype(np.int64)
            wait = np.arange(len(going))
            while len(wait):
                who = going[wait]
                nxt = self._step(state[who], byte[wait])
                moved = nxt != NONE
                state[who[moved]] = nxt[moved]
                wait, who = wait[~moved], who[~moved]
                n[who] += self.pops[state[who]]
                state[who] = self.fail[state[who]]
                wait = wait[state[who] != NONE]
            going = going[state[going] != NONE]
            at[going] += 1
            going = going[at[going] < end[going]]
        rest = np.flatnonzero((state != NONE) & (end > start) & (state != INNER))
        while len(rest):
            n[rest] += self.pops[state[rest]]
            state[rest] = self.fail[state[rest]]
            rest = rest[(state[rest] != NONE) & (state[rest] != INNER)]
        return np.where(state == INNER, n, 0)

    def count_one(self, word: bytes) -> int:
        """Pieces of one word, 0 if they don't cover it, in plain steps."""
        if self.steps is None:
            self.steps = dict(zip(self.key.tolist(), self.to.tolist(), strict=True)), self.fail.tolist(), self.pops.tolist()
        step, fail, pops = self.steps
        n, at = 0, START
        for byte in word:
            while (to := step.get(at * 256 + byte)) is None:
                n += pops[at]
                at = fail[at]
                if at == NONE:
                    return 0
            at = to
        while at not in (NONE, INNER):
            n += pops[at]
            at = fail[at]
        return n if at == INNER else 0


def byte_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces of a byte-level vocabulary file: those with a space in front begin words, the others follow."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"] for t in spec["added_tokens"]}
    every = [bytes(byte[c] for c in t) for t in spec["model"]["vocab"] if t not in special]
    return [p for p in every if p[:1] == b" "], [p for p in every if p[:1] != b" "]


@lru_cache(maxsize=2)
def automaton(path: str) -> PieceAutomaton:
    return PieceAutomaton(*byte_pieces(path))


def counted(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown and longest (most tokens of a word) of every whole text.

    A word ``[^\\x20\\x09-\\x0D]+`` gets a space in front and is cut greedily into the longest pieces of the
    vocabulary at ``path``; a word that they don't cover is unknown and counts as one token.  Each distinct word of a
    slice is counted once.  Null and empty texts have no words; null ids and repeated rows stay; an empty table gives no rows.
    """
    in_batches(docs.sparkSession)
    d = docs.select("doc_id", F.col(text).alias("text"))

    def run(batches):
        a = automaton(path)
        for b in pieces(batches, limit=SLICE, keep=automaton):
            w = Words(column(b, "text"))
            _, one, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
            size = w.end[one] - w.start[one] + 1
            ends = np.cumsum(size)
            raw = np.full(ends[-1] if len(ends) else 0, 32, np.uint8)
            inner = np.ones(len(raw), bool)
            inner[ends - size] = False
            raw[inner] = w.raw[np.repeat(w.start[one] - (ends - size) - 1, size - 1) + np.flatnonzero(inner)]
            n = a.count(raw, ends - size, ends)[back]
            tokens = np.maximum(n, 1)
            longest = np.zeros(w.docs, np.int64)
            np.maximum.at(longest, w.doc, tokens)
            total = np.bincount(w.doc, weights=tokens, minlength=w.docs).astype(np.int64)
            unknown = np.bincount(w.doc[n == 0], minlength=w.docs).astype(np.int64)
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), *(pa.array(c) for c in (w.n, total, unknown, longest))], ["doc_id", "n_words", "n_tokens", "n_unknown", "longest"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long, n_unknown long, longest long")
