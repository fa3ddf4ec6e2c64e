"""SimHash near-duplicates with a Gray-order hierarchical index.

All distinct fingerprints stand in one order, that of their Gray rank, in which neighbours share leading bits and differ in few
others.  The order is dealt out in parts.  A part is a tree: groups of neighbours are leaves; a node above holds the bits that all
below it share, as a mask and a pattern, and those bits are compared once: what they differ by is carried down, and a
group whose carried differences pass the limit is left out whole.  The parts' own masks and patterns are the leaves of an upper tree, small enough
for every task, by which a fingerprint finds the parts that may hold near ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, column, in_batches, larger, pieces, unite, written, xxh64
from .links import components

BITS = 64
#: Fingerprints in a leaf, and children of a node.
LEAF, FAN = 16, 8
#: Fingerprints of a part, and the least and most parts.  Beyond the most, parts grow; every task holds the upper tree of this many leaves at most.
PART_CODES, LEAST_PARTS, MOST_PARTS = 1 << 15, 32, 4096
#: Fingerprints that one task asks of a part: a part with more askers is copied to several tasks.
ASKERS = 1 << 17
#: Queries that descend a tree together.
BLOCK = 512
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", fold: bool = True) -> DataFrame:
    """doc_id and ``bits``, each whole text's SimHash as a signed 64-bit number.

    A-Z become lower case if ``fold``; words are ``[^\\x20\\x09-\\x0D]+``; shingles of ``shingle`` words joined by a space count as
    often as they occur (fewer words: the whole sequence; none or a null: zero).  Bit i is set if
    bit i of XXH64 (seed 42) is set in over half the shingles.
    """
    in_batches(docs.sparkSession)
    d = docs.select("doc_id", docs[text].alias("text"))
    key = d.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in pieces(batches):
            codes = fingerprint_bits(Words(column(b, "text")), shingle, fold)
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(codes.view(np.int64))], ["doc_id", "bits"])

    return d.mapInArrow(run, f"doc_id {key}, bits long")


def fingerprint_bits(w: Words, shingle: int, fold: bool) -> np.ndarray:
    """The SimHash of each text of a slice."""
    size = w.end - w.start
    # One buffer with each word and a space after it.
    to = np.concatenate([[0], np.cumsum(size + 1)])
    raw = np.full(to[-1], 32, np.uint8)
    at = np.ones(to[-1], bool)
    at[to[1:] - 1] = False
    raw[at] = _UPPER[w.raw[w.inside]] if fold else w.raw[w.inside]
    # Shingles: from word i to word i + k - 1 of the same text, or a short text's first to last word.
    m = len(size) - shingle + 1
    first = np.flatnonzero(w.doc[:m] == w.doc[shingle - 1 :]) if m > 0 else np.zeros(0, np.int64)
    short = np.flatnonzero((w.n > 0) & (w.n < shingle))
    doc = np.concatenate([w.doc[first], short])
    begin = np.concatenate([to[first], to[w.first[short]]])
    end = np.concatenate([to[first + shingle], to[w.first[short] + w.n[short]]]) - 1
    by = np.argsort(doc, kind="stable")
    h = xxh64(raw, begin[by], end[by], 42)
    return majority(h, doc[by], w.docs)


def majority(hashes: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """For each document, the bits that over half of its hashes have; ``doc`` ascends."""
    n = np.bincount(doc, minlength=docs)
    out = np.zeros(docs, U64)
    if not len(hashes):
        return out
    some = np.flatnonzero(n)
    first = np.concatenate([[0], np.cumsum(n[some])[:-1]])
    # Eight counters of a byte each ride in one number, so hashes are added up in runs of at most 255.
    inner = np.arange(len(hashes)) - np.repeat(first, n[some])
    begin = np.flatnonzero(inner % 255 == 0)
    own = np.searchsorted(begin, first)
    lanes = U64(0x0101010101010101)
    for i in range(8):
        runs_of = np.add.reduceat((hashes >> U64(i)) & lanes, begin).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(runs_of.astype(np.int64), own, axis=0)
        set_bits = 2 * ones > n[some][:, None]
        for byte in range(8):
            out[some] |= set_bits[:, byte].astype(U64) << U64(8 * byte + i)
    return out


def gray_rank(code: np.ndarray) -> np.ndarray:
    """The place of each 64-bit pattern in the reflected binary Gray order."""
    x = code.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> U64(s)
    return x


class MaskTree:
    """Nodes of shared bits over groups of fingerprints in Gray order; a group is given by the AND and the OR of its members."""

    def __init__(self, every: np.ndarray, some: np.ndarray):
        #: From the lowest groups up: mask of shared bits, their pattern.
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        #: Groups that queries have met, and those of them that were left out whole.
        self.met = self.pruned = 0
        while True:
            mask = ~(every ^ some)
            self.levels.append((mask, every & mask))
            if len(mask) <= 1:
                break
            every, some = shared_bits(every, some, FAN)

    def descend(self, queries: np.ndarray, most: int):
        """Batches of (query, lowest group, differences so far, bits compared so far) for the groups that may have members within ``most`` bits."""
        if not len(self.levels[0][0]):
            return
        for lo in range(0, len(queries), BLOCK):
            q = np.arange(lo, min(lo + BLOCK, len(queries)))
            node = np.zeros(len(q), np.int64)
            carried = np.zeros(len(q), np.int64)
            above = np.zeros(len(q), U64)
            for depth in range(len(self.levels) - 1, -1, -1):
                mask, pattern = self.levels[depth]
                new = mask[node] & ~above
                carried = carried + np.bitwise_count((queries[q] ^ pattern[node]) & new)
                ok = carried <= most
                self.met += len(ok)
                self.pruned += len(ok) - int(ok.sum())
                q, node, carried, above = q[ok], node[ok], carried[ok], mask[node[ok]]
                if depth:
                    child = (node[:, None] * FAN + np.arange(FAN)).ravel()
                    there = child < len(self.levels[depth - 1][0])
                    q, carried, above = (np.repeat(x, FAN)[there] for x in (q, carried, above))
                    node = child[there]
            yield q, node, carried, above


def shared_bits(every: np.ndarray, some: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """AND and OR of each ``step`` neighbours."""
    at = np.arange(0, len(every), step)
    return (np.bitwise_and.reduceat(every, at), np.bitwise_or.reduceat(some, at)) if len(every) else (every, some)


class GrayIndex(MaskTree):
    """A tree over distinct fingerprints, with ``LEAF`` neighbours in Gray order to a leaf."""

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes = codes[self.order]
        super().__init__(*shared_bits(self.codes, self.codes, LEAF))

    def near(self, queries: np.ndarray, most: int):
        """Batches of (query, position) whose fingerprints differ in at most ``most`` bits; positions are those of the input."""
        for q, node, carried, above in self.descend(queries, most):
            child = (node[:, None] * LEAF + np.arange(LEAF)).ravel()
            there = child < len(self.codes)
            q, carried, above = (np.repeat(x, LEAF)[there] for x in (q, carried, above))
            at = child[there]
            hit = carried + np.bitwise_count((queries[q] ^ self.codes[at]) & ~above) <= most
            yield q[hit], self.order[at[hit]]


def spanning(members: np.ndarray, askers: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints, fewer than there are, that join what chains of near ones join: every asker is compared with every member."""
    nodes = np.concatenate([members, askers])
    root = np.arange(len(nodes))

    for q, b in GrayIndex(members).near(askers, most):
        root = unite(root, q + len(members), b)
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[moved]], nodes[moved]


def _signed(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers as signed ones in the same order."""
    return (x ^ U64(1 << 63)).view(np.int64)


def near_links(codes: DataFrame, most: int = 2, part_codes: int = PART_CODES, askers: int = ASKERS) -> DataFrame:
    """Links a, b that connect exactly the distinct ``bits`` of ``codes`` that chains of at most ``most`` differing bits connect.

    Bounds of about equal parts of the Gray order come from quantiles; parts may be uneven, no fingerprint is left out.  Each
    fingerprint is a member of its own part and asks there and in every later part that the upper tree doesn't rule out, so each pair is compared
    once.  ``codes`` is read several times: give a written table of distinct, non-null bits.
    """
    spark = codes.sparkSession
    if most == 0:  # distinct codes all differ
        return spark.createDataFrame([], "a long, b long")

    def ranks(batches):
        for b in larger(batches):
            yield pa.RecordBatch.from_arrays([pa.array(_signed(gray_rank(np.asarray(column(b, "bits")).view(U64))))], ["rank"])

    ranked = codes.select("bits").mapInArrow(ranks, "rank long")
    count = codes.count()
    parts = min(max(LEAST_PARTS, -(-count // part_codes)), MOST_PARTS)
    found = ranked.agg(F.percentile_approx("rank", [i / parts for i in range(1, parts)], 20 * parts)).first()[0]
    bounds = np.unique(np.array(found or [], np.int64))

    def part_of(code: np.ndarray) -> np.ndarray:
        return np.searchsorted(bounds, _signed(gray_rank(code)), side="left")

    def groups(batches):
        for b in larger(batches):
            code = np.asarray(column(b, "bits")).view(U64)
            part = part_of(code)
            by = np.argsort(part, kind="stable")
            first = np.flatnonzero(np.diff(part[by], prepend=-1))
            if len(first):
                yield pa.RecordBatch.from_arrays([pa.array(part[by][first]), *(pa.array(f.reduceat(code[by], first).view(np.int64)) for f in (np.bitwise_and, np.bitwise_or))], ["part", "every", "some"])

    nodes = codes.select("bits").mapInArrow(groups, "part long, every long, some long").groupBy("part").agg(F.bit_and("every").alias("every"), F.bit_or("some").alias("some"))
    rows = sorted(tuple(r) for r in nodes.collect())
    number, every, some = (np.array([r[i] for r in rows], np.int64) for i in range(3))

    def route(batches):
        tree = MaskTree(every.view(U64), some.view(U64))
        for b in larger(batches):
            code = np.asarray(column(b, "bits")).view(U64)
            own = part_of(code)
            yield _sent(own, 0, code)
            found = [(q, number[node]) for q, node, _, _ in tree.descend(code, most)]
            q, part = (np.concatenate(x) for x in zip(*found, strict=True))
            later = part >= own[q]
            yield _sent(part[later], 1, code[q[later]])

    sent = written(codes.select("bits").mapInArrow(route, "part long, kind int, bits long"), "routed")
    asking = {r["part"]: -(-r["count"] // askers) for r in sent.where("kind = 1").groupBy("part").count().collect()}
    hot = [F.lit(x) for p, n in asking.items() if n > 1 for x in (p, n)]
    copies = F.coalesce(F.create_map(*hot)[F.col("part")], F.lit(1)) if hot else F.lit(1)
    salt = F.when(F.col("kind") == 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array(F.pmod(F.xxhash64("bits"), copies).cast("int")))
    keys = ["part", "salt"]
    dealt = sent.select("part", F.explode(salt).alias("salt"), "kind", "bits")
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, "kind")

    def run(batches):
        for b in runs(larger(batches), keys):
            code = np.asarray(column(b, "bits")).view(U64)
            edge = changes(b, keys)
            kind = np.asarray(column(b, "kind"))
            for lo, hi in zip(edge, [*edge[1:], len(code)], strict=True):
                middle = lo + int(np.searchsorted(kind[lo:hi], 1))
                x, y = spanning(code[lo:middle], code[middle:hi], most)
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in (x, y)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").where("a != b").distinct()


def _sent(part: np.ndarray, kind: int, code: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64)), pa.array(np.full(len(part), kind, np.int32)), pa.array(code.view(np.int64))], ["part", "kind", "bits"])


def changes(batch: pa.RecordBatch, keys: list[str]) -> list[int]:
    """Where a run of equal keys begins."""
    change = np.zeros(batch.num_rows, bool)
    change[:1] = True
    for k in keys:
        c = np.asarray(column(batch, k))
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change).tolist()


def runs(batches, keys: list[str]):
    """Sorted batches, cut so that no run of equal keys is in two; the longest run is held at once."""
    held = []
    for b in batches:
        if not b.num_rows:
            continue
        last = np.ones(b.num_rows, bool)
        for k in keys:
            c = np.asarray(column(b, k))
            last &= c == c[-1]
        whole = np.flatnonzero(~last)
        cut = whole[-1] + 1 if len(whole) else 0
        if held and not all(column(held[-1], k)[-1].as_py() == column(b, k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        if cut:
            t = pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks()
            yield t.to_batches()[0]
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def near_duplicates(docs: DataFrame, shingle: int = 3, most: int = 2, text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    Fingerprints link at ``most`` or fewer differing bits; a component's id is its smallest doc_id.
    Copies and equal fingerprints become one code before any comparison.  A text that is null or has no words has
    fingerprint zero and links like any other.  Null doc_ids belong to components but don't name them; if all are
    null, so is the id.  Repeated rows stay; an empty table gives no rows.
    """
    prints = written(fingerprints(docs, shingle, text), "prints")
    least = written(prints.groupBy("bits").agg(F.min("doc_id").alias("least")), "codes")
    roots = components(near_links(least, most))
    rooted = least.join(roots, least["bits"] == roots["node"], "left").select("bits", "least", F.coalesce("root", "bits").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("bits", "component_id")
    return prints.join(named, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
