"""Near-duplicate groups by the exact Jaccard similarity of word-shingle sets.

Candidates come from the Gray-order index over SimHash fingerprints, and from prefixes: with all sets in one order of shingles, rare ones
first, two sets of at least similarity t share one of the first n - ceil(t n) + 1 shingles of each, whatever the order.  Holders of
one such shingle are tested by sketches, which never rule out a pair that is similar enough, and what is left by the sets themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, column, in_batches, joined, larger, mix, pieces, screened, windows, without, written
from .links import components
from .simhash import _UPPER, changes, majority, near_links, runs

#: Documents and bytes of text of a sample, and shingles found in several of them, that say which shingles are common; they change the order of prints alone, not what is found.
COMMON_DOCS, COMMON_BYTES, COMMON = 20_000, 1 << 27, 200_000
#: Bits of a sketch for each shingle, and the least and most bits.
SKETCH, LEAST_BITS, MOST_BITS = 4, 64, 1 << 15
#: Holders of a print that one task tests against each other; where there are more, pivots are tested against all.
GROUP = 2048
#: Pivots grow by this factor from round to round.
PIVOTS = 4
#: Words of sketches that are compared at once.
BLOCK = 1 << 22


#: Bits of a shingle's hash; the rest of a number says whose it is while a slice is sorted.
HASH_BITS = 54
#: Leading bits of a hash by which equally common shingles are counted in slices.
SLICE_BITS = 12


def _sets(text: pa.Array, k: int) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words, and the hashes (``HASH_BITS`` bits) and texts of each text's distinct shingles, in order of both; A-Z are folded.

    A text of fewer words is one shingle; one without words has a shingle of its own kind.
    """
    w = Words(text)
    w.raw = _UPPER[w.raw]
    own = w.hashes()
    h, at = windows(own, w.doc, k)
    doc = w.doc[at]
    few = np.flatnonzero(w.n < k)
    if len(few):
        whole = np.full(len(few), 0x5EED, U64)
        for j in range(k - 1):
            more = np.flatnonzero(w.n[few] > j)
            whole[more] = mix(whole[more] * U64(0xFF51AFD7ED558CCD) + own[w.first[few[more]] + j])
        h, doc = np.concatenate([h, whole]), np.concatenate([doc, few])
    low = U64((1 << HASH_BITS) - 1)
    parts = []
    for lo in range(0, w.docs, 1 << (64 - HASH_BITS)):  # a batch has no more texts than that, as a rule
        some = (doc >= lo) & (doc < lo + (1 << (64 - HASH_BITS))) if w.docs > 1 << (64 - HASH_BITS) else slice(None)
        both = np.sort((doc[some] - lo).astype(U64) << U64(HASH_BITS) | h[some] & low)
        both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
        parts.append((both & low, (both >> U64(HASH_BITS)).astype(np.int64) + lo))
    if not parts:
        return w, np.zeros(0, U64), np.zeros(0, np.int64)
    return w, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _common(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, of shingles that are in several of some documents, and in how many: about ``COMMON_DOCS`` of them to twice that, or fewer long ones."""
    in_batches(docs.sparkSession)
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    step = max(1, n // COMMON_DOCS, (size or 0) // COMMON_BYTES)

    def run(batches):
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array(_sets(column(b, "text"), shingle)[1].view(np.int64))], ["h"])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).select("text").mapInArrow(run, "h long")
    h, n = _most_often(written(some.groupBy("h").count().where("count > 1"), "counted"), COMMON)
    by = np.argsort(h)
    return h[by], n[by]


def _most_often(counted: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """h and count of the ``most`` rows of the greatest counts, of equal counts those of the least h.

    A sort with a limit would have every task send so many rows to the driver.  So rows are numbered by count first, and those of the count that passes the
    limit by slices of h: only what lies before the cut is sent, and the one slice that it runs through.  ``counted`` is read several times: give a written table.
    """
    before, through, left = F.lit(False), F.lit(True), most
    for key in (-F.col("count"), F.shiftright("h", HASH_BITS - SLICE_BITS)):
        sizes = sorted(tuple(r) for r in counted.where(through).groupBy(key.alias("key")).agg(F.count("*")).collect())
        upto = np.cumsum([n for _, n in sizes])
        whole = int(np.searchsorted(upto, left, side="right"))
        if whole == len(sizes):  # there are no more than ``most``
            break
        before, through, left = before | through & (key < sizes[whole][0]), through & (key == sizes[whole][0]), left - int(upto[whole - 1] if whole else 0)
    often = counted.where(before | through).toPandas()
    h, n = often["h"].to_numpy(np.int64).view(U64), often["count"].to_numpy(np.int64)
    by = np.lexsort((h, -n))[:most]
    return h[by], n[by]


def sketch_bits(n: np.ndarray) -> np.ndarray:
    """Bits of the sketch of a set of n: a power of two."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(SKETCH * n, 1))).astype(np.int64), LEAST_BITS, MOST_BITS)


def described(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], shingle: int = 5, similarity: float = 0.8, text: str = "text") -> DataFrame:
    """doc_id, n (distinct shingles), set_a and set_b (equal for equal sets), ``prints``, ``sketch``, and ``bits``, the SimHash of the set.

    The sketch has a bit for each of 2**k slots, set if an odd number of shingles fall into it: two sets differ in at least as many shingles as their
    sketches differ in bits.
    """
    in_batches(docs.sparkSession)
    d = docs.select("doc_id", docs[text].alias("text"))
    key = d.schema["doc_id"].dataType.simpleString()
    known, times = common

    def run(batches):
        for b in pieces(batches):
            w, h, doc = _sets(column(b, "text"), shingle)
            n = np.bincount(doc, minlength=w.docs)
            first = np.concatenate([[0], np.cumsum(n)[:-1]])
            set_a, set_b = np.add.reduceat(mix(h), first), np.add.reduceat(mix(h ^ U64(0xA5A5A5A5)), first)
            count = np.zeros(len(h), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                count = np.where(known[at] == h, times[at], 0)
            by = np.argsort(doc * (count.max(initial=0) + 1) + count, kind="stable")  # h ascends within a text
            size = prefix_size(n, similarity)
            take = by[np.arange(len(h)) - np.repeat(first, n) < np.repeat(size, n)]
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            prints = pa.ListArray.from_arrays(pa.array(ends), pa.array(h[take].view(np.int64)))
            bits = sketch_bits(n)
            base = np.concatenate([[0], np.cumsum(bits)])
            slot = np.repeat(base[:-1], n) + (mix(h) & (np.repeat(bits, n) - 1).astype(U64)).astype(np.int64)
            packed = np.packbits((np.bincount(slot, minlength=base[-1]) & 1).astype(np.uint8), bitorder="little")
            sketch = pa.Array.from_buffers(pa.binary(), w.docs, [None, pa.py_buffer((base // 8).astype(np.int32)), pa.py_buffer(packed)])
            codes = pa.array(majority(mix(h ^ U64(0x5A5A5A5A)), doc, w.docs).view(np.int64))
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(n.astype(np.int64)), pa.array(set_a.view(np.int64)), pa.array(set_b.view(np.int64)), prints, sketch, codes], ["doc_id", "n", "set_a", "set_b", "prints", "sketch", "bits"])

    return d.mapInArrow(run, f"doc_id {key}, n long, set_a long, set_b long, prints array<long>, sketch binary, bits long")


def prefix_size(n: np.ndarray, similarity: float) -> np.ndarray:
    return n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1


def similar(pairs: DataFrame, docs: DataFrame, shingle: int, similarity: float, text: str = "text") -> DataFrame:
    """The pairs (``a``, ``b``: doc_ids) whose shingle sets have at least this Jaccard similarity, exactly.

    Only documents that are in a pair have their texts shuffled and their sets built.  Joins are by merging at any size: pairs and sets grow with the
    table, so a plan that sends them to all tasks would not last.
    """
    named = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    few, _ = screened(docs.select(F.col("doc_id").cast("long").alias("doc_id"), docs[text].alias("text")), named)
    d = few.join(named.hint("merge"), "doc_id", "left_semi")

    def build(batches):
        for b in pieces(batches):
            w, h, doc = _sets(column(b, "text"), shingle)
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=w.docs))]) * 8
            packed = pa.Array.from_buffers(pa.binary(), w.docs, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(h))])
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), packed], ["doc_id", "shingles"])

    # Rows of one doc_id with several texts: one of them, always the same, stands for all.
    sets = written(d.mapInArrow(build, "doc_id long, shingles binary").groupBy("doc_id").agg(F.min("shingles").alias("shingles")), "sets")
    pairs = _likely(pairs, sets, similarity)
    first, second = (sets.select(F.col("doc_id").alias(k), F.col("shingles").alias(v)).hint("merge") for k, v in (("a", "x"), ("b", "y")))
    both = pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y")

    def check(batches):
        for b in batches:
            x, y = column(b, "x").to_pylist(), column(b, "y").to_pylist()
            good = []
            for s, t in zip(x, y, strict=True):
                u, v = np.frombuffer(s, U64), np.frombuffer(t, U64)
                every = np.sort(np.concatenate([u, v]), kind="stable")
                common = int((every[1:] == every[:-1]).sum())
                good.append(common >= similarity * (len(every) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([column(b, "a"), column(b, "b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(check, "a long, b long")


def wide_sketch(h: np.ndarray) -> bytes:
    """The sketch of a set of shingles as in :func:`described`, but of as many bits as the set asks for."""
    bits = max(LEAST_BITS, 1 << int(np.ceil(np.log2(max(SKETCH * len(h), 1)))))
    odd = np.zeros(bits, np.uint8)
    np.bitwise_xor.at(odd, (mix(h) & U64(bits - 1)).astype(np.int64), np.uint8(1))
    return np.packbits(odd, bitorder="little").tobytes()


def _likely(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs but those that wide sketches rule out.

    A sketch of ``MOST_BITS`` says nothing of sets of many more shingles, so all long documents that share a print are pairs, and each would bring both sets with it.
    A wide sketch has a sixteenth to an eighth of a set's bytes.  Only pairs of two such sets are looked at, and no pair that is similar enough is lost.
    """
    large = sets.where(F.octet_length("shingles") > 8 * (MOST_BITS // SKETCH))
    if large.isEmpty():
        return pairs

    def sketched(batches):
        for b in batches:
            rows = [np.frombuffer(x, U64) for x in column(b, "shingles").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array([len(h) for h in rows], pa.int64()), pa.array([wide_sketch(h) for h in rows], pa.binary())], ["doc_id", "n", "sketch"])

    wide = written(large.mapInArrow(sketched, "doc_id long, n long, sketch binary"), "wide")
    first, second = (wide.select(F.col("doc_id").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}")) for k in ("a", "b"))
    # Sizes alone say of many pairs that they can't do: these go before any sketch is joined.
    sized = pairs.join(first.select("a", "n_a").hint("merge"), "a").join(second.select("b", "n_b").hint("merge"), "b")
    unlike = F.least("n_a", "n_b") < similarity * F.greatest("n_a", "n_b") - 1e-9
    both = sized.where(~unlike).join(first.select("a", "s_a").hint("merge"), "a").join(second.select("b", "s_b").hint("merge"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")

    def check(batches):
        for b in batches:
            x, y, n, m = (column(b, c).to_pylist() for c in ("s_a", "s_b", "n_a", "n_b"))
            out = [not may_link(*r, similarity) for r in zip(x, y, n, m, strict=True)]
            yield pa.RecordBatch.from_arrays([column(b, "a"), column(b, "b")], ["a", "b"]).filter(pa.array(out, pa.bool_()))

    out = written(both.mapInArrow(check, "a long, b long").union(sized.where(unlike).select("a", "b")), "unlike")
    return written(pairs.join(out.hint("merge"), ["a", "b"], "left_anti"), "likely")


def _several(batches):
    """Rows, in order of p, of prints with several holders; of a print that goes on in the next batch only the last row waits."""
    held, company = None, False
    for b in larger(batches):
        if held is not None:
            b = joined([held, b])
        p = np.asarray(column(b, "p"))
        same = p[1:] == p[:-1]
        keep = np.append(False, same) | np.append(same, False)
        keep[0] |= company
        held, company = b.slice(b.num_rows - 1), bool(keep[-1])
        keep[-1] = False
        yield b.filter(pa.array(keep))
    if company:
        yield held


def shared_prints(firsts: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Rows (p, rep) of prints that several of ``firsts`` (doc_id, prints) hold; of prints with the same holders one stays, as they give the same pairs.

    Prints that the sample knows to be in very many documents are shared for certain: they are not brought together to find that out.  Holders are told
    apart by their number and 64 bits of hash sums.
    """
    spark = firsts.sparkSession
    spread = firsts.select(F.col("doc_id").alias("rep"), F.explode("prints").alias("p"))
    known, times = common
    hot = known[times > COMMON_DOCS // 100].view(np.int64).tolist()
    sure = None
    if hot:
        listed = F.broadcast(spark.createDataFrame([(h,) for h in hot], "p long"))
        spread, sure = spread.join(listed, "p", "left_anti"), spread.join(listed, "p", "left_semi").select("rep", "p")
    dealt = spread.select("rep", "p").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p").sortWithinPartitions("p")
    several = dealt.mapInArrow(_several, "rep long, p long")
    several = written(several if sure is None else several.union(sure), "several")
    low = F.xxhash64("rep").bitwiseAND(F.lit(0xFFFFFFFF))
    held = several.groupBy("p").agg(F.count("*").alias("c"), F.sum(low).alias("s"), F.sum(F.shiftrightunsigned(F.xxhash64("rep"), 32)).alias("t"))
    one = held.groupBy("c", "s", "t").agg(F.min("p").alias("p")).select("p")
    return written(several.join(one.hint("merge"), "p").select("p", "rep"), "live")


def may_link(x: bytes, y: bytes, n: int, m: int, similarity: float) -> bool:
    """Whether sets of n and m with these sketches may be similar enough."""
    if min(n, m) < similarity * max(n, m) - 1e-9:
        return False
    u, v = sorted((np.frombuffer(x, U64), np.frombuffer(y, U64)), key=len)
    while len(v) > len(u):
        v = v[: len(v) // 2] ^ v[len(v) // 2 :]
    return int(np.bitwise_count(u ^ v).sum()) <= differing(n + m, similarity)


def differing(total, similarity: float):
    """How many shingles two sets of ``total`` together may differ in."""
    return total * (1 - similarity) / (1 + similarity) + 1e-6


def near_matrix(sketch: list[bytes], n: np.ndarray, root: np.ndarray, similarity: float) -> np.ndarray:
    """Which of some sets may be similar enough and aren't connected yet: a symmetric table."""
    words = np.array([len(s) // 8 for s in sketch])
    near = np.zeros((len(n), len(n)), bool)
    tables = {w: (np.flatnonzero(words == w), np.frombuffer(b"".join(s for s in sketch if len(s) == 8 * w), U64).reshape(-1, w)) for w in np.unique(words).tolist()}
    for w, (at, own) in tables.items():
        others = [(at, own)]
        if 2 * w in tables:  # sets that differ more in size can't be similar enough
            more, wide = tables[2 * w]
            others.append((more, wide[:, :w] ^ wide[:, w:]))
        for to, table in others:
            step = max(1, BLOCK // (w * len(to)))
            for lo in range(0, len(at), step):
                rows = at[lo : lo + step]
                apart = np.bitwise_count(own[lo : lo + step, None, :] ^ table[None, :, :]).sum(axis=2, dtype=np.int64)
                near[np.ix_(rows, to)] = apart <= differing(n[rows][:, None] + n[to][None, :], similarity)
    near |= near.T
    small, large = np.minimum(n[:, None], n[None, :]), np.maximum(n[:, None], n[None, :])
    return near & (small >= similarity * large - 1e-9) & (root[:, None] != root[None, :])


def pivot_pairs(near: np.ndarray, passes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs to test of a symmetric table: those of pivots, which in each pass are chosen until every row is or neighbours one; and the rows that are left with pairs."""
    near = near.copy()
    left, right = [], []
    for _ in range(passes):
        degree = near.sum(axis=1)
        while True:
            v = int(np.argmax(degree))
            if degree[v] <= 0:
                break
            to = np.flatnonzero(near[v])
            left.append(np.full(len(to), v))
            right.append(to)
            near[v, :] = near[:, v] = False
            degree[to] = degree[v] = 0
        if not near.any():
            break
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none), np.flatnonzero(near.any(axis=1))


def _tested(groups: DataFrame, passes: int, similarity: float) -> DataFrame:
    """Of rows (p, rep, n, sketch, root): pairs to test (``kind`` 0: a, b), and rows of p that are not done yet (``kind`` 1: p, a)."""
    spark = groups.sparkSession

    def run(batches):
        for b in runs(larger(batches, 1 << 12), ["p"]):
            p, rep, n, root = (np.asarray(column(b, c)) for c in ("p", "rep", "n", "root"))
            sketch = column(b, "sketch").to_pylist()
            edge = [*changes(b, ["p"]), len(p)]
            out: list[list[np.ndarray]] = [[], [], [], []]
            for lo, hi in zip(edge, edge[1:], strict=False):
                if hi - lo == 2:
                    if root[lo] != root[lo + 1] and may_link(sketch[lo], sketch[lo + 1], int(n[lo]), int(n[lo + 1]), similarity):
                        _put(out, 0, p[lo : lo + 1], rep[lo : lo + 1], rep[lo + 1 : hi])
                elif hi - lo > 2:
                    x, y, rest = pivot_pairs(near_matrix(sketch[lo:hi], n[lo:hi], root[lo:hi], similarity), passes)
                    _put(out, 0, np.full(len(x), p[lo]), rep[lo + x], rep[lo + y])
                    _put(out, 1, np.full(len(rest), p[lo]), rep[lo + rest], rep[lo + rest])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["kind", "p", "a", "b"])

    dealt = groups.select("p", "rep", "n", "root", "sketch").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p").sortWithinPartitions("p", "rep")
    return dealt.mapInArrow(run, "kind int, p long, a long, b long")


def _put(out: list[list[np.ndarray]], kind: int, *columns: np.ndarray) -> None:
    for to, c in zip(out, (np.full(len(columns[0]), kind, np.int32), *columns), strict=True):
        to.append(c)


def _round(live: DataFrame, sets: DataFrame, roots: DataFrame | None, pivots: int, similarity: float, group: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) to test now, and the rows of ``live`` (p, rep) that are left for later rounds.

    Prints whose holders are all connected are done.  Up to ``group`` holders of a print are tested against each other by their sketches in one task, which
    hands out the pairs of some pivots.  Of a print with more holders ``pivots``, those of the largest components first, are compared with all others.
    A pivot then leaves the print, as nothing in it is untested against it.
    """
    if roots is None:  # every holder stands alone
        rows = live.withColumn("root", F.col("rep")).withColumn("size", F.lit(1).cast("long"))
    else:
        sized = roots.join(roots.groupBy("root").agg(F.count("*").alias("size")), "root").select(F.col("node").alias("rep"), "root", "size")
        rows = live.join(sized.hint("merge"), "rep", "left").select("p", "rep", F.coalesce("root", "rep").alias("root"), F.coalesce("size", F.lit(1)).alias("size"))
        rows = written(rows, "rooted")
    open_prints = rows.groupBy("p").agg(F.count("*").alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("p", "c")
    rows = rows.join(open_prints.hint("merge"), "p").join(sets.hint("merge"), "rep")
    rows = written(rows.select("p", "rep", "root", "size", "c", "n", "sketch"), "holders")
    tested = written(_tested(rows.where(F.col("c") <= group), pivots, similarity), "tested")
    near = tested.where("kind = 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = tested.where("kind = 1").select("p", F.col("a").alias("rep"))
    large = rows.where(F.col("c") > group)
    if not large.isEmpty():
        salt = F.pmod(F.xxhash64("rep"), F.lit(pivots))
        best = large.groupBy("p", salt.alias("salt")).agg(F.max(F.struct("size", (-F.col("rep")).alias("least"), "rep", "n", "root", "sketch")).alias("m"))
        chosen = written(best.select("p", *[F.col(f"m.{c}").alias(f"m_{c}") for c in ("rep", "n", "root", "sketch")]), "pivots")
        fits = F.least("n", "m_n") >= similarity * F.greatest("n", "m_n") - 1e-9
        both = large.join(chosen.hint("merge"), "p").where((F.col("root") != F.col("m_root")) & fits).select("rep", "m_rep", "n", "m_n", "sketch", "m_sketch")

        def check(batches):
            for b in batches:
                x, y, n, m = (column(b, c).to_pylist() for c in ("sketch", "m_sketch", "n", "m_n"))
                good = [may_link(*r, similarity) for r in zip(x, y, n, m, strict=True)]
                yield pa.RecordBatch.from_arrays([column(b, "rep"), column(b, "m_rep")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

        near = near.union(both.mapInArrow(check, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        rest = rest.union(large.join(chosen.select("p", F.col("m_rep").alias("rep")).hint("merge"), ["p", "rep"], "left_anti").select("p", "rep"))
    return near.distinct(), rest


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, most: int = 2, text: str = "text", group: int = GROUP) -> DataFrame:
    """doc_id and group_id, the smallest doc_id of those that links of at least ``similarity`` connect; rows without doc_id are left out.

    Candidates are fingerprints that the Gray-order index links at ``most`` bits, and documents that share a print of :func:`described`, as
    every pair that should link does.  The index's links only span its components, and equal fingerprints are compared with the least document's: pairs
    that these leave out and that should link meet in a print.  Rounds of :func:`_round` go on until every two holders of a print are tested or connected.  A pair
    links if the exact Jaccard similarity of its shingle sets suffices.  Equal sets link without a comparison, and one document stands for each.
    Null and empty texts have one set of their own.  An empty table gives no rows.
    """
    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), docs[text].alias("text"))
    common = _common(named, shingle)
    rows = written(described(named, common, shingle, similarity), "described")
    equal = ["set_a", "set_b"]
    classes = written(rows.groupBy(*equal).agg(F.min("doc_id").alias("rep")), "classes")
    reps = written(rows.select("doc_id", "bits", *equal).join(classes.hint("merge"), equal).select("doc_id", "rep", "bits"), "reps")
    late = written(reps.where("doc_id != rep").select("doc_id").distinct().join(classes.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_anti"), "late")
    firsts = without(rows, late)
    live = shared_prints(firsts.select("doc_id", "prints"), common)
    sets = firsts.select(F.col("doc_id").alias("rep"), "n", "sketch").groupBy("rep").agg(F.min(F.struct("n", "sketch")).alias("s")).select("rep", "s.n", "s.sketch")
    near, live = _round(live, sets, None, 1, similarity, group)
    if most:
        # A fingerprint is known by its least document; those of other sets with the same one are compared with it.
        codes = written(reps.groupBy("bits").agg(F.min("rep").alias("least")), "codes")
        links = near_links(codes, most)
        ends = links.join(codes.select(F.col("bits").alias("a"), F.col("least").alias("u")), "a").join(codes.select(F.col("bits").alias("b"), F.col("least").alias("v")), "b")
        alike = reps.select("bits", "rep").distinct().join(codes, "bits").where("rep != least")
        near = near.union(ends.where("u != v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))).union(alike.select(F.least("least", "rep").alias("a"), F.greatest("least", "rep").alias("b")))
    pairs = tested = written(near.distinct(), "pairs")
    roots, pivots = None, 1
    while True:
        if roots is None or not pairs.isEmpty():
            links = similar(pairs, named, shingle, similarity)
            roots = components(links if roots is None else links.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        if live.isEmpty():
            break
        pivots *= PIVOTS
        near, live = _round(live, sets, roots, pivots, similarity, group)
        pairs = written(near.join(tested.hint("merge"), ["a", "b"], "left_anti"), "pairs")
        tested = tested.union(pairs)
    found = reps.join(roots.select(F.col("node").alias("rep"), "root").hint("merge"), "rep", "left")
    return found.select("doc_id", F.coalesce("root", "rep").alias("group_id"))


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, text: str = "text") -> DataFrame:
    """The rows of ``docs`` but those in the group of a smaller doc_id; all columns stay.

    Groups are those of :func:`similar_groups`.  Of several rows of one doc_id the one with the least text stays.  Rows without doc_id can't be
    named, so they stay.
    """
    groups = written(similar_groups(docs, shingle, similarity, text=text), "groups")
    late = written(groups.where("doc_id != group_id").select("doc_id").distinct(), "late")
    left = without(docs, late)
    n, ids = groups.agg(F.count("*"), F.countDistinct("doc_id")).first()
    if n == ids:
        return left
    least = left.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(text, *[c for c in docs.columns if c not in (text, "doc_id")])).alias("r"))
    single = least.select(*[F.col("doc_id") if c == "doc_id" else F.col(f"r.`{c}`").alias(c) for c in docs.columns])
    return single.union(left.where("doc_id is null"))
