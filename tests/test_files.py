import random

import pytest
from pyspark.sql import functions as F

from chronokv.functions import keys
from chronokv.operators import manifest, runs
from chronokv.operators.compaction import File, Plan, Planner

SCHEMA = "level int, number long, file_size long, lo string, hi string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def file(number, low, high, size=100, seqs=(100, 100)):
    return File(number, size, (low.encode(), seqs[0], 1), (high.encode(), seqs[1], 1))


def test_find_file(spark):
    f = frame(spark, [(1, 1, 10, "p", "q")])
    got = {r.key: (r.number, r.inside) for r in manifest.find_file(f, spark.createDataFrame([(k,) for k in ("a", "p", "p1", "q", "q1", "z")], "key string")).collect()}
    assert got == {"a": (1, False), "p": (1, True), "p1": (1, True), "q": (1, True), "q1": (None, None), "z": (None, None)}
    p = Planner([[], [file(1, "p", "q")]])
    assert [p.find_file(1, k) for k in (b"a", b"p", b"p1", b"q", b"q1", b"z")] == [0, 0, 0, 0, 1, 1]
    assert Planner([[]]).find_file(0, b"foo") == 0
    for low, high, hit in (("a", "b", 0), ("z1", "z2", 0), ("a", "p", 1), (None, None, 1), (None, "o", 0), ("q", None, 1), ("q1", None, 0)):
        n = f.where(manifest.overlaps(F.lit(low), F.lit(high))).count()
        assert n == hit == len(p.overlapping(1, low and low.encode(), high and high.encode()))


@pytest.mark.parametrize("seed", range(4))
def test_closure_is_the_fixed_point(spark, seed):
    r = random.Random(seed)
    spans = [sorted(r.sample(range(60), 2)) for _ in range(14)]
    rows = [(0, i, 1, f"{a:02d}", f"{b if r.random() > 0.4 else a:02d}") for i, (a, b) in enumerate(spans)]
    p = Planner([[file(n, lo, hi) for _, n, _, lo, hi in rows]])
    got = {x.number for x in manifest.overlap_closure(frame(spark, rows), "20", "25").collect()}
    assert got == {x.number for x in p.overlapping(0, b"20", b"25")}


def test_boundary_files():
    f1 = File(1, 1, (b"100", 3, 1), (b"100", 2, 1))
    f2 = File(2, 1, (b"100", 1, 1), (b"200", 3, 1))
    f3 = File(3, 1, (b"300", 2, 1), (b"300", 1, 1))
    assert [f.number for f in Planner([[], [f3, f2, f1]]).with_boundary(1, [f1])] == [1, 2]
    apart = [File(i, 1, (b"%d00" % i, 2, 1), (b"%d00" % i, 1, 1)) for i in (1, 2, 3)]
    assert [f.number for f in Planner([[], apart]).with_boundary(1, apart[1:])] == [2, 3]
    assert Planner([[]]).with_boundary(0, []) == []


def test_planner():
    mb = 1 << 20
    p = Planner([[file(i, "a", "m") for i in range(4)], [file(10, "b", "c", 5 * mb), file(11, "x", "z", mb)], [file(20, "a", "d", 2 * mb)]])
    plan = p.pick()
    assert plan.level == 0 and len(plan.inputs) == 4 and [f.number for f in plan.below] == [10] and [f.number for f in plan.grandparents] == [20]
    assert not plan.trivial(2 * mb) and not p.bottom(Plan(0, plan.inputs)) and p.bottom(Plan(1, p.levels[1]))
    assert Planner([[file(1, "a", "b")]]).pick() is None
    full = Planner([[], [file(1, "a", "b", 6 * mb), file(2, "c", "d", 6 * mb)]], {1: (b"b", 100, 1)})
    assert [f.number for f in full.pick().inputs] == [2] and [f.number for f in full.pick().inputs] == [1]
    assert full.pick().trivial(2 * mb)
    assert [p.flush_level(*k) for k in ((b"a", b"b"), (b"n", b"o"), (b"w", b"y"))] == [0, 2, 0]
    deep = Planner([[], [], [file(1, "a", "b", 30 * mb)]])
    assert (deep.flush_level(b"a", b"b"), deep.flush_level(b"c", b"d")) == (0, 2)
    assert [f.number for f in Planner([[], [file(i, f"{i}", f"{i}", 3 * mb) for i in range(5)]]).compact_range(1, None, None).inputs] == [0]


def test_scores_edits_and_obsolete_files(spark):
    f = frame(spark, [(0, 1, 5, "a", "b"), (0, 2, 5, "a", "b"), (1, 3, 21 << 20, "a", "c"), (1, 4, 1, "d", "e"), (1, 5, 1, "e", "f")])
    assert {r.level: (r.score_milli, r.needs_compaction) for r in manifest.level_scores(f).collect()} == {0: (500, False), 1: (2100, True)}
    assert manifest.compaction_level(f).first().level == 1
    assert tuple(manifest.overlap_violations(f).first()) == (3, 1)
    added = frame(spark, [(1, 3, 7, "a", "b"), (2, 9, 1, "x", "y")])
    after = manifest.apply_edit(f, added, frame(spark, [(1, 3, 0, "", ""), (0, 2, 0, "", "")]))
    assert sorted((r.level, r.number, r.file_size) for r in after.collect()) == [(0, 1, 5), (1, 3, 7), (1, 4, 1), (1, 5, 1), (2, 9, 1)]
    paths = ["d/000001.ldb", "d/000002.ldb", "d/000007.log", "d/000003.log", "d/000004.log", "d/MANIFEST-000002", "d/MANIFEST-000005", "d/CURRENT", "d/LOCK", "d/foo", "d/000077.dbtmp"]
    gone = manifest.obsolete(spark.createDataFrame([(p,) for p in paths], "path string"), manifest.live_files(after), 5, 4, 5)
    assert sorted(r.path for r in gone.collect()) == ["d/000002.ldb", "d/000003.log", "d/000077.dbtmp", "d/MANIFEST-000002"]


def test_file_names(spark):
    names = {"100.log": (100, "LOG"), "0.log": (0, "LOG"), "0.sst": (0, "TABLE"), "0.ldb": (0, "TABLE"), "CURRENT": (0, "CURRENT"), "LOCK": (0, "LOCK"), "MANIFEST-2": (2, "MANIFEST"), "LOG": (0, "INFO_LOG"), "18446744.dbtmp": (18446744, "TEMP")}
    names |= {n: (None, None) for n in ("", "foo", "foo-dx-100.log", ".log", "manifest", "CURREN", "MANIFES", "MANIFEST", "MANIFEST-", "XMANIFEST-3", "100.lop", "x100.log")}
    got = spark.createDataFrame([(n,) for n in names], "p string").select("p", keys.file_number(F.col("p")).alias("n"), keys.file_type(F.col("p")).alias("t")).collect()
    assert {r.p: (r.n, r.t) for r in got} == names


def plain_separator(a, b):
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    if n < min(len(a), len(b)) and a[n] < 255 and a[n] + 1 < b[n]:
        return n, a[:n] + bytes([a[n] + 1])
    return n, a


def plain_successor(a):
    n = next((i for i, x in enumerate(a) if x != 255), None)
    return a if n is None else a[:n] + bytes([a[n] + 1])


def test_separators(spark):
    r = random.Random(6)
    some = lambda: bytes(r.choices([0, 1, 15, 127, 128, 200, 254, 255], k=r.randrange(6)))
    rows = [(b"abc", b"abf"), (b"abc", b"abd"), (b"ab", b"abc"), (b"", b"a"), (b"abcdef", b"abx"), (b"\xff\xff", b"\xff\xff\x00"), ("é".encode(), "ü".encode())] + [tuple(sorted((some(), some()))) for _ in range(200)]
    columns = keys.shortest_separator(F.col("a"), F.col("b")).alias("g"), keys.short_successor(F.col("a")).alias("n"), keys.shared_prefix(F.col("a"), F.col("b")).alias("k")
    for x in spark.createDataFrame(rows, "a binary, b binary").select("a", "b", *columns).collect():
        a, b, g, n = (bytes(c) for c in (x.a, x.b, x.g, x.n))
        assert (x.k, g) == plain_separator(a, b) and n == plain_successor(a)
        assert a <= g and (g < b or a == b) and n >= a
    x = spark.createDataFrame([("naïve", "naöve")], "a string, b string").select(*columns).first()
    assert (x.k, bytes(x.g)) == plain_separator("naïve".encode(), "naöve".encode())


def test_runs_of_binary_keys(spark):
    r = random.Random(11)
    want = sorted({bytes(r.choices([0, 1, 10, 11, 12, 13, 14, 15, 128, 255], k=r.randrange(1, 7))) for _ in range(400)})
    run = runs.sorted_run(spark.createDataFrame([(k, bytes(len(k))) for k in want], "key binary, value binary"), file_entries=90)
    rows = run.orderBy("pos").collect()
    assert [bytes(x.key) for x in rows] == want
    for i, x in enumerate(rows):
        shared = 0 if x.restart else plain_separator(want[i - 1], want[i])[0]
        assert x.shared == shared and x.entry_bytes == 3 + 2 * len(want[i]) - shared
    assert all(x.key == x.rebuilt for x in runs.restored(run).collect())
    index = runs.block_index(runs.cut_blocks(run, 100)).orderBy("file_no", "block_no").collect()
    for x, y in zip(index, index[1:], strict=False):
        last, following = bytes(x.last_key), bytes(y.first_key)
        assert bytes(x.separator) == (plain_separator(last, following)[1] if x.file_no == y.file_no else last)
    probes = [bytes([c]) for c in (0, 0x80, 0xFE, 0xFF)] + want[::37]
    found = {bytes(x.key): x for x in runs.lookup(runs.block_index(runs.cut_blocks(run, 100)), spark.createDataFrame([(k,) for k in probes], "key binary")).collect()}
    for k in probes:
        hit = next((x for x in index if bytes(x.last_key) >= k), None)
        assert (found[k].file_no, found[k].block_no) == ((hit.file_no, hit.block_no) if hit else (None, None))


def test_boundaries_as_the_planner_finds_them(spark):
    r = random.Random(13)
    entries = sorted({(b"%02d" % r.randrange(12), -r.randrange(1000)) for _ in range(120)})
    cuts = sorted(r.sample(range(1, len(entries)), 40))
    parts = [entries[a:b] for a, b in zip([0, *cuts], [*cuts, len(entries)], strict=True)]
    files = [File(i, 1, (p[0][0], -p[0][1], 1), (p[-1][0], -p[-1][1], 1)) for i, p in enumerate(parts)]
    planner = Planner([[], files])
    rows = [(f.number, f.smallest[0], f.largest[0], f.smallest[1]) for f in files]
    for x in manifest.boundary_closure(spark.createDataFrame(rows, "number long, lo binary, hi binary, lo_seq long")).collect():
        closed = planner.with_boundary(1, [files[x.number]])
        assert (x.n_files, x.last_number) == (len(closed), max(f.number for f in closed))


def test_runs_rebuild_and_look_up(spark):
    r = random.Random(5)
    want = sorted({"".join(r.choices("abc", k=r.randrange(1, 12))) for _ in range(500)})
    run = runs.sorted_run(spark.createDataFrame([(k, "v" * (len(k) % 5)) for k in want], "key string, value string"), file_entries=90)
    rows = run.orderBy("pos").collect()
    assert [x.key for x in rows] == want and [x.pos for x in rows] == list(range(1, len(want) + 1))
    assert tuple(runs.order_violations(run).first()) == (len(want), 0)
    back = runs.restored(run).collect()
    assert len(back) == len(want) and all(x.key == x.rebuilt for x in back)
    blocks = runs.cut_blocks(run, 100)
    index = runs.block_index(blocks)
    used = {}
    for x in blocks.orderBy("pos").collect():
        size = used.get((x.file_no, x.block_no), 0)
        assert size < 100
        used[x.file_no, x.block_no] = size + x.entry_bytes
    place = {x.key: (x.file_no, x.block_no) for x in blocks.collect()}
    got = runs.lookup(index, spark.createDataFrame([(k,) for k in [*want[::7], "zzz", ""]], "key string")).collect()
    for x in got:
        assert (x.file_no, x.block_no) == (place[x.key] if x.key in place else (None, None) if x.key == "zzz" else place[want[0]])
