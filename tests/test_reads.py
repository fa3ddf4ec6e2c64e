import random

import pytest

from chronokv.operators import batches, compaction, reads

SCHEMA = "key string, seq long, vt int, value string"


def random_log(n, n_keys, seed):
    r = random.Random(seed)
    return [(f"k{r.randrange(n_keys):03d}", i + 1, int(r.random() > 0.3), f"v{i}") for i in range(n)]


def model(rows, snapshot=None):
    """Replay: key -> (seq, vt, value) of the newest version."""
    out = {}
    for k, s, vt, v in rows:
        if snapshot is None or s <= snapshot:
            out[k] = (s, vt, v)
    return out


@pytest.fixture(scope="module")
def rows():
    return [(k, s, vt, v if vt else None) for k, s, vt, v in random_log(600, 25, 301)]


@pytest.mark.parametrize("snapshot", [None, 0, 1, 77, 599])
def test_latest(spark, rows, snapshot):
    log = spark.createDataFrame(rows, SCHEMA)
    want = {k: v for k, (_, vt, v) in model(rows, snapshot).items() if vt}
    assert {r.key: r.value for r in reads.latest(log, snapshot).collect()} == want
    assert {r.key: r.value for r in reads.latest_by_window(log, snapshot).collect()} == want
    assert [r.key for r in reads.scan(log, snapshot=snapshot).collect()] == sorted(want)
    assert [r.key for r in reads.scan(log, "k005", "k015", snapshot, reverse=True).collect()] == sorted((k for k in want if "k005" <= k < "k015"), reverse=True)


@pytest.mark.parametrize("bucket", [10, 1 << 20])
def test_multi_get(spark, rows, bucket):
    log = spark.createDataFrame(rows, SCHEMA)
    probes = [(i, f"k{i % 30:03d}", None if i % 7 == 0 else i * 13 % 700) for i in range(200)]
    got = reads.multi_get(log, spark.createDataFrame(probes, "probe_id long, key string, snapshot_seq long"), bucket).collect()
    assert len(got) == len(probes)
    for r in got:
        hit = model(rows, r.snapshot_seq).get(r.key)
        assert (r.seq, r.vt, r.value) == (hit or (None, None, None)), r
        assert r.status == ("missing" if hit is None else "found" if hit[1] else "deleted")


@pytest.mark.parametrize("bucket", [7, 1 << 20])
def test_history(spark, rows, bucket):
    got = {(r.key, r.seq): r.next_seq for r in reads.history(spark.createDataFrame(rows, SCHEMA), bucket).collect()}
    last = {}
    for k, s, _, _ in reversed(rows):
        assert got[k, s] == last.get(k)
        last[k] = s


def test_seeks(spark, rows):
    state = reads.latest(spark.createDataFrame(rows, SCHEMA))
    keys = sorted(r.key for r in state.collect())
    targets = ["", "k", "k0045", *keys[::5], "k024", "zzz"]
    for how, want in (("ge", lambda t: min((k for k in keys if k >= t), default=None)), ("lt", lambda t: max((k for k in keys if k < t), default=None))):
        got = {r.target: r.found for r in reads.seek_many(state, spark.createDataFrame([(t,) for t in targets], "target string"), how).collect()}
        assert got == {t: want(t) for t in targets}
        for t in targets[::4]:
            assert [r.key for r in reads.seek(state, t, how).collect()] == [k for k in [want(t)] if k]
    assert [reads.seek(state, None, how).first().key for how in ("first", "last")] == [keys[0], keys[-1]]
    empty = state.limit(0)
    assert reads.seek(empty, "", "ge").count() == 0 == reads.seek(empty, None, "last").count()


def test_a_filter_on_values_does_not_revive_old_versions(spark):
    log = spark.createDataFrame([("a", 1, 1, "old"), ("a", 2, 0, None), ("b", 3, 1, ""), ("", 4, 1, "x")], SCHEMA)
    got = {r.key: r.value for r in reads.latest(log).where("value is not null").collect()}
    assert got == {"b": "", "": "x"}
    assert reads.get(log, "a").count() == 0 and reads.get(log, "a", 1).first().value == "old"


@pytest.mark.parametrize("snapshots", [[], [50], [100, 300, 599]])
def test_merge_keeps_what_readers_see(spark, rows, snapshots):
    log = spark.createDataFrame(rows, SCHEMA)
    merged = compaction.merge([log.where("seq % 3 = 0"), log.where("seq % 3 > 0")], snapshots)
    left = [tuple(r) for r in merged.select("key", "seq", "vt", "value").orderBy("seq").collect()]
    for s in [*snapshots, None]:
        assert {k: x for k, x in model(left, s).items() if x[1]} == {k: x for k, x in model(rows, s).items() if x[1]}
    if not snapshots:
        assert len(left) == sum(vt for _, vt, _ in model(rows).values())


def test_layers(spark):
    frames = [spark.createDataFrame(x, SCHEMA) for x in ([("a", 9, 0, None)], [("a", 5, 1, "x"), ("b", 6, 1, "y")], [("b", 1, 1, "z"), ("c", 2, 1, "w")])]
    got = {r.key: (r.layer, r.vt, r.value) for r in reads.layered_get(frames, spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "key string")).collect()}
    assert got == {"a": (0, 0, None), "b": (1, 1, "y"), "c": (2, 1, "w")}


def test_batches(spark):
    data = [(3, [(1, "a", "1"), (0, "b", None)]), (1, [(1, "c", "")]), (2, [])]
    frame = spark.createDataFrame(data, "batch_id long, ops array<struct<vt:int,key:string,value:string>>")
    assert sorted(tuple(r) for r in batches.to_log(frame, 10).select("seq", "key", "vt", "value").collect()) == [(11, "c", 1, ""), (12, "a", 1, "1"), (13, "b", 0, None)]
    many = spark.createDataFrame([(i, i % 4) for i in range(50)], "batch_id long, n_ops long")
    want, at = {}, 1
    for i in range(50):
        want[i] = at
        at += i % 4
    assert {r.batch_id: r.first_seq for r in batches.sequence_batches(many, group=7).collect()} == want


def test_many_probes_ask_the_same(spark):
    log = spark.createDataFrame([(b"a", 1, 1, b"x"), (b"a", 5, 0, None), (b"b", 3, 1, b"y")], "key binary, seq long, vt byte, value binary")
    probes = spark.createDataFrame([(i, b"a", 4) for i in range(50)] + [(100, b"a", None), (101, b"b", 2), (102, b"b", 9), (103, None, 3)], "probe_id long, key binary, snapshot_seq long")
    for bucket in (2, 1 << 20):
        for newest in (None, 5):
            got = {r.probe_id: (r.status, r.seq) for r in reads.multi_get(log, probes, bucket, newest).collect()}
            assert got == {i: ("found", 1) for i in range(50)} | {100: ("deleted", 5), 101: ("missing", None), 102: ("found", 3), 103: ("missing", None)}


def test_seeks_of_bytes(spark):
    state = spark.createDataFrame([(bytes([c]),) for c in (1, 0x80, 0xFE)], "key binary")
    targets = spark.createDataFrame([(bytes([c]),) for c in (0, 0x80, 0x81, 0xFE, 0xFF)], "target binary")
    for how, want in (("ge", [1, 0x80, 0xFE, 0xFE, None]), ("lt", [None, 1, 0x80, 0x80, 0xFE])):
        got = sorted((bytes(r.target), None if r.found is None else bytes(r.found)) for r in reads.seek_many(state, targets, how).collect())
        assert got == [(bytes([t]), None if w is None else bytes([w])) for t, w in zip((0, 0x80, 0x81, 0xFE, 0xFF), want, strict=True)]


@pytest.mark.parametrize("how", ["ge", "lt"])
@pytest.mark.parametrize("kind", ["string", "binary"])
def test_seeks_do_not_go_through_the_rest_of_a_part_for_each_row(spark, how, kind):
    """A frame up to a part's end is gone through anew for each row: the square of a part's rows."""
    state, targets = (spark.range(50).selectExpr(f"cast(cast(id * {n} as string) as {kind}) as {c}") for n, c in ((2, "key"), (3, "target")))
    found = reads.seek_many(state, targets, how)
    plan = found._jdf.queryExecution().executedPlan().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan
    keys = sorted(str(i * 2) for i in range(50))
    want = {t: min((k for k in keys if k >= t), default=None) if how == "ge" else max((k for k in keys if k < t), default=None) for t in (str(i * 3) for i in range(50))}
    assert {r.target: r.found for r in found.selectExpr("cast(target as string) target", "cast(found as string) found").collect()} == want
