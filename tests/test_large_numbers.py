"""Queries over byte formats where sequence numbers are so large that a long can't hold what is coded."""

import struct

import pytest

from chronokv.functions import codec
from chronokv.plans import catalog

SEQS = [1, 7, 209_715, 209_716, 264_224, 264_225, 600_000, 3_036_995, 3_036_996, 4_294_960, 4_294_961, 36_000_000]


@pytest.fixture(scope="module")
def d(spark, tmp_path_factory):
    to = tmp_path_factory.mktemp("large")
    rows = [(s - 1, s % 1500, "error" if i % 3 == 0 else "view", "{}") for i, s in enumerate(SEQS)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string").write.parquet(f"{to}/events.parquet")
    return str(to)


def test_varint_len(spark, d):
    got = {r.seq: r.n for r in catalog.varint_len(spark, d).collect()}
    assert got == {s: -(-(s**3 * 1000).bit_length() // 7) for s in SEQS}


def test_varint_bytes(spark, d):
    got = {r.seq: r for r in catalog.varint_bytes(spark, d).collect()}
    assert sorted(got) == SEQS
    for s, r in got.items():
        v, raw = s**3 * 1000, bytes.fromhex(r.coded)
        assert sum((b & 127) << 7 * i for i, b in enumerate(raw)) == v and [b > 127 for b in raw] == [True] * (r.n - 1) + [False]
        assert r.decoded == (v if v < 1 << 63 else None)


def test_fixed_bytes(spark, d):
    got = {r.seq: r for r in catalog.fixed_bytes(spark, d).collect()}
    assert sorted(got) == SEQS
    for s, r in got.items():
        a, b = s * 40503 % (1 << 32), s * s * 1000003
        assert (r.a, r.fixed32) == (a, struct.pack("<I", a).hex())
        assert (r.b, r.fixed64) == (b if b < 1 << 63 else None, struct.pack("<Q", b).hex() if b < 1 << 64 else None)


def test_readers_of_varints_keep_to_their_bits():
    for bits in (32, 64):
        assert codec.get_varint(codec.put_varint((1 << bits) - 1), bits=bits)[0] == (1 << bits) - 1
        with pytest.raises(codec.Corruption):
            codec.get_varint(codec.put_varint(1 << bits), bits=bits)
