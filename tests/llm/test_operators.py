"""Each operator against a plain version of itself on small tables full of odd cases."""

import collections
import hashlib
import itertools
import random
import re
import subprocess
import sys
import textwrap
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronokv.llm import bpe, cotrain, licenses, media, nearsets, packing, quality, registry, sharding, simhash, substrings, wordpiece
from chronokv.llm.common import BASE, PRIME, Words, filled, gapless, mix, windows, written, xxh64
from chronokv.llm.links import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, _hashes string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = " ".join(f"passage{i}" for i in range(30))
LICENCE = "Intro line here.\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License. More text"


def texts():
    r = random.Random(3)
    words = ["alpha", "beta", "Gamma", "delta", "naïve", "日本", "x", "the", "of", "a#b", "ÉTÉ", "Σίσυφος", "ΟΔΟΣ", "don't", "1234", "🙂🙂"]
    plain = [" ".join(r.choices(words, k=r.randrange(1, 60))) for _ in range(25)]
    near = plain[3] + " one more"
    odd = [None, "", " \t\n\x0b\x0c\r ", "one", "a b", "a b c d e a b c d e\nx y\nx y\nx y\n", "é" * 70, "z" * 5000, PASSAGE, "start " + PASSAGE + " end", PASSAGE.upper(), plain[3], near, plain[3].upper()]
    odd += ["bar | " * 30, "word### " * 20, "tail <|endoftext|> and  <|startoftext|>", "a\x00b \x1c c\xa0d e  f", "\n\n\n", LICENCE, "long " * 4000, "-" * 64, "x" * 128, "é İ ǅ ß"]
    return plain + odd


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, None if i % 5 == 0 else "en", f"src{i % 3}" if i % 4 else None, None if i % 6 == 0 else len(t or ""), "clash", None) for i, t in enumerate(texts())]
    n = len(out)
    return [*out, (None, PASSAGE, "en", "s", 3, "clash", "x"), (None, None, None, None, None, None, None), out[30], out[3], (n + 5, PASSAGE, "en", "s", 1, "c", "y")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return written(spark.createDataFrame(rows, SCHEMA).repartition(3), "docs")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(r):
    return tuple((x is not None, str(x)) for x in r)


def same(df, want):
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(want, key=key)


# Quality rules


def base_counts(t):
    t = t or ""
    w = WORD.findall(t)
    lines, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeat = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(repeat), len(w) < 10 or 100 * len(repeat) > 20 * len(w)


def test_quality_counts(docs, rows, empty):
    field = quality.LineField.neutral()
    got = quality.judged(docs, field)
    same(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"), [(r[0], *(c := base_counts(r[1])), not c[-1]) for r in rows])
    assert quality.judged(empty, field).count() == 0
    kept = quality.keep(docs, field)
    assert kept.columns == docs.columns and kept.count() == sum(not base_counts(r[1])[-1] for r in rows)


def test_viterbi_finds_the_best_sequence():
    r = np.random.default_rng(0)
    sizes = r.integers(0, 7, 40)
    x = r.normal(size=(sizes.sum(), quality.FEATURES)).astype(np.float32)
    field = quality.LineField(r.normal(size=(quality.FEATURES, 2)), r.normal(size=(2, 2)), r.normal(size=2))
    got = field.decode(x, sizes)
    for part, label in zip(np.split(x, np.cumsum(sizes)[:-1]), np.split(got, np.cumsum(sizes)[:-1]), strict=True):
        s = part @ field.emit
        value = lambda y: sum(s[t, y[t]] for t in range(len(y))) + (field.begin[y[0]] if len(y) else 0) + sum(field.move[a, b] for a, b in itertools.pairwise(y))  # noqa: B023, E731
        assert value(label.tolist()) == pytest.approx(max(map(value, itertools.product((0, 1), repeat=len(part)))))


@pytest.mark.parametrize("model", ["field", "views"])
def test_held_out_accuracy(spark, model):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    half = labels.where("pmod(doc_id, 2) = 0")
    if model == "field":
        kept = quality.judged(docs, quality.train(docs, half))
    else:
        fitted = cotrain.train(docs, half)
        assert fitted.handed[1] > 0
        kept = cotrain.scored(docs, fitted)
    rows = kept.join(labels.where("pmod(doc_id, 2) = 1"), "doc_id").select("quality", "kept", *(["base_failed"] if model == "field" else [])).collect()
    good = [r.kept for r in rows if r.quality and not (model == "field" and r.base_failed)]
    bad = [not r.kept for r in rows if not r.quality]
    assert sum(good) / len(good) >= 0.98 and sum(bad) / len(bad) >= 0.75, (sum(good), len(good), sum(bad), len(bad))


def test_models_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(1, 1), (2, None), (None, 0), (1, 0), (3, 1)], "doc_id long, quality int")
    for labels in (none, one.where("quality = 1")):
        assert cotrain.train(docs, labels).content is None
        assert quality.train(docs, labels).emit[0, 1] == 1
    assert cotrain.scored(docs, cotrain.train(docs, one)).count() == docs.count()
    assert cotrain.train(empty, one).content is None and cotrain.scored(empty, cotrain.CoTrained(None, None)).count() == 0
    assert cotrain.keep(docs, cotrain.CoTrained(None, None)).count() == docs.count()


def test_labels_without_documents_take_no_places(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    labels = spark.range(40_000).selectExpr("id * 50 as doc_id", "int(id > 0) as quality")
    got = {r.doc_id: r._label for r in quality.sample(docs, labels, 100).collect()}
    assert got == {i: int(i > 0) for i in range(0, 2000, 50)}
    labels = docs.selectExpr("doc_id", "int(doc_id >= 3) as quality")
    got = [r._label for r in quality.sample(docs, labels, 200).collect()]
    assert len(got) == 200 and got.count(0) == 2


def test_co_training_helps_the_weak_view():
    r = np.random.default_rng(1)
    y = r.integers(0, 2, 1200)
    a = np.stack([np.ones(1200), y + r.normal(0, 0.2, 1200)], 1)
    b = np.concatenate([np.ones((1200, 1)), (y[:, None] * 2 - 1) * 0.2 + r.normal(0, 1, (1200, 30))], 1)
    alone = cotrain.CoTrained.trained(a[:150], b[:150], y[:150])
    taught = cotrain.CoTrained.trained(a[:150], b[:150], y[:150], cotrain.Pool(a[150:], b[150:]), sure=0.9)
    right = lambda m: ((m.scores(a, b)[1] >= 0.5) == (y > 0))[150:].mean()
    assert right(taught) > right(alone) and taught.handed[1] > 100


def plain_views(r):
    """Both views of a row (doc_id, text, lang, source, n_chars), as slot -> value."""
    t = (r[1] or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", t)
    n, size = max(len(words), 1), max(len(t), 1)
    share = lambda chars: sum(c in chars for c in t)
    symbol, upper, bang, bar = share(b"#*$%&|<>") / n, share(bytes(range(65, 91))) / size, share(b"!") / n, share(b"|") / n
    repeat = sum(a == b for a, b in itertools.pairwise(words)) / n
    content = dict(enumerate([1, min(symbol, 1), symbol > 0.2, symbol > 0.6, upper, upper > 0.3, min(bang, 1), bang > 0.3, min(bar, 1), bar > 0.2, share(b"0123456789") / size, repeat, repeat > 0.3, len(words) < 10]))
    slots = collections.Counter(int(h) % cotrain.WORD_SLOTS for h in Words(pa.array([r[1]], pa.string())).hashes())
    content |= {len(content) + k: 0.5 * (c / n) ** 0.5 for k, c in slots.items()}
    chars = -1 if r[4] is None else r[4]
    meta = dict(enumerate([1, chars < 0, np.log1p(max(chars, 0)) / 12, 0 <= chars < 100, 100 <= chars < 1000, chars >= 20_000]))
    for k, name in enumerate((r[2], r[3])):
        meta[6 + k * cotrain.NAME_SLOTS + xxhash.xxh64_intdigest((name if name is not None else "\0").encode()) % cotrain.NAME_SLOTS] = 0.5
    return content, meta


def test_scores_by_plain_sums(docs, rows):
    r = np.random.default_rng(8)
    model = cotrain.CoTrained(r.normal(size=cotrain.CONTENT_SIZE), r.normal(size=cotrain.META_SIZE), ((0.7, 0.1), (1.3, -0.2)), (0.9, 0.4, 0.05))
    logistic = lambda z: 1 / (1 + np.exp(-z))
    want = []
    for row in rows:
        a, b = (scale[0] * sum(w[k] * v for k, v in x.items()) + scale[1] for x, w, scale in zip(plain_views(row), (model.content, model.meta), model.scale, strict=True))
        want.append((row[0], logistic(a), logistic(b), logistic(0.9 * a + 0.4 * b + 0.05)))
    got = sorted(((x.doc_id, x.p_content, x.p_meta, x.score) for x in cotrain.scored(docs, model).collect()), key=lambda x: (x[0] is None, *(v or 0 for v in x)))
    want.sort(key=lambda x: (x[0] is None, *(v or 0 for v in x)))
    for x, y in zip(got, want, strict=True):
        assert x[0] == y[0] and x[1:] == pytest.approx(y[1:], abs=1e-4)
    assert all((x.score >= 0.5) == x.kept for x in cotrain.scored(docs, model).collect())


def test_the_metadata_view_reads_no_text():
    batch = lambda t: pa.RecordBatch.from_arrays([pa.array(x) for x in (t, ["en", "fr"], ["a", None], [5, 30_000])], ["text", "lang", "source", "n_chars"])
    (_, one), (_, two) = cotrain.views(batch(["x y", "z"])), cotrain.views(batch(["### | 1 A\n" * 90, ""]))
    assert (one == two).all()


def test_pool_of_a_table_is_all_of_it(spark):
    rows = [(i, ("word " * 30 if i % 2 else "x# y| " * 30) + f"t{i}", "en", "good" if i % 2 else "bad", 200) for i in range(400)]
    docs = written(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "docs")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 60)], "doc_id long, quality int")
    known = cotrain.view_rows(docs.where("doc_id < 60"))
    x = [np.array([known[i][v] for i in range(60)]) for v in (0, 1)]
    y = np.arange(60) % 2
    weights = [cotrain.fit(a, y) for a in x]
    scale = [cotrain.calibrate(a @ w, y) for a, w in zip(x, weights, strict=True)]
    rest = cotrain.view_rows(docs.where("doc_id >= 60"))
    ids = sorted(rest)
    plain = cotrain.Pool(*(np.array([rest[i][v] for i in ids]) for v in (0, 1)))
    for handed in (10_000, 7):
        got = {(v, value, i) for v, value, i, _ in cotrain.TablePool(docs, labels).surest(weights, scale, [{61}, set()], 0.9, handed)}
        want = {(v, value, ids[i]) for v, value, i, _ in plain.surest(weights, scale, [{1}, set()], 0.9, handed)}
        assert collections.Counter(g[:2] for g in got) == collections.Counter(w[:2] for w in want) and (handed == 7 or got == want) and got
        assert all(i >= 60 and (v, i) != (0, 61) for v, _, i in got)


# Line labels


def test_mixed_pages_get_mixed_labels(spark):
    r = random.Random(4)
    prose = lambda: " ".join(r.choices(["some", "words", "of", "plain", "prose", "that", "reads", "well"], k=14)) + "."
    junk = lambda: " | ".join(r.choices(["Home", "Login", "About", "Help", "Buy", "More"], k=12)) + " ###"
    rows, labels, mixed = [], [], {}
    for i in range(240):
        good = i % 2
        lines = [prose() if good else junk() for _ in range(8)]
        if i % 3 == 0:  # boilerplate within good pages and prose within poor ones
            lines[:2] = [junk() if good else prose() for _ in range(2)]
        rows.append((i, "\n".join(lines)))
        labels.append((i, good))
    for i in range(240, 300):
        k = r.randrange(1, 8)
        lines = [junk() for _ in range(k)] + [prose() for _ in range(8 - k)]
        rows.append((i, "\n".join(lines)))
        mixed[i] = sum(len(x.split()) for x in lines[k:])
    docs = written(spark.createDataFrame(rows, "doc_id long, text string"), "docs")
    field = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"), 240)
    got = {x.doc_id: x for x in quality.judged(docs, field).collect()}
    assert all(got[i].n_content_words == n for i, n in mixed.items())
    shares = [n / got[i].n_words for i, n in mixed.items()]
    assert min(shares) < 0.5 < max(shares)
    assert all(got[i].kept == (not base_counts(t)[-1] and 2 * mixed[i] >= got[i].n_words) for i, t in rows[240:])


def test_kept_by_brute_force(docs, rows):
    r = np.random.default_rng(2)
    field = quality.LineField(r.normal(size=(quality.FEATURES, 2)), r.normal(size=(2, 2)), r.normal(size=2))
    want = []
    for row in rows:
        lines = quality.Lines(pa.array([row[1]], pa.string()))
        s = lines.features() @ field.emit
        best = [(field.begin[y] + s[0, y], (y,)) for y in (0, 1)] if len(s) else [(0, ())]
        for t in range(1, len(s)):
            best = [max(((v + field.move[p[-1], y] + s[t, y], (*p, y)) for v, p in best), key=lambda x: x[0]) for y in (0, 1)]
        labels = max(best, key=lambda x: x[0])[1]
        content = sum(len(WORD.findall(x)) for x, y in zip([x for x in (row[1] or "").split("\n") if WORD.search(x)], labels, strict=True) if y)
        n, *_, failed = base_counts(row[1])
        want.append((row[0], content, not failed and 2 * content >= n))
    same(quality.judged(docs, field).select("doc_id", "n_content_words", "kept"), want)


# Word pieces


def greedy(word, first, inner):
    at = n = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in (first if at == 0 else inner)), None)
        if end is None:
            return 0
        n, at = n + 1, end
    return n


def test_word_pieces(docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    first, inner = map(set, wordpiece.byte_pieces(path))
    want = []
    for r in rows:
        n = [greedy(b" " + w, first, inner) for w in re.findall(rb"[^\x20\x09-\x0D]+", (r[1] or "").encode())]
        want.append((r[0], len(n), sum(max(x, 1) for x in n), n.count(0), max([1, *n]) if n else 0))
    same(wordpiece.counted(docs, path), want)
    assert wordpiece.counted(empty, path).count() == 0


def test_automaton_on_random_vocabularies():
    r = random.Random(2)
    for _ in range(200):
        make = lambda k: bytes(r.choices(b"ab", k=k))
        first, inner = {b" " + make(r.randrange(4)) for _ in range(3)}, {make(r.randrange(1, 5)) for _ in range(5)}
        words = [b" " + make(r.randrange(1, 9)) for _ in range(30)]
        ends = np.cumsum([len(w) for w in words])
        got = wordpiece.PieceAutomaton(sorted(first), sorted(inner)).count(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)
        assert got.tolist() == [greedy(w, first, inner) for w in words]


# SimHash


def fingerprint(t, k=3):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, codes, most):
    root = list(range(len(ids)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in itertools.combinations(range(len(ids)), 2):
        if (codes[a] ^ codes[b]).bit_count() <= most:
            root[find(a)] = find(b)
    least = {}
    for i, v in enumerate(ids):
        if v is not None:
            least[find(i)] = min(v, least.get(find(i), v))
    return [least.get(find(i)) for i in range(len(ids))]


def test_simhash(docs, rows, empty):
    codes = [fingerprint(r[1]) for r in rows]
    want = groups([r[0] for r in rows], codes, 2)
    same(simhash.near_duplicates(docs), [(r[0], f"{c:016x}", g) for r, c, g in zip(rows, codes, want, strict=True)])
    assert simhash.near_duplicates(empty).count() == 0


def shingles(t, k=5):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def similar_by_all_pairs(rows, similarity=0.8):
    """doc_id -> the smallest doc_id that pairs of at least this Jaccard similarity lead to."""
    root = {d: d for d, _ in rows}
    find = lambda x: x if root[x] == x else find(root[x])
    sets = [(d, shingles(t)) for d, t in rows]
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if len(x & y) >= similarity * len(x | y):
            u, v = find(a), find(b)
            root[max(u, v)] = min(u, v)
    return {d: find(d) for d in root}


def test_similar_groups(spark, docs, rows, empty):
    ids = collections.Counter(r[0] for r in rows)
    single = [(r[0], r[1]) for r in rows if r[0] is not None and ids[r[0]] == 1]
    base = [f"w{i}" for i in range(80)]
    edits = [(1000 + i, " ".join([*base[: i * 3], f"edit{i}", *base[i * 3 + 1 :]])) for i in range(12)]
    edits += [(2000 + i, " ".join(base[: 40 + i])) for i in range(0, 40, 3)]
    given = single + edits
    frame = written(spark.createDataFrame(given, "doc_id long, text string"), "docs")
    for most in (0, 2):
        assert {r.doc_id: r.group_id for r in nearsets.similar_groups(frame, most=most).collect()} == similar_by_all_pairs(given)
    assert nearsets.similar_groups(empty).count() == 0


def test_copies_that_only_their_base_connects(spark):
    base = [f"b{i}" for i in range(300)]
    copies = []
    for i in range(21):
        words = list(base)
        for k in range(5):
            words[5 + 58 * k + (2 * i) % 42] = f"copy{i}x{k}"
        copies.append((i, " ".join(words)))
    given = [*copies, (100, " ".join(base))]
    want = similar_by_all_pairs(given)
    assert set(want.values()) == {0} and len(set(similar_by_all_pairs(copies).values())) > 1
    frame = written(spark.createDataFrame(given, "doc_id long, text string"), "docs")
    assert {r.doc_id: r.group_id for r in nearsets.similar_groups(frame, most=0).collect()} == want


def test_near_copies_of_short_texts(spark):
    given = []
    for n in range(5, 61):
        for j, edit in enumerate(("append", "replace first", "replace last", "cut")):
            words = [f"t{n}x{j}w{i}" for i in range(n + 4)]
            more = n // 4 if edit == "append" else 0
            other = [*words, *(f"t{n}x{j}new{i}" for i in range(more))]
            for k in range(n // 10):
                if edit == "replace first":
                    other[k] += "edit"
                elif edit == "replace last":
                    other[-1 - k] += "edit"
            if edit == "cut":
                other = words[: n + 4 - n // 5]
            given += [(2 * len(given), " ".join(words)), (2 * len(given) + 1, " ".join(other))]
    want = similar_by_all_pairs(given)
    frame = written(spark.createDataFrame(given, "doc_id long, text string"), "docs")
    for most in (0, 2):
        assert {r.doc_id: r.group_id for r in nearsets.similar_groups(frame, most=most).collect()} == want


def test_near_copies_of_a_dissimilar_least_document(spark):
    given = []
    for i in range(60):
        phrase = f"p{i}a p{i}b p{i}c " * 60
        tail = [f"x{i}w{k}" for k in range(5)]
        for words in ([f"z{i}w{k}" for k in range(5)], tail, [*tail, f"y{i}", f"y{i}b"]):
            given.append((len(given), phrase + " ".join(words)))
    frame = written(spark.createDataFrame(given, "doc_id long, text string"), "docs")
    want = similar_by_all_pairs(given)
    assert all(want[i] == i and want[i + 1] == want[i + 2] == i + 1 for i in range(0, len(given), 3))
    assert {r.doc_id: r.group_id for r in nearsets.similar_groups(frame).collect()} == want


def family(r, name, start, words, edits, copies):
    """Copies of one text with some words replaced, and each one's group by all pairs."""
    base = [f"{name}w{i}" for i in range(words)]
    given, n = [], words - 4
    # Shingles that an edit spares are the base's, so a set is told by the edited places.
    spared = np.ones((copies, n), bool)
    for i in range(copies):
        own = list(base)
        for k in r.sample(range(words), edits):
            own[k] = f"{name}e{i}x{k}"
            spared[i, max(0, k - 4) : k + 1] = False
        given.append((start + i, " ".join(own)))
    root = np.arange(copies)
    for i in range(copies):
        common = (spared[i] & spared[:i]).sum(1)
        for j in np.flatnonzero(common >= 0.8 * (2 * n - common)):
            a, b = root[i], root[j]
            root[root == max(a, b)] = min(a, b)
    return given, {start + i: start + int(g) for i, g in enumerate(root)}


@pytest.mark.parametrize(("group", "sizes"), [(nearsets.GROUP, (300, 300, 300, 3000)), (40, (100, 100, 100, 0))])
def test_families_of_one_base(spark, group, sizes):
    r = random.Random(17)
    given, want = [], {}
    for k, ((words, edits), copies) in enumerate(zip(((120, 2), (300, 5), (40, 1), (120, 2)), sizes, strict=True)):
        rows, roots = family(r, f"f{k}", 10_000 * k, words, edits, copies)
        given += rows
        want |= roots
    assert len({want[d] for d in range(sizes[0])}) < sizes[0]
    frame = written(spark.createDataFrame(given, "doc_id long, text string"), "docs")
    assert {x.doc_id: x.group_id for x in nearsets.similar_groups(frame, group=group).collect()} == want


@pytest.mark.parametrize("top", [1, 3, 1000])
def test_most_often(spark, top):
    r = random.Random(top)
    for n, most in ((0, 5), (30, 100), (30, 30), (3000, 700), (3000, 1), (3000, 2999)):
        rows = [(h, 2 + r.randrange(top)) for h in r.sample(range(1 << 54), n)]
        h, times = nearsets._most_often(written(spark.createDataFrame(rows, "h long, count long"), "counted"), most)
        assert list(zip(h.tolist(), times.tolist(), strict=True)) == sorted(rows, key=lambda x: (-x[1], x[0]))[:most]


def test_groups_do_not_hang_on_the_sample(spark, monkeypatch):
    r = random.Random(11)
    base = [r.choices(range(10**6), k=60) for _ in range(12)]
    given = [(i, " ".join(f"w{x}" for x in [*base[i % 12][: 57 + i % 4], i])) for i in range(72)]
    frame = spark.createDataFrame(given, "doc_id long, text string")
    want = similar_by_all_pairs(given)
    for most in (1 << 27, 3000, 1):  # bytes: all documents are read, some, or about none
        monkeypatch.setattr(nearsets, "COMMON_BYTES", most)
        assert {x.doc_id: x.group_id for x in nearsets.similar_groups(frame).collect()} == want


#: 200 texts of 400 words, each found twice, so that 79,200 shingles are equally common: more than all tasks may send to the driver.
SMALL_RESULTS = """
import random, sys
from pyspark.sql import SparkSession
conf = {"spark.driver.maxResultSize": "1m", "spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.ui.enabled": "false"}
spark = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
from chronokv.llm import nearsets
from chronokv.llm.common import written
nearsets.COMMON = 1000
r = random.Random(5)
texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(400)) for _ in range(200)]
docs = written(spark.createDataFrame([(i, texts[i % 200]) for i in range(400)], "doc_id long, text string"), "docs")
h, n = nearsets._common(docs, 5)
assert len(h) == 1000 and set(n.tolist()) == {2} and (h[1:] > h[:-1]).all()
print("sent", len(h))
"""


def test_common_shingles_fit_the_driver():
    root = Path(__file__).resolve().parents[2]
    ran = subprocess.run([sys.executable, "-c", SMALL_RESULTS], cwd=root, capture_output=True, text=True, timeout=300)
    assert "sent 1000" in ran.stdout, ran.stderr[-2000:]


def test_one_of_each(docs, rows, empty):
    left = nearsets.one_of_each(docs)
    assert left.columns == docs.columns and nearsets.one_of_each(empty).count() == 0
    ids = [r.doc_id for r in left.collect()]
    assert ids.count(None) == 2 and len(set(ids) - {None}) == len([i for i in ids if i is not None])
    one = {}
    for r in rows:
        if r[0] is not None:
            one[r[0]] = r[1]
    assert set(ids) - {None} == {d for d, g in similar_by_all_pairs(list(one.items())).items() if d == g}


@pytest.mark.parametrize("sizes", [{}, {"part_codes": 5, "askers": 3}])
@pytest.mark.parametrize("most", [0, 2, 3])
def test_links_reach_what_all_pairs_reach(spark, sizes, most):
    r = random.Random(most)
    codes = {r.getrandbits(64) for _ in range(20)} | {0, (1 << 64) - 1}
    for _ in range(8):
        codes |= {c ^ sum(1 << b for b in r.sample(range(64), 2)) for c in r.sample(sorted(codes), 20)}
    codes = sorted(codes)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    frame = written(spark.createDataFrame([(c,) for c in signed], "bits long"), "codes")
    root = {x.node: x.root for x in components(simhash.near_links(frame, most, **sizes)).collect()}
    want = groups(list(range(len(codes))), codes, most)
    got = collections.defaultdict(set)
    for i, c in enumerate(signed):
        got[root.get(c, c)].add(i)
    assert sorted(map(sorted, got.values())) == sorted([i for i, w in enumerate(want) if w == g] for g in set(want))


def test_tree_prunes_groups_and_loses_no_pair():
    r = np.random.default_rng(5)
    codes = r.integers(0, 1 << 63, 6000, dtype=np.uint64) * np.uint64(2)
    codes = np.unique(np.concatenate([codes, codes[:500] ^ (np.uint64(1) << r.integers(0, 64, 500).astype(np.uint64))]))
    tree = simhash.GrayIndex(codes)
    assert len(tree.levels) >= 4 and (np.diff(simhash.gray_rank(tree.codes).astype(object)) > 0).all()
    got = {(int(a), int(b)) for q, at in tree.near(codes, 2) for a, b in zip(q, at, strict=True)}
    want = {(int(a), int(b)) for lo in range(0, len(codes), 500) for a, b in zip(*np.nonzero(np.bitwise_count(codes[lo : lo + 500, None] ^ codes[None, :]) <= 2), strict=True) for a in [a + lo]}
    assert got == want
    # Whole groups are left out at every level: far fewer nodes are met than there are fingerprints to compare.
    assert tree.pruned > 0.5 * tree.met and tree.met < 0.1 * len(codes) ** 2
    before = tree.met
    assert list(tree.near(np.array([codes[0] ^ np.uint64((1 << 64) - 1)]), 0))[0][0].size == 0 and tree.met - before < 60


@pytest.mark.parametrize("chunk", [1 << 20, 0])
def test_components_of_a_long_chain_and_a_star(spark, chunk):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(5, 5), (None, 3), (101, 100)]
    want = {i: 0 for i in range(61)} | {100 + i: 100 for i in range(80)}
    assert {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), chunk).collect()} == want
    assert components(spark.createDataFrame([], "a long, b long"), chunk).count() == 0
    if not chunk:
        names = [tuple(None if x is None else f"{x:03d}" for x in r) for r in links]
        assert {r.node: r.root for r in components(spark.createDataFrame(names, "a string, b string")).collect()} == {f"{n:03d}": f"{r:03d}" for n, r in want.items()}


# Substrings


def removals(rows, k=13):
    least = {}
    words = [WORD.findall(r[1] or "") for r in rows]
    for r, w in zip(rows, words, strict=True):
        for i in range(len(w) - k + 1):
            if r[0] is not None:
                least[tuple(w[i : i + k])] = min(r[0], least.get(tuple(w[i : i + k]), r[0]))
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - k + 1) for j in range(i, i + k) if r[0] is not None and least[tuple(w[i : i + k])] < r[0]}
        out.append((w, gone))
    return out


def test_substrings(docs, rows, empty):
    want, runs = [], {}
    for r, (w, gone) in zip(rows, removals(rows), strict=True):
        want.append((r[0], len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
        runs[r[0]] = gone
    got = substrings.remove_repeats(docs)
    same(got.select("doc_id", "n_words", "n_removed", "kept_sha256"), want)
    for r in got.where("doc_id is not null").collect():
        assert {j for a, b in r.intervals for j in range(a, b)} == runs[r.doc_id]
        assert all(x[1] < y[0] for x, y in itertools.pairwise(r.intervals))
    assert substrings.remove_repeats(empty).count() == 0
    cut = substrings.without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    by = {r[0]: (r[1], w, gone) for r, (w, gone) in zip(rows, removals(rows), strict=True) if r[0] is not None}
    for r in cut.where("doc_id is not null").collect():
        text, w, gone = by[r.doc_id]
        if not gone:
            assert r.text == text
        else:
            assert WORD.findall(r.text) == [x for i, x in enumerate(w) if i not in gone] and r.n_chars == len(r.text)


def test_substrings_by_sql(spark, rows):
    ids = collections.Counter(r[0] for r in rows)
    single = [r for r in rows if r[0] is not None and ids[r[0]] == 1]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in single], pa.int64()), "text": pa.array([r[1] for r in single], pa.string())}))
    same(substrings.remove_repeats(spark.createDataFrame(single, SCHEMA)).drop("intervals"), con.sql(registry.ORACLE_SQL["op4_substring_dedup"]).fetchall())


def test_windows_in_one_slice_and_in_many(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j) % 40}" for j in range(50)), None, None, 0, None, None) for i in range(300)]
    want = [(r[0], len(w), len(gone)) for r, (w, gone) in zip(rows, removals(rows), strict=True)]
    for parts in (1, 7):
        same(substrings.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(parts)).select("doc_id", "n_words", "n_removed"), want)


# Licences


MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD3 = """Copyright (c) 2019, A Company. All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of A Company nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
APACHE = """Copyright 2021 The Authors

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""


def wrapped(text, width=72, mark=""):
    return "\n".join(f"{mark}{line}".rstrip() for part in text.split("\n") for line in (textwrap.wrap(part, width) or [""]))


def licences_cases():
    cases = []
    for text, name in ((MIT, "MIT"), (BSD3, "BSD-3-Clause,AllRightsReserved"), (APACHE, "Apache-2.0"), (GPL, "GPL-3.0-or-later"), (GPL.replace("either version 3", "version 2").replace(", or (at your option) any later version", ""), "GPL-2.0"), (MPL, "MPL-2.0")):
        cases += [(form, name) for form in (text, wrapped(text), wrapped(text, 66, "// "), wrapped(text, 60, " * "), wrapped(text, 72, "# "), "Some prose before\n" + wrapped(text) + "\n\nand after.")]
    cases += [
        ("Copyright 2020 X.\nReleased under the MIT License.\nAll rights reserved.", "MIT"), ("Copyright 2020 X.\nAll rights reserved.", "AllRightsReserved"), ("All  rights\treserved", ""), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        ("under\tCC  BY", "CC-BY"), ("SPDX-License-Identifier: MIT\nReleased under the MIT License", "MIT"), ("// SPDX-License-Identifier: GPL-2.0-or-later\nint main() {}", "GPL-2.0-or-later"), ("no stop here\nThis work is licensed under the GNU General Public License, version 3.\nmore", "GPL-3.0"),
        ("This program is licensed under the GNU GPL v3 or later.", "GPL-3.0-or-later"), ("Licensed under the BSD 3-Clause License.", "BSD-3-Clause"), ("Copyright law is a field of its own, and warranty too.", ""), ("You are under arrest.", ""), ("Released under the MIT License. Licensed under the Apache License, Version 2.0.", "Apache-2.0,MIT"),
    ]
    return cases


def test_licences(spark, docs, rows, empty):
    cases = licences_cases()
    every = [(r[0], r[1]) for r in rows] + [(10_000 + i, t) for i, (t, _) in enumerate(cases)]
    con = duckdb.connect()
    documents = pa.table({"doc_id": pa.array([r[0] for r in every], pa.int64()), "text": pa.array([r[1] for r in every], pa.string())})
    con.register("documents", documents)
    got = written(licenses.scanned(spark.createDataFrame(every, "doc_id long, text string")), "scanned")
    found = {r.doc_id: r for r in got.collect()}
    for i, (text, name) in enumerate(cases):
        assert found[10_000 + i].licenses == name, (text, found[10_000 + i])
    assert {r.licenses for r in got.where("doc_id < 10000 and verdict = 'found'").collect()} == {"Apache-2.0,MIT"}
    same(got, con.sql(registry.ORACLE_SQL["op5_license_scan"]).fetchall())
    assert licenses.scanned(empty).count() == 0 and licenses.scanned(docs).count() == len(rows)


def test_licence_tables():
    assert len(licenses.WHOLE) + len(licenses.PATTERNS) > 150 and len(licenses.RULES) > 150
    assert all(re.search(licenses.HINTS, s) for s in licenses.WHOLE if not s.startswith("spdx")) and re.search(licenses.HINTS, "spdx license identifier mit")
    known = {*licenses.WHOLE.values(), *(i for i, _ in licenses.PATTERNS)}
    assert all(i in known for _, ids in licenses.RULES for i in ids)
    assert not any("," in i or "#" in i for i in known)


# Packing


def test_shortest_pack_first():
    r = random.Random(4)
    for _ in range(50):
        histogram = {r.randrange(1, 65): r.randrange(1, 30) for _ in range(r.randrange(1, 20))}
        packs = packing.shortest_pack_first(histogram, 64)
        used = collections.Counter()
        for pattern, count in packs:
            assert sum(pattern) <= 64 and count > 0
            for n in pattern:
                used[n] += count
        assert used == collections.Counter(histogram)
    assert packing.shortest_pack_first({40: 2, 30: 1, 20: 3, 4: 1}, 64) == packing.shortest_pack_first({4: 1, 20: 3, 30: 1, 40: 2}, 64)
    with pytest.raises(ValueError):
        packing.shortest_pack_first({65: 1}, 64)


def test_packing(docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    ids = collections.defaultdict(list)
    for r in rows:
        ids[r[0]].append([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0])
    got = packing.packed(docs, path).collect()
    cover = collections.defaultdict(collections.Counter)
    for r in got:
        assert any(len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
        cover[r.doc_id].update(range(r.start, r.start + r.length))
    for k, every in ids.items():
        assert cover[k] == sum((collections.Counter(range(len(x))) for x in every), collections.Counter())
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    assert packing.packed(empty, path).count() == 0


def test_packed_ids_of_every_code_point():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, tokenizer = packing.ByteBpe(path), Tokenizer.from_file(path)
    points = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x110000))]
    given = ["\n".join(f"a{c}b {c} {c}1" for c in points[i : i + 4000]) for i in range(0, len(points), 4000)]
    for i in range(0, len(given), 40):
        want = tokenizer.encode_batch(given[i : i + 40], add_special_tokens=False)
        assert all(x.tolist() == e.ids for x, e in zip(own.encode(given[i : i + 40]), want, strict=True)), i


def test_ranks_without_gaps(spark):
    frame = written(spark.createDataFrame([(i % 3, i // 2) for i in range(1000)], "k int, v int"), "ranks")
    by = collections.defaultdict(list)
    for r in gapless(frame, ["k"], [frame["v"]], "n").collect():
        by[r.k].append(r.n)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


# Sharding


def plain_jump(k, n):
    b = j = -1
    j = 0
    while j < n:
        b = j
        k = (k * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((k >> 33) + 1)))
    return b


def test_sharding(docs, rows, empty):
    keys = np.random.default_rng(0).integers(0, 1 << 63, 3000).astype(np.uint64)
    assert sharding.jump(keys, 24).tolist() == [plain_jump(int(k), 24) for k in keys]
    a, b = sharding.jump(keys, 24), sharding.jump(keys, 25)
    assert set(b[a != b].tolist()) == {24} and 0.02 < (a != b).mean() < 0.06
    with pytest.raises(ValueError):
        sharding.jump(keys, 0)
    got = sharding.placed(docs).collect()
    assert collections.Counter((r.doc_id, r.size, r.text_crc32, r.law) for r in got) == collections.Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode()), "key") for r in rows)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    assert sharding.placed(empty).count() == 0


# Media


@pytest.mark.parametrize("kind", range(5))
def test_every_png_filter(kind):
    image = np.random.default_rng(kind).integers(0, 256, (9, 64)).astype(np.uint8)
    rows = np.zeros((9, 65), np.uint8)
    for y in range(9):
        rows[y, 0] = kind if y != 4 else 0
        for x in range(64):
            a = int(image[y, x - 1]) if x else 0
            b = int(image[y - 1, x]) if y else 0
            c = int(image[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            rows[y, x + 1] = (int(image[y, x]) - [0, a, b, (a + b) // 2, paeth][rows[y, 0]]) % 256
    assert (media.unfiltered(rows) == image).all()


def test_media(docs, rows, empty):
    got = media.read_media(media.to_media(docs)).collect()
    facts = {}
    for r in got:
        facts.setdefault((r.n_bytes, r.payload_sha256), set()).add(tuple(r)[1:])
    assert all(len(v) == 1 for v in facts.values())
    want = []
    for r in rows:
        raw = (r[1] or "").encode()
        p = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        want.append((r[0], len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    for r, m in zip(sorted(got, key=key), sorted(media.to_media(docs).collect(), key=key), strict=True):
        assert (r.n_bytes, len(r.feature)) == (m.n_bytes, 16)
    assert media.read_media(media.to_media(empty)).count() == 0


def test_damaged_media(spark):
    good = media.encode_png(media.payload_of("hello " * 100))
    assert media.decode_png(good).tobytes().rstrip(b"\0") == b"hello " * 100
    for bad in (good[:-1], good[:40], b"", b"GIF89a", good[:50] + bytes([good[50] ^ 1]) + good[51:]):
        with pytest.raises(ValueError):
            media.decode_png(bad)
    r = media.read_media(spark.createDataFrame([(1, 3, bytearray(good[:-1])), (2, 3, None)], "doc_id long, n_bytes long, media binary")).orderBy("doc_id").collect()
    assert r[0].media_bytes == len(good) - 1 and r[0].payload_sha256 is None and r[1].media_bytes is None


def test_pairs_of_long_texts_are_ruled_out_before_their_sets_are_joined(spark, monkeypatch):
    r = random.Random(12)
    word = lambda: f"w{r.randrange(1 << 40):x}"
    long = [[word() for _ in range(nearsets.MOST_BITS // 2)] for _ in range(4)]  # too many shingles for a common sketch
    near = [word() if i % 400 == 0 else w for i, w in enumerate(long[0])]
    given = [(i, " ".join(x)) for i, x in enumerate([*long, near, long[0][: nearsets.MOST_BITS // 3]])]
    frame = written(spark.createDataFrame(given, "doc_id long, text string"), "docs")
    pairs = written(spark.createDataFrame([(a, b) for a in range(6) for b in range(a + 1, 6)], "a long, b long"), "pairs")
    kept, likely = [], nearsets._likely

    def noted(*args):
        got = likely(*args)
        kept.append(sorted(tuple(x) for x in got.collect()))
        return got

    monkeypatch.setattr(nearsets, "_likely", noted)
    assert [tuple(x) for x in nearsets.similar(pairs, frame, 5, 0.8).collect()] == [(0, 4)]
    assert kept == [[(0, 4)]]


# BPE


def test_word_bpe(docs, rows, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    want, plain = [], []
    for r in rows:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        want.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        plain.append((r[0], text))
    same(bpe.digests(docs, path), want)
    same(bpe.decoded(bpe.encoded(docs, path), path), plain)
    assert bpe.digests(empty, path).count() == 0 == bpe.encoded(empty, path).count()


def test_word_bpe_of_every_code_point():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, tokenizer = bpe.WordBpe(path), Tokenizer.from_file(path)
    points = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x110000))]
    given = ["\n".join(f"a{c}b {c} {c}1" for c in points[i : i + 2000]) for i in range(0, len(points), 2000)]
    want = [e.ids for e in tokenizer.encode_batch(given, add_special_tokens=False)]
    for i in range(0, len(given), 40):
        docs, ids = own.encode(given[i : i + 40])
        assert [np.concatenate([ids[u] for u in d]).tolist() for d in docs] == want[i : i + 40], i


def test_word_bpe_takes_special_tokens_as_they_stand():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, tokenizer = bpe.WordBpe(path), Tokenizer.from_file(path)
    for t in ("<|ENDOFTEXT|>", "a<|EndOfText|>B <|endoftext|> <|STARTOFTEXT|>", "<|endoftext|>\u0301 x", "A<|startoftext|>a"):
        assert own.encode_ids(t) == tokenizer.encode(t, add_special_tokens=False).ids


def test_word_bpe_normalises_each_run_once(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    own, tokenizer = bpe.WordBpe(path), Tokenizer.from_file(path)
    seen, normal = [], own.normal
    monkeypatch.setattr(own, "normal", lambda u: seen.append(u) or normal(u))
    own._forget()
    given = ["\u00c9t\u00e9 THE the \u03a3\u03a3 e\u0301t\u00e9", "the\u2000\u0308 THE\x1cthe \u00c9t\u00e9"] * 50
    docs, ids = own.encode(given)
    assert [np.concatenate([ids[u] for u in d]).tolist() for d in docs] == [tokenizer.encode(t, add_special_tokens=False).ids for t in given]
    assert sorted(seen) == sorted({u for t in given for u in own.units(t)}) and len(ids) < len(seen)
    n, number, string = own.strings()
    assert [(n[u], number[u], string[u]) for u in range(len(ids))] == [(len(x), " ".join(map(str, x.tolist())), own.decode(x)) for x in ids]


def test_slices_are_filled_from_many_batches():
    batches = [pa.RecordBatch.from_arrays([pa.array(["x" * 10, None, "yy"])], ["text"])] * 7
    got = [b.num_rows for b in filled(iter(batches), 30)]
    assert got == [9, 9, 3] and sum(got) == 21


def test_runs_of_one_symbol():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, own = Tokenizer.from_file(path), bpe.encoder(path)
    r = random.Random(9)
    for t in ["a" * n for n in range(1, 40)] + ["".join(r.choices("abnhs", k=r.randrange(1, 30))) for _ in range(300)]:
        assert own.encode_ids(t) == tokenizer.encode(t, add_special_tokens=False).ids


# Shared parts


def test_words_of_slices():
    given = texts()
    w = Words(pa.array(given).slice(2))
    raw = w.raw.tobytes()
    want = [(i, x) for i, t in enumerate(given[2:]) for x in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
    assert [(d, raw[s:e]) for d, s, e in zip(w.doc.tolist(), w.start.tolist(), w.end.tolist(), strict=True)] == want
    h = w.hashes().tolist()
    assert len(set(h)) == len({x for _, x in want}) and len(set(zip(h, (x for _, x in want), strict=True))) == len(set(h))


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


def test_texts_of_two_letters_do_not_meet(spark):
    # Polynomial hashes modulo 2**64 are equal for these, whatever the base and the letters' values.
    a = thue_morse(1024)
    b = a.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"w{i}" for i in range(12))
    given = [(1, f"{tail} {a}"), (2, f"{tail} {b}"), (3, f"{a}\n{b}\n{a}"), (4, " ".join([*a[:256], *b[:256]]))]
    frame = written(spark.createDataFrame(given, "doc_id long, text string"), "docs")
    assert {r.doc_id: r.n_removed for r in substrings.remove_repeats(frame).where("doc_id < 3").collect()} == {1: 0, 2: 0}
    got = {r.doc_id: (r.n_dup_lines, r.n_repeat_words) for r in quality.judged(frame, quality.LineField.neutral()).collect()}
    assert got == {i: (base_counts(t)[3], base_counts(t)[4]) for i, t in given}
    path = public_tokenizers.path("byte_bpe_50k.json")
    first, inner = map(set, wordpiece.byte_pieces(path))
    got = {r.doc_id: r.n_tokens for r in wordpiece.counted(frame, path).collect()}
    assert got == {i: sum(max(greedy(b" " + w.encode(), first, inner), 1) for w in t.split()) for i, t in given}


def test_windows_are_a_polynomial_modulo_a_prime():
    r = np.random.default_rng(3)
    h = r.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    doc = np.repeat([0, 1], 30)
    for k in (1, 2, 5, 13, 30):
        got, at = windows(h, doc, k)
        plain = [sum((int(x) & PRIME) % PRIME * pow(BASE, k - 1 - j, PRIME) for j, x in enumerate(h[i : i + k])) % PRIME for i in at.tolist()]
        assert got.tolist() == mix(np.array(plain, np.uint64) + np.uint64(k)).tolist() and len(at) == 2 * (31 - k)


def test_hashes_of_many_ranges():
    r = random.Random(12)
    raw = r.randbytes(20_000)
    spans = [(a, a + n) for n in [*range(140), 1000, 5000] for a in (0, r.randrange(15_000 - n), 20_000 - n)]
    start, end = (np.array(x, np.int64) for x in zip(*spans, strict=True))
    for seed in (0, 42):
        assert xxh64(np.frombuffer(raw, np.uint8), start, end, seed).tolist() == [xxhash.xxh64_intdigest(raw[a:b], seed) for a, b in spans]
    assert len(xxh64(np.zeros(0, np.uint8), start[:0], end[:0], 42)) == 0
