"""Quality classifier by co-training (Blum and Mitchell 1998): two views teach each other.

One view sees a text's content: kinds of characters, repeats and hashed words.  The other sees the page's metadata alone, columns beside the text:
language, source and stated size.  Each round both logistic models are fitted, all unlabelled documents of the table are scored, and each model hands those
of which it is surest to the other as pseudo-labels.  At the end both are calibrated on labelled documents that no model was
fitted on, and a weighted sum of their calibrated log-odds scores every document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, column, in_batches, pieces, written
from .quality import _BANG, _BAR, _DIGIT, _SYMBOL, _UPPER, sample

#: Labelled documents that fitting reads at most.
LABELLED = 2000
ROUNDS = 3
#: A pseudo-label needs at least this probability; a view hands over the surest so many of each class in a round.
SURE, HANDED = 0.97, 200
#: Strength of the pull when views are combined.
PULL = 0.1
WORD_SLOTS, NAME_SLOTS = 512, 64
_DENSE, _STATED = 14, 6
CONTENT_SIZE, META_SIZE = _DENSE + WORD_SLOTS, _STATED + 2 * NAME_SLOTS
THRESHOLD = 0.5


def views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Both views of a slice of documents with text, lang, source and n_chars, as rows of numbers."""
    w = Words(column(batch, "text"))
    n = np.maximum(w.n, 1).astype(np.float64)
    size = np.maximum(np.diff(w.bounds), 1).astype(np.float64)
    hashes = w.hashes()
    count = lambda marks: w.per_doc(marks).astype(np.float64)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (w.doc[1:] == w.doc[:-1])
    repeat = np.bincount(w.doc[same], minlength=w.docs) / n
    symbol, upper, bang, bar, digit = (count(c[w.raw]) for c in (_SYMBOL, _UPPER, _BANG, _BAR, _DIGIT))
    cap = np.minimum
    dense = [np.ones(w.docs), cap(symbol / n, 1), symbol / n > 0.2, symbol / n > 0.6, upper / size, upper / size > 0.3, cap(bang / n, 1), bang / n > 0.3, cap(bar / n, 1), bar / n > 0.2, digit / size, repeat, repeat > 0.3, w.n < 10]
    slots = np.bincount(w.doc * WORD_SLOTS + (hashes % np.uint64(WORD_SLOTS)).astype(np.int64), minlength=w.docs * WORD_SLOTS).reshape(w.docs, WORD_SLOTS)
    slots = np.sqrt(slots / n[:, None]) * 0.5
    content = np.concatenate([np.stack(dense, 1), slots], 1).astype(np.float32)

    chars = np.nan_to_num(np.asarray(column(batch, "n_chars").cast(pa.float64()).fill_null(-1)), nan=-1.0)
    stated = [np.ones(w.docs), chars < 0, np.log1p(np.maximum(chars, 0)) / 12, (chars >= 0) & (chars < 100), (chars >= 100) & (chars < 1000), chars >= 20_000]
    rows = np.arange(w.docs)
    names = np.zeros((w.docs, 2 * NAME_SLOTS))
    for k, name in enumerate(("lang", "source")):
        coded = pc.dictionary_encode(column(batch, name).cast(pa.string()).fill_null("\0"))
        slot = np.array([xxhash.xxh64_intdigest(v.encode()) % NAME_SLOTS for v in coded.dictionary.to_pylist()], np.int64)
        if len(slot):
            names[rows, k * NAME_SLOTS + slot[np.asarray(coded.indices)]] = 0.5
    return content, np.concatenate([np.stack(stated, 1), names], 1).astype(np.float32)


def odds(x: np.ndarray) -> np.ndarray:
    return np.log(x) - np.log1p(-x)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, steps: int = 300, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression by Nesterov's accelerated gradient."""
    x = x.astype(np.float64)
    rate = 4 / (np.square(x).sum(1).mean() + decay)
    w = ahead = np.zeros(x.shape[1])
    for t in range(steps):
        new = ahead + rate * (x.T @ (y - sigmoid(x @ ahead)) / len(y) - decay * ahead)
        w, ahead = new, new + t / (t + 3) * (new - w)
    return w


def calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling with softened targets: slope (not negative) and offset of the log-odds."""
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * score + b)
        g = np.array([((target - p) * score).sum() - 1e-2 * (a - 1), (target - p).sum()])
        v = p * (1 - p)
        h = np.array([[(v * score * score).sum() + 1e-2, (v * score).sum()], [(v * score).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a + np.clip(step[0], -1, 1), b + np.clip(step[1], -2, 2)
    if a < 0:
        return 0.0, float(odds(np.array((good + 1) / (len(y) + 2))))
    return float(a), float(b)


def combine(a: np.ndarray, b: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float, float]:
    """Weights of two calibrated log-odds and an offset, fitted by Newton steps; pulled towards 1, 1 and less the prior.

    Views that are independent given the class would add up with these; where they aren't, or one is poor on some documents, the weights
    say so.
    """
    x = np.stack([a, b, np.ones(len(a))], 1)
    start = np.array([1.0, 1.0, -prior])
    w = start.copy()
    for _ in range(30):
        p = sigmoid(x @ w)
        slope = x.T @ (y - p) - PULL * (w - start)
        w = w + np.clip(np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + PULL * np.eye(3), slope), -1, 1)
    return float(w[0]), float(w[1]), float(w[2])


@dataclass
class CoTrained:
    """Weights of both views, their calibration and their combination; None weights keep every document."""

    content: np.ndarray | None
    meta: np.ndarray | None
    scale: tuple[tuple[float, float], tuple[float, float]] = ((1.0, 0.0), (1.0, 0.0))
    mixed: tuple[float, float, float] = (1.0, 1.0, 0.0)
    handed: tuple[int, int] = (0, 0)

    def scores(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probability of good quality by content, by metadata, and by both."""
        if self.content is None:
            one = np.ones(len(content))
            return one, one, one
        a = self.scale[0][0] * (content.astype(np.float64) @ self.content) + self.scale[0][1]
        b = self.scale[1][0] * (meta.astype(np.float64) @ self.meta) + self.scale[1][1]
        return sigmoid(a), sigmoid(b), sigmoid(self.mixed[0] * a + self.mixed[1] * b + self.mixed[2])

    @staticmethod
    def trained(content: np.ndarray, meta: np.ndarray, label: np.ndarray, pool: Pool | None = None, rounds: int = ROUNDS, sure: float = SURE, handed: int = HANDED) -> CoTrained:
        """Rows of both views of labelled documents, their labels 1 or 0, and the unlabelled documents.  Every fifth row only calibrates."""
        turn = np.arange(len(label)) % 5
        aside, base = np.flatnonzero(turn == 0), np.flatnonzero(turn)
        if len({*label[base].tolist()}) < 2 or not len(aside):
            return CoTrained(None, None)
        view = (content, meta)
        #: What each view was taught by the other: id -> its row and the pseudo-label.
        taught: list[dict[int, tuple[np.ndarray, int]]] = [{}, {}]
        weights = [np.zeros(0)] * 2
        for r in range(rounds + 1):
            for v in (0, 1):
                more = list(taught[v].values())
                x = np.concatenate([view[v][base], *(row[None, :] for row, _ in more)])
                weights[v] = fit(x, np.append(label[base], [value for _, value in more]))
            if r == rounds or pool is None:
                break
            # What a view is sure of is judged by its calibrated odds: a view that knows nothing hands nothing over.
            scale = [calibrate(view[v][aside] @ weights[v], label[aside]) for v in (0, 1)]
            known = [{*taught[1 - v]} for v in (0, 1)]
            for v, value, i, rows in pool.surest(weights, scale, known, sure, handed):
                taught[1 - v][i] = (rows[1 - v], value)
        scale = tuple(calibrate(view[v][aside] @ weights[v], label[aside]) for v in (0, 1))
        prior = float(odds(np.array((label.sum() + 1) / (len(label) + 2))))
        a, b = (scale[v][0] * (view[v][aside] @ weights[v]) + scale[v][1] for v in (0, 1))
        return CoTrained(weights[0], weights[1], scale, combine(a, b, label[aside], prior), (len(taught[0]), len(taught[1])))


class Pool:
    """Unlabelled documents as rows of both views, each known by its place."""

    def __init__(self, content: np.ndarray, meta: np.ndarray):
        self.view = (content, meta)

    def surest(self, weights, scale, known, sure: float, handed: int):
        """(view, label, id, rows of both views) of at most ``handed`` of each label of which a view is at least ``sure``, but those that are ``known`` from it."""
        for v in (0, 1):
            free = np.array([i for i in range(len(self.view[v])) if i not in known[v]], np.int64)
            p = sigmoid(scale[v][0] * (self.view[v][free] @ weights[v]) + scale[v][1])
            for value, surety in ((1, p), (0, 1 - p)):
                best = np.argsort(-surety, kind="stable")[:handed]
                for i in free[best[surety[best] >= sure]].tolist():
                    yield v, value, i, (self.view[0][i], self.view[1][i])


class TablePool(Pool):
    """All documents of a table that have no label.  A round scores every one of them; only the ids that are handed over, and their rows, come to the driver."""

    def __init__(self, docs: DataFrame, labels: DataFrame):
        self.docs, self.labelled = docs.where("doc_id is not null"), labels.select("doc_id").distinct()

    def surest(self, weights, scale, known, sure: float, handed: int):
        def score(batches):
            for b in pieces(batches):
                # Rounded, as the order of sums may differ between batches.
                p = [np.round(sigmoid(scale[v][0] * (x.astype(np.float64) @ weights[v]) + scale[v][1]), 9) for v, x in enumerate(views(b))]
                yield pa.RecordBatch.from_arrays([column(b, "doc_id"), *map(pa.array, p)], ["doc_id", "p0", "p1"])

        spark = self.docs.sparkSession
        found = written(self.docs.mapInArrow(score, f"doc_id {self.docs.schema['doc_id'].dataType.simpleString()}, p0 double, p1 double"), "scores")
        found = found.groupBy("doc_id").agg(F.min("p0").alias("p0"), F.min("p1").alias("p1"))
        free = written(found.join(self.labelled.hint("merge"), "doc_id", "left_anti").where(f"p0 >= {sure} or p1 >= {sure} or p0 <= {1 - sure} or p1 <= {1 - sure}"), "free")
        chosen: list[tuple[int, int, int]] = []
        for v in (0, 1):
            old = spark.createDataFrame([(i,) for i in known[v]], "doc_id long")
            own = free.join(F.broadcast(old), "doc_id", "left_anti")
            for value, surety in ((1, F.col(f"p{v}")), (0, 1 - F.col(f"p{v}"))):
                best = own.where(surety >= sure).orderBy(surety.desc(), F.xxhash64("doc_id"), "doc_id").limit(handed)
                chosen += [(v, value, r["doc_id"]) for r in best.select("doc_id").collect()]
        if not chosen:
            return
        ids = spark.createDataFrame([(i,) for i in {i for *_, i in chosen}], "doc_id long")
        rows = view_rows(self.docs.join(F.broadcast(ids), "doc_id", "left_semi"))
        for v, value, i in chosen:
            if i in rows:
                yield v, value, i, rows[i]


def view_rows(docs: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """doc_id -> rows of both views, for a few documents; of several rows of an id that with the least bytes."""
    def run(batches):
        for b in pieces(batches):
            parts = [pa.array([x.tobytes() for x in v], pa.binary()) for v in views(b)]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id").cast(pa.int64()), *parts], ["doc_id", "content", "meta"])

    found = docs.select("doc_id", *_COLUMNS).mapInArrow(run, "doc_id long, content binary, meta binary").groupBy("doc_id").agg(F.min(F.struct("content", "meta")).alias("r"))
    return {r["doc_id"]: (np.frombuffer(bytes(r["r"]["content"]), np.float32), np.frombuffer(bytes(r["r"]["meta"]), np.float32)) for r in found.collect()}


_COLUMNS = ("text", "lang", "source", "n_chars")


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> CoTrained:
    """Fit on at most ``labelled`` labelled documents, those whose ids have the least hashes, and on what the views hand over of all unlabelled ones.

    Null ids and labels are left out; an id with several labels has the least.
    """
    in_batches(docs.sparkSession)
    some = docs.select("doc_id", *_COLUMNS)
    known = written(sample(some, labels, labelled), "known")
    rows = view_rows(known)
    label = {r["doc_id"]: int(r["_label"] > 0) for r in known.groupBy("doc_id").agg(F.min("_label").alias("_label")).collect()}
    # In the order of the ids' hashes, so that rows set aside for calibration are spread evenly.
    ids = sorted(rows, key=lambda i: xxhash.xxh64_intdigest(str(i)))
    table = lambda k, size: np.array([rows[i][k] for i in ids], np.float32).reshape(-1, size)
    return CoTrained.trained(table(0, CONTENT_SIZE), table(1, META_SIZE), np.array([label[i] for i in ids], np.int64), TablePool(some, labels), rounds)


def scored(docs: DataFrame, model: CoTrained) -> DataFrame:
    """doc_id, p_content, p_meta, score and kept of every document.

    Nulls in any column are values of their own; empty texts are scored by what is left.  Repeated rows get equal scores; an empty
    table gives no rows; columns beyond doc_id, text, lang, source and n_chars are not read.  Without labels of both kinds all is kept.
    """
    in_batches(docs.sparkSession)

    def run(batches):
        for b in pieces(batches):
            parts = model.scores(*views(b))
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), *map(pa.array, parts), pa.array(parts[2] >= THRESHOLD)], ["doc_id", "p_content", "p_meta", "score", "kept"])

    d = docs.select("doc_id", *_COLUMNS)
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, p_content double, p_meta double, score double, kept boolean")


def keep(docs: DataFrame, model: CoTrained) -> DataFrame:
    """The rows of ``docs`` that :func:`scored` keeps, with all their columns; its docstring says what odd rows give."""
    in_batches(docs.sparkSession)

    def run(batches):
        for b in pieces(batches):
            yield b.filter(pa.array(model.scores(*views(b))[2] >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
