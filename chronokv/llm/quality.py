"""Quality rules: counts over each text, and a line model that tells content from boilerplate.

A linear-chain conditional random field labels the lines that have a word; Viterbi decoding finds the best sequence and
the share of words in content lines decides.  The field is trained here, on lines of a bounded sample of labelled documents.  Labels
belong to documents, so lines get theirs by expectation and maximisation: a model of single lines, then the field itself, says
which lines are content, under the constraint that a document's label holds for more than half of its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, column, in_batches, mix, pieces, windows, written

#: Labelled documents that training reads at most.
TRAIN_DOCS = 1000
#: Share of a text's words that must stand in content lines.
CONTENT_SHARE = 0.5
#: Steps of each round, after which the field's own beliefs become its targets, and the share of switches of each kind that is taken as seen.
EM_STEPS, SWITCHES = (60, 30, 30), 0.01
MIN_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5
SYMBOLS = b"#*$%&|<>"
FEATURES = 24
BOILERPLATE, CONTENT = 0, 1


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _UPPER, _BANG, _BAR, _DIGIT, _STOP = map(_class, (SYMBOLS, bytes(range(65, 91)), b"!", b"|", b"0123456789", b".!?"))
_HIGH = np.arange(256) >= 128


class Lines:
    """The lines of a slice of texts, split at line feeds, and what the rules count."""

    def __init__(self, text: pa.Array):
        w = self.words = Words(text)
        raw, bounds = w.raw, w.bounds
        feed = np.flatnonzero(raw == 10)
        feed_doc = np.searchsorted(bounds, feed, side="right") - 1
        docs = np.arange(w.docs)
        doc = np.concatenate([docs, feed_doc])
        by = np.lexsort((np.concatenate([bounds[:-1], feed + 1]), doc))
        self.doc, self.start = doc[by], np.concatenate([bounds[:-1], feed + 1])[by]
        self.end = np.concatenate([bounds[1:], feed])[np.lexsort((np.concatenate([bounds[1:], feed]), doc))]
        line_of = np.searchsorted(self.start, w.start, side="right") - 1
        count = np.bincount(line_of, minlength=len(self.start))
        self.hash = w.hashes()
        #: Only lines with a word count from here on.
        some = np.flatnonzero(count)
        self.doc, self.start, self.end, self.count = self.doc[some], self.start[some], self.end[some], count[some]
        flat = raw.tobytes()
        seen: set[tuple[int, bytes]] = set()
        self.again = np.zeros(len(some), bool)
        for i, (d, a, b) in enumerate(zip(self.doc.tolist(), self.start.tolist(), self.end.tolist(), strict=True)):
            line = (d, flat[a:b])
            if line in seen:
                self.again[i] = True
            seen.add(line)
        self.n = np.bincount(self.doc, minlength=w.docs)
        self.first_word = np.concatenate([[0], np.cumsum(self.count)[:-1]]) if len(some) else some

    def counts(self) -> dict[str, np.ndarray]:
        """The base columns for each text."""
        w = self.words
        starts = (w.raw & 0xC0) != 0x80  # one byte of each code point
        h, at = windows(self.hash, w.doc, REPEAT_WINDOW)
        own = mix(h + w.doc[at].astype(U64) * U64(0x9E3779B97F4A7C15))
        _, back, times = np.unique(own, return_inverse=True, return_counts=True)
        twice = at[times[back] > 1]
        steps = np.zeros(len(w.start) + 1, np.int64)
        np.add.at(steps, twice, 1)
        np.add.at(steps, twice + REPEAT_WINDOW, -1)
        repeat = np.bincount(w.doc[np.cumsum(steps[:-1]) > 0], minlength=w.docs).astype(np.int64)
        return {
            "n_words": w.n,
            "word_chars": w.per_doc(starts & w.inside),
            "n_symbols": w.per_doc(_SYMBOL[w.raw]),
            "n_dup_lines": np.bincount(self.doc[self.again], minlength=w.docs).astype(np.int64),
            "n_repeat_words": repeat,
            "base_failed": (w.n < MIN_WORDS) | (100 * repeat > REPEAT_PERCENT * w.n),
        }

    def features(self) -> np.ndarray:
        """A row for each line: shares of kinds of characters and of repeats, and the shape of the line."""
        w = self.words
        def share(marks: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
            return (total[self.end] - total[self.start]).astype(np.float64)

        size = np.maximum(share(w.inside), 1)
        n = self.count.astype(np.float64)
        same = np.zeros(len(self.hash), bool)
        same[1:] = (self.hash[1:] == self.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        repeats = np.add.reduceat(same.astype(np.int64), self.first_word) / n if len(n) else n
        symbol, upper, bang, bar, digit = (share(c[w.raw]) for c in (_SYMBOL, _UPPER, _BANG, _BAR, _DIGIT))
        stop = share(_STOP[w.raw])
        last = w.end[self.first_word + self.count - 1] - 1 if len(n) else np.zeros(0, np.int64)
        length = size / n
        x = np.stack(
            [
                np.ones(len(n)), np.minimum(symbol / n, 1), symbol / n > 0.2, symbol / n > 0.6, upper / size, upper / size > 0.3, upper / size > 0.6,
                np.minimum(bang / n, 1), bang / n > 0.3, np.minimum(bar / n, 1), bar / n > 0.2, digit / size, digit / size > 0.3,
                repeats, repeats > 0.2, repeats > 0.5, self.again, np.log2(n + 1) / 10, n < 3, n < 8, length < 2.5, length > 12,
                np.minimum(stop / n, 1), _STOP[w.raw[last]],
            ],
            axis=1,
        )
        return x.astype(np.float32)


class LineField:
    """A linear-chain conditional random field with two labels."""

    def __init__(self, emit: np.ndarray, move: np.ndarray, begin: np.ndarray):
        self.emit, self.move, self.begin = emit, move, begin

    @staticmethod
    def neutral() -> LineField:
        """Calls every line content: for want of labels of both kinds."""
        emit = np.zeros((FEATURES, 2))
        emit[0, CONTENT] = 1
        return LineField(emit, np.zeros((2, 2)), np.zeros(2))

    def decode(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The likeliest labels of the lines of several documents of n lines each, by Viterbi; all documents step together.

        At a tie the line is content.
        """
        score = x @ self.emit
        first = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
        label = np.zeros(len(x), np.int8)
        by = np.argsort(-n, kind="stable")
        first, n = first[by], n[by]
        live = np.searchsorted(-n, -np.arange(n[0] if len(n) else 0), side="left")  # documents with more than t lines
        came = np.zeros((len(x), 2), np.int8)
        best = np.zeros((len(n), 2))
        for t, k in enumerate(live.tolist()):
            at = first[:k] + t
            if t:
                ways = best[:k, :, None] + self.move
                step = (ways[:, CONTENT] >= ways[:, BOILERPLATE]).astype(np.int8)
                came[at] = step
                best[:k] = np.maximum(ways[:, 0], ways[:, 1]) + score[at]
            else:
                best[:k] = self.begin + score[at]
        now = (best[:, CONTENT] >= best[:, BOILERPLATE]).astype(np.int8)
        for t in range(len(live) - 1, -1, -1):
            k = live[t]
            at = first[:k] + t
            label[at] = now[:k]
            now[:k] = came[at, now[:k]]
        return label

    @staticmethod
    def trained(docs: list[tuple[np.ndarray, np.ndarray, int]], rounds: tuple[int, ...] = EM_STEPS) -> LineField:
        """Fit on documents, each its lines' features, their words and one label for all of them.

        The lines' first targets come from a model of single lines that knows the documents' labels alone; from then on the field's own
        beliefs are the targets, so it learns from switches between content and boilerplate within documents.  ``rounds`` has the steps of each round.
        """
        docs = sorted((d for d in docs if len(d[0])), key=lambda d: -len(d[0]))
        if len({label for *_, label in docs}) < 2:
            return LineField.neutral()
        n = np.array([len(x) for x, *_ in docs])
        x = np.concatenate([x for x, *_ in docs]).astype(np.float64)
        words = np.concatenate([w for _, w, _ in docs]).astype(np.int64)
        label = np.array([label for *_, label in docs])
        doc = np.repeat(np.arange(len(n)), n)
        alone = _lines_alone(x, label[doc], doc, n)
        # First lines of all documents, then second lines and so on: a step of the passes is a slice.
        at = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
        order = np.lexsort((doc, at))
        live = np.searchsorted(-n, -np.arange(n[0]), side="left")
        x, words, doc = x[order], words[order], doc[order]
        target = _constrained(alone[order], words, doc, label)
        field = LineField(np.zeros((FEATURES, 2)), np.zeros((2, 2)), np.zeros(2))
        for steps in rounds:
            belief = field._fit(x, live, target, steps)
            target = _constrained(np.log(belief[:, CONTENT] + 1e-300) - np.log(belief[:, BOILERPLATE] + 1e-300), words, doc, label)
        return field

    def _beliefs(self, x: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of each line's labels, and the expected number of each pair of neighbouring labels; line t of the documents is a slice of ``live[t]`` rows.

        Forward and backward passes over probabilities, each line's scaled to a sum of one.
        """
        score = x @ self.emit
        e = np.exp(score - score.max(axis=1, keepdims=True))
        move = np.exp(self.move - self.move.max())
        ends = np.cumsum(live).tolist()
        begins = [0, *ends[:-1]]
        ahead = np.empty_like(e)
        now = e[: ends[0]] * np.exp(self.begin - self.begin.max())
        ahead[: ends[0]] = now = now / now.sum(axis=1, keepdims=True)
        for lo, hi in zip(begins[1:], ends[1:], strict=True):
            now = (now[: hi - lo] @ move) * e[lo:hi]
            now /= now.sum(axis=1, keepdims=True)
            ahead[lo:hi] = now
        back = np.ones_like(e)
        pairs = np.zeros((2, 2))
        for t in range(len(ends) - 1, 0, -1):
            lo, hi, before = begins[t], ends[t], begins[t - 1]
            ready = e[lo:hi] * back[lo:hi]
            step = ready @ move.T
            scale = (ahead[before : before + hi - lo] * step).sum(axis=1, keepdims=True)
            pairs += (ahead[before : before + hi - lo] / scale).T @ ready
            back[before : before + hi - lo] = step / step.sum(axis=1, keepdims=True)
        belief = ahead * back
        return belief / belief.sum(axis=1, keepdims=True), pairs * move

    def _fit(self, x: np.ndarray, live: np.ndarray, target: np.ndarray, steps: int, rate: float = 0.3, decay: float = 1e-3) -> np.ndarray:
        """Gradient ascent from where the field stands on the mean log-likelihood of the lines' targets; the beliefs at its end."""
        total, docs = len(x), int(live[0])
        truth = np.eye(2)[target]
        begins = np.concatenate([[0], np.cumsum(live)[:-1]])
        after = np.arange(docs, total)
        prior = after - np.repeat(begins[1:] - begins[:-1], live[1:])
        # A few switches of each kind are taken as seen, so that a sample without any doesn't rule them out.
        seen = np.full((2, 2), SWITCHES * max(len(after), 1))
        np.add.at(seen, (target[prior], target[after]), 1)
        seen *= len(after) / seen.sum()
        starts = np.bincount(target[:docs], minlength=2).astype(float)
        speed = [np.zeros_like(p) for p in (self.emit, self.move, self.begin)]
        for _ in range(steps):
            belief, pairs = self._beliefs(x, live)
            slopes = (x.T @ (truth - belief) / total, (seen - pairs) / total, (starts - belief[:docs].sum(axis=0)) / docs)
            for i, (p, g) in enumerate(zip((self.emit, self.move, self.begin), slopes, strict=True)):
                speed[i] = 0.9 * speed[i] + g - decay * p
                p += rate * speed[i]
        return self._beliefs(x, live)[0]


def _lines_alone(x: np.ndarray, label: np.ndarray, doc: np.ndarray, n: np.ndarray, steps: int = 200, decay: float = 1e-3) -> np.ndarray:
    """Log-odds of content of each line by itself: logistic regression on the documents' labels, in which every document weighs the same."""
    weight = 1.0 / n[doc]
    weight /= weight.sum()
    rate = 4 / (weight @ np.square(x).sum(1) + decay)
    w = ahead = np.zeros(x.shape[1])
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -40, 40)))
        new = ahead + rate * (x.T @ (weight * (label - p)) - decay * ahead)
        w, ahead = new, new + t / (t + 3) * (new - w)
    return x @ w


def _constrained(odds: np.ndarray, words: np.ndarray, doc: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The likelier label of each line, changed where needed so that over half of a document's words bear its label.

    Of a document that breaks the rule, lines of the best odds for its label take it, as many as it needs.  ``doc`` is in any order.
    """
    out = (odds >= 0).astype(np.int64)
    own = label[doc]
    total = np.bincount(doc, weights=words, minlength=len(label))
    by = np.lexsort((np.where(own == CONTENT, -odds, odds), doc))
    before = np.cumsum(words[by]) - words[by]
    base = np.concatenate([[0], np.cumsum(total)[:-1]])
    # Lines in this order take the label until over half of the words have it.
    needed = 2 * (before - base[doc[by]]) <= total[doc[by]]
    out[by[needed]] = own[by[needed]]
    return out


def sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Rows of ``docs`` with ``_label``, for at most ``most`` labelled ids that ``docs`` has: those of the least hashes, so that every run takes the same.

    Good and poor ids are drawn each for themselves, in their shares; the rarer kind gets a hundredth of the places at least, if it has so many.
    An id with several labels has the least; null ids and labels are left out.  The chosen ids are few, so they are sent to all tasks.
    """
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_label"))
    one = written(one.join(docs.select("doc_id").hint("merge"), "doc_id", "left_semi"), "labelled")
    n = {r["good"]: r["count"] for r in one.groupBy((F.col("_label") > 0).alias("good")).count().collect()}
    rare = min((True, False), key=lambda k: n.get(k, 0))
    few = min(n.get(rare, 0), max(most * n.get(rare, 0) // max(sum(n.values()), 1), most // 100))
    draw = lambda good, k: one.where((F.col("_label") > 0) == F.lit(good)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(k)
    return docs.join(F.broadcast(draw(rare, few).union(draw(not rare, most - few))), "doc_id")


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, text: str = "text") -> LineField:
    """A field fitted on the lines of at most ``most`` labelled documents."""
    in_batches(docs.sparkSession)
    rows = sample(docs.select("doc_id", F.col(text).alias("text")), labels, most)

    def run(batches):
        for b in pieces(batches):
            lines = Lines(column(b, "text"))
            x = np.concatenate([lines.features(), lines.count[:, None].astype(np.float32)], axis=1)
            parts = np.split(x, np.cumsum(lines.n)[:-1])
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, "_label").cast(pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["doc_id", "label", "lines"])

    found = rows.mapInArrow(run, "doc_id long, label int, lines binary").groupBy("doc_id").agg(F.min(F.struct("label", "lines")).alias("r"))
    data = sorted((r["doc_id"], r["r"]["label"], bytes(r["r"]["lines"])) for r in found.collect())
    tables = [(np.frombuffer(x, np.float32).reshape(-1, FEATURES + 1), int(label > 0)) for _, label, x in data]
    return LineField.trained([(x[:, :FEATURES], x[:, FEATURES], label) for x, label in tables])


def verdicts(text: pa.Array, field: LineField, share: float = CONTENT_SHARE) -> dict[str, np.ndarray]:
    """All columns of :func:`judged` but the id, for an Arrow column of texts."""
    lines = Lines(text)
    out = lines.counts()
    label = field.decode(lines.features(), lines.n)
    content = np.bincount(lines.doc, weights=lines.count * (label == CONTENT), minlength=lines.words.docs).astype(np.int64)
    out["n_lines"] = lines.n.astype(np.int64)
    out["n_content_words"] = content
    out["kept"] = ~out["base_failed"] & (content >= share * out["n_words"])
    return out


_KINDS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "n_lines": "long", "n_content_words": "long", "kept": "boolean"}


def judged(docs: DataFrame, field: LineField, text: str = "text") -> DataFrame:
    """doc_id, the base counts, the field's counts, base_failed and kept, for every document.

    Null and empty texts have no words and fail.  Null ids and repeated rows are judged like any other; an empty table gives no
    rows; other columns are not read.
    """
    in_batches(docs.sparkSession)
    d = docs.select("doc_id", F.col(text).alias("text"))

    def run(batches):
        for b in pieces(batches):
            found = verdicts(column(b, "text"), field)
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), *(pa.array(found[k]) for k in _KINDS)], ["doc_id", *_KINDS])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{k} {t}" for k, t in _KINDS.items()))


def keep(docs: DataFrame, field: LineField, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`judged` keeps, with all their columns; its docstring says what odd rows give.

    Rows with a null or empty text go; null ids, repeated rows and nulls in other columns don't matter; an empty table stays empty.
    """
    in_batches(docs.sparkSession)

    def run(batches):
        for b in pieces(batches, text):
            yield b.filter(pa.array(verdicts(column(b, text), field)["kept"]))

    return docs.mapInArrow(run, docs.schema)
