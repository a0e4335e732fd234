"""Quality of texts by a linear-chain conditional random field over their lines.

Every line with a word is a position labelled good or bad. Its features are bins of shares (capitals, symbols,
digits, repeated words, ...) of the line and of its neighbours. The field is fitted on a bounded sample of
labelled texts: lines start with their text's label, then lines of bad texts that the field finds clearly good
are relabelled and the field is fitted again. A text's quality is the mean of its lines' marginals by length,
from the forward-backward recursion, mapped to a probability by a logistic curve.

Texts are independent once the model is there; it has a fixed size and is broadcast. A task holds one slice of
texts.

Defined results: a null or empty text, or one without words, has quality 0 and that score; texts of any length
are read whole; repeated rows give repeated results; of several labels of a document the lowest counts; null
labels are left out; with labels of one kind only, every score is that kind's; other columns are dropped; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wardline.llm.common import Texts, free, hashed_words, mix, slices, tidy

TRAIN_ROWS = 10_000  # labelled rows that the model is fitted on, by hash of the id
TRAIN_LINES = 200  # texts with more lines are left out of the fit (not of the scores)
ROUNDS, STEPS, RATE = 3, 120, 0.2
RELABEL = 0.8  # marginal from which a line of a bad text counts as good
PENALTY = 1e-3
THRESHOLD = 0.3

BINS = 9  # the last stands for "no such line"
_UPPER, _DIGIT, _SYMBOL, _CRY, _POINT, _BLANK = (np.zeros(256, np.int32) for _ in range(6))
_UPPER[65:91] = 1
_DIGIT[48:58] = 1
_SYMBOL[list(b"#*$%&|<>~^=+@{}[]\\/_")] = 1
_CRY[list(b"!?")] = 1
_POINT[list(b".,;:'\"()-")] = 1
_BLANK[[32, *range(9, 14)]] = 1
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?:;\"')")] = True

SHARE = (0.001, 0.02, 0.05, 0.12, 0.3, 0.6, 0.9)
EDGES = {
    "length": (20, 40, 80, 160, 320, 640, 1280),
    "words": (2, 4, 8, 16, 32, 64, 128),
    "word_length": (2, 3, 4, 5, 6, 8, 12),
    "upper": SHARE,
    "symbols": SHARE,
    "cries": SHARE,
    "digits": SHARE,
    "points": (0.001, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3),
    "repeats": SHARE,
    "distinct": (0.1, 0.2, 0.35, 0.5, 0.7, 0.85, 0.97),
    "ends": (0.5,),
    "seen": (0.5,),
}
NAMES = list(EDGES)
AROUND = [NAMES.index(n) for n in ("length", "upper", "symbols", "cries", "repeats", "distinct", "seen")]
N_OWN = len(NAMES)
N_ALL = N_OWN + 2 * len(AROUND)
SIZE = N_ALL * BINS + 1  # and the intercept


class Lines(NamedTuple):
    bins: np.ndarray  # uint8, a row for each line with a word, a column for each of NAMES
    length: np.ndarray  # bytes
    first: np.ndarray  # text i has the lines first[i] to first[i + 1]


def lines_of(t: Texts) -> Lines:
    n = len(t.data)
    breaks = np.flatnonzero(t.data == 10) + 1
    start = np.union1d(breaks[breaks < n], t.off[:-1][t.off[:-1] < t.off[1:]]).astype(np.int64)
    if not len(start):
        return Lines(np.zeros((0, N_OWN), np.uint8), np.zeros(0, np.int64), np.zeros(len(t.off), np.int64))
    end = np.append(start[1:], n)
    w = hashed_words(t)
    per = lambda table: np.add.reduceat(table[t.data], start)
    first_word = np.searchsorted(w.start, start)
    words = np.diff(np.append(first_word, len(w.start)))
    full = words > 0
    length = end - start - per(_BLANK)
    line = np.repeat(np.arange(len(start)), words)
    again = np.zeros(len(line))
    if len(line) > 1:
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (line[1:] == line[:-1])
    repeats = np.bincount(line, again, len(start))
    keys = np.sort((line.astype(np.uint64) << np.uint64(40)) | (w.hash >> np.uint64(24)))
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    distinct = np.bincount((keys >> np.uint64(40)).astype(np.int64), fresh, len(start))
    letters = np.bincount(line, w.end - w.start, len(start))
    # equal lines of one text: words in order and the text make a line's hash
    row = np.searchsorted(t.off, start, side="right") - 1
    place = (np.arange(len(line)) - np.repeat(first_word, words)).astype(np.uint64)
    value = mix(w.hash + place * np.uint64(0x9E3779B97F4A7C15))
    sums = np.concatenate([[0], np.cumsum(value, dtype=np.uint64)]).astype(np.uint64)
    whole = mix(sums[first_word + words] - sums[first_word] + row.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    order = np.argsort(whole, kind="stable")
    seen = np.zeros(len(start), bool)
    seen[order[1:]] = whole[order[1:]] == whole[order[:-1]]
    # the last byte that is not blank
    solid = np.flatnonzero(_BLANK[t.data] == 0)
    at = np.searchsorted(solid, end) - 1
    tail = _ENDS[t.data[solid[np.maximum(at, 0)]]] if len(solid) else np.zeros(len(start), bool)
    size, count = np.maximum(length, 1), np.maximum(words, 1)
    values = {
        "length": length,
        "words": words,
        "word_length": letters / count,
        "upper": per(_UPPER) / size,
        "symbols": per(_SYMBOL) / size,
        "cries": per(_CRY) / size,
        "digits": per(_DIGIT) / size,
        "points": per(_POINT) / size,
        "repeats": repeats / count,
        "distinct": distinct / count,
        "ends": tail,
        "seen": seen,
    }
    bins = np.stack([np.searchsorted(EDGES[k], values[k], side="right") for k in NAMES], axis=1).astype(np.uint8)
    first = np.searchsorted(row[full], np.arange(len(t.off)))
    return Lines(bins[full], length[full], first)


def features(x: Lines) -> np.ndarray:
    """Indices of the weights of every line: its own bins and those of its neighbours in the same text."""
    n = len(x.bins)
    none = np.full((1, len(AROUND)), BINS - 1, np.uint8)
    before = np.concatenate([none, x.bins[:-1, AROUND]]) if n else np.zeros((0, len(AROUND)), np.uint8)
    after = np.concatenate([x.bins[1:, AROUND], none]) if n else before.copy()
    heads = x.first[:-1][x.first[:-1] < x.first[1:]]
    before[heads] = BINS - 1
    after[x.first[1:][x.first[:-1] < x.first[1:]] - 1] = BINS - 1
    bins = np.concatenate([x.bins, before, after], axis=1).astype(np.int32)
    return bins + np.arange(N_ALL, dtype=np.int32) * BINS


def messages(e: np.ndarray, first: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log ratios good : bad of every position; chains side by side."""
    a, b = e.copy(), np.zeros_like(e)
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
    for k in range(1, len(active)):
        at = begin[: active[k]] + k
        p = a[at - 1]
        a[at] += np.logaddexp(p + t[1, 1], t[0, 1]) - np.logaddexp(p + t[1, 0], t[0, 0])
    for k in range(len(active) - 2, -1, -1):
        at = begin[: active[k + 1]] + k
        f = e[at + 1] + b[at + 1]
        b[at] = np.logaddexp(f + t[1, 1], t[1, 0]) - np.logaddexp(f + t[0, 1], t[0, 0])
    return a, b


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Model(NamedTuple):
    weights: np.ndarray  # by feature index, the intercept last
    steps: np.ndarray  # [from, to], bad then good
    curve: np.ndarray  # of the logistic map: intercept, slopes

    def emissions(self, index: np.ndarray) -> np.ndarray:
        return self.weights[index].sum(axis=1) + self.weights[-1]

    def marginals(self, x: Lines) -> np.ndarray:
        e = self.emissions(features(x))
        a, b = messages(e, x.first, self.steps)
        return logistic(a + b)

    def qualities(self, x: Lines) -> np.ndarray:
        """Mean marginal of each text by length; 0 without lines."""
        total = np.concatenate([[0], np.cumsum(x.length)])
        good = np.concatenate([[0], np.cumsum(x.length * self.marginals(x))])
        size = total[x.first[1:]] - total[x.first[:-1]]
        return (good[x.first[1:]] - good[x.first[:-1]]) / np.maximum(size, 1)

    def scores(self, quality: np.ndarray) -> np.ndarray:
        return logistic(shape(quality) @ self.curve)


def shape(quality: np.ndarray) -> np.ndarray:
    q = np.clip(quality, 0.005, 0.995)
    return np.column_stack([np.ones(len(q)), q, np.log(q / (1 - q))])


def fit_field(x: Lines, label: np.ndarray, weight: np.ndarray, start: Model | None = None) -> Model:
    """Weights that make the lines' labels likeliest, by Adam on the whole sample."""
    index = features(x)
    rows = np.repeat(np.arange(len(index)), N_ALL)
    theta = np.zeros(SIZE + 4) if start is None else np.concatenate([start.weights, start.steps.ravel()])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    inner = np.ones(len(index), bool)
    inner[x.first[:-1][x.first[:-1] < x.first[1:]]] = False
    to = np.flatnonzero(inner)
    kinds = np.bincount(2 * label[to - 1] + label[to], weight[to], 4)
    total = weight.sum()
    for step in range(1, STEPS + 1):
        model = Model(theta[:SIZE], theta[SIZE:].reshape(2, 2), np.zeros(3))
        e = model.emissions(index)
        a, b = messages(e, x.first, model.steps)
        off = weight * (label - logistic(a + b))
        gradient = np.zeros_like(theta)
        gradient[: SIZE - 1] = np.bincount(index.ravel(), off[rows], SIZE - 1)
        gradient[SIZE - 1] = off.sum()
        f = e[to] + b[to]
        zero = np.zeros(len(to))
        pair = np.stack([zero, f, a[to - 1], a[to - 1] + f]) + model.steps.reshape(4, 1)
        pair = np.exp(pair - pair.max(axis=0, initial=-np.inf)) if len(to) else pair
        gradient[SIZE:] = kinds - (pair / pair.sum(axis=0) * weight[to]).sum(axis=1)
        gradient = gradient / total - PENALTY * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(theta[:SIZE], theta[SIZE:].reshape(2, 2), np.zeros(3))


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = logistic(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (y - p) - 0.1 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: Lines, quality: np.ndarray) -> Model:
    """The field and the curve for texts with these lines and labels 0 or 1."""
    good = np.repeat(quality, np.diff(x.first)).astype(np.int64)
    label, model = good.copy(), None
    # both kinds of texts weigh the same in all
    share = max(len(good) and good.mean(), 1e-6)
    weight = np.where(good == 1, 0.5 / share, 0.5 / max(1 - share, 1e-6))
    for _ in range(ROUNDS):
        model = fit_field(x, label, weight, model)
        p = model.marginals(x)
        label = np.where((good == 0) & (p < RELABEL), 0, 1)
        # a bad text keeps its worst line
        for r in np.flatnonzero((quality == 0) & (np.diff(x.first) > 0)):
            lo, hi = x.first[r], x.first[r + 1]
            label[lo + int(np.argmin(p[lo:hi]))] = 0
    return model._replace(curve=fit_curve(shape(model.qualities(x)), quality.astype(float)))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and quality of at most ``TRAIN_ROWS`` labelled documents outside the held-out fifth."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).dropna()
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "quality")


def _sampled_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        quality = batch.column(1).to_pylist()
        for t in slices(batch.column(0)):
            x = lines_of(t)
            rows = [i for i in range(t.hi - t.lo) if x.first[i + 1] - x.first[i] <= TRAIN_LINES]
            part = [slice(x.first[i], x.first[i + 1]) for i in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([quality[t.lo + i] for i in rows], pa.int32()),
                    pa.array([x.bins[s].tobytes() for s in part], pa.binary()),
                    pa.array([x.length[s].astype("<i8").tobytes() for s in part], pa.binary()),
                ],
                ["quality", "bins", "length"],
            )


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The driver holds a few bytes for each of at most ``TRAIN_ROWS * TRAIN_LINES`` lines."""
    rows = training_rows(docs, labels).mapInArrow(_sampled_lines, "quality int, bins binary, length binary")
    rows = sorted((r.quality, bytes(r.bins), bytes(r.length)) for r in rows.collect())
    bins = [np.frombuffer(b, np.uint8).reshape(-1, N_OWN) for _, b, _ in rows]
    quality = np.array([q for q, _, _ in rows], np.int64)
    if len(set(quality.tolist())) < 2:
        sure = 0.0 if not len(quality) else 4.0 if quality[0] else -4.0
        return Model(np.zeros(SIZE), np.zeros((2, 2)), np.array([sure, 0.0, 0.0]))
    length = np.concatenate([np.frombuffer(n, "<i8") for _, _, n in rows])
    first = np.concatenate([[0], np.cumsum([len(b) for b in bins])])
    return fit(Lines(np.concatenate(bins), length, first), quality)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, line-weighted quality and score of each document; the two get underscores if ``keep`` has them."""
    names = [free("quality", keep), free("score", keep)]
    rows = docs.select(*keep, F.col("text").alias(free("_text", keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            for t in slices(batch.column(len(keep))):
                quality = model.qualities(lines_of(t))
                kept = [batch.column(i).slice(t.lo, t.hi - t.lo) for i in range(len(keep))]
                found = [pa.array(quality), pa.array(model.scores(quality))]
                yield pa.RecordBatch.from_arrays([*kept, *found], [*keep, *names])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.mapInArrow(run, f"{kept}, {names[0]} double, {names[1]} double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels)).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.col("quality").alias("good_share"),
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with their columns."""
    scored = score(docs, train(docs, labels), tuple(docs.columns))
    return scored.where(F.col(free("score", docs.columns)) >= THRESHOLD).select(*docs.columns)
