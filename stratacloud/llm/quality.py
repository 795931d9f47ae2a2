"""Quality classifier: Naive Bayes support vectors over n-gram indicators.

Features are indicators, hashed to a fixed number of columns: words, n-grams of word shapes
(which kinds of characters a word has), and n-grams of which words repeat their
predecessors.  Indicators are scaled by the log-count ratio of the two classes, rows to unit
length, and a linear hinge-loss model is fitted by dual coordinate descent (Wang and
Manning, 2012; Hsieh et al., 2008).  A logistic curve fitted on held-back training rows turns
margins into scores.  The model is two arrays of `COLUMNS` numbers, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacloud.llm._common import cut, drop_cut, text_or_empty
from stratacloud.llm._text import Words, frugal, hash_words, mix64, string_slices

COLUMNS = 1 << 18
#: The model learns from at most so many labelled rows, those of the smallest id hashes, and
#: of these from texts of at most so many characters: that bounds what reaches the driver.
TRAIN_ROWS = 6000
TRAIN_CHARS = 40_000
#: The rows taken bring at most so many indicators in all, 4 bytes each to the driver and 20 while fitting.
TRAIN_INDICATORS = 1 << 22
HELD_OUT_FOLDS = 5
THRESHOLD = 0.3


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True where crc32 of the id as text leaves no remainder by five; such rows are never learnt from."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string")) % HELD_OUT_FOLDS == 0, F.lit(False))


def _kinds() -> np.ndarray:
    """A bit for each kind of character."""
    groups = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",", "!", "?:;", "$%#&*@^~", "|", "<>{}[]\\/=_", "'\"`()-+"]
    kinds = np.zeros(256, np.uint64)
    for bit, group in enumerate(groups):
        kinds[list(group.encode())] = 1 << bit
    kinds[128:] = 1 << len(groups)
    return kinds


_KINDS = _kinds()


def _columns(words: Words) -> tuple[list[np.ndarray], np.ndarray]:
    """For each n-gram kind, a column for each word position; the words a position needs before it."""
    n = len(words.hashes)
    shape = np.bitwise_or.reduceat(_KINDS[words.data], words.starts) if n else np.zeros(0, np.uint64)
    first_upper = (words.data[words.starts] >= 65) & (words.data[words.starts] <= 90) if n else np.zeros(0, bool)
    shape = mix64(shape * np.uint64(2) + first_upper.astype(np.uint64) + np.uint64(1))
    same = np.zeros(n, np.uint64)
    same[1:] = words.hashes[1:] == words.hashes[:-1]

    def after(x: np.ndarray, by: int) -> np.ndarray:
        return np.concatenate((np.zeros(min(by, n), np.uint64), x[: max(0, n - by)]))

    with np.errstate(over="ignore"):
        two = mix64(shape * np.uint64(3) + after(shape, 1) + np.uint64(2))
        three = mix64(two * np.uint64(5) + after(shape, 2) + np.uint64(3))
        runs = mix64(same + np.uint64(2) * after(same, 1) + np.uint64(4) * after(same, 2) + np.uint64(99))
        grams = [words.hashes, shape, two, three, runs]
    return [(g >> np.uint64(46)).astype(np.int64) for g in grams], np.array([0, 0, 1, 2, 3])


class Indicators:
    """Distinct columns of each text, found with a scratch array instead of sorting."""

    def __init__(self) -> None:
        self.last = np.zeros(COLUMNS, np.int64)

    def of(self, column: pa.Array) -> Iterator[np.ndarray]:
        for _, data, offsets in string_slices(column):
            words = hash_words(data, offsets, lower=True)
            grams, needs = _columns(words)
            for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
                yield self.distinct(np.concatenate([g[min(b, a + k) : b] for g, k in zip(grams, needs.tolist())]))

    def distinct(self, found: np.ndarray) -> np.ndarray:
        place = np.arange(len(found))
        self.last[found] = place
        return found[self.last[found] == place]


@dataclass
class Model:
    """Score = logistic(slope * margin + shift); margin = sum(weight) / sqrt(sum(square)) over a text's columns, plus bias."""

    weight: np.ndarray
    square: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, columns: np.ndarray) -> float:
        length = float(self.square[columns].sum())
        return self.bias + (float(self.weight[columns].sum()) / length**0.5 if length > 0 else 0.0)

    def score(self, columns: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(columns) + self.shift, -500, 500))))


def log_count_ratio(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    counts = [np.full(COLUMNS, alpha), np.full(COLUMNS, alpha)]
    for columns, label in zip(rows, labels.tolist()):
        counts[label][columns] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, cost: np.ndarray, epochs: int = 20, tolerance: float = 1e-3) -> np.ndarray:
    """Weights of min |w|^2 / 2 + sum(cost * hinge); rows are index arrays with their values."""
    rng = np.random.default_rng(0)
    w, alpha = np.zeros(COLUMNS + 1), np.zeros(len(rows))
    norms = np.array([float(v @ v) for v in values])
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)).tolist():
            if norms[i] <= 0:
                continue
            x, v, y = rows[i], values[i], signs[i]
            gradient = y * float(w[x] @ v) - 1
            old = alpha[i]
            projected = min(gradient, 0) if old == 0 else max(gradient, 0) if old == cost[i] else gradient
            if projected:
                worst = max(worst, abs(projected))
                alpha[i] = min(max(old - gradient / norms[i], 0.0), cost[i])
                w[x] += (alpha[i] - old) * y * v
        if worst < tolerance:
            break
    return w


def _svm(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0) -> Model:
    ratio = log_count_ratio(rows, labels)
    square = ratio**2
    x = [np.append(r, np.int32(COLUMNS)) for r in rows]  # the last column is the bias
    v = [np.append(ratio[r] / max(float(square[r].sum()) ** 0.5, 1e-12), 1.0) for r in rows]
    share = np.bincount(labels, minlength=2) / len(labels)
    w = dual_coordinate_descent(x, v, 2.0 * labels - 1, cost * np.where(labels == 1, 0.5 / share[1], 0.5 / share[0]) * 4)
    return Model((w[:-1] * ratio).astype(np.float32), square.astype(np.float32), float(w[-1]))


def _curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve, by Newton's method with Platt's smoothed targets."""
    ones, zeros = int(labels.sum()), int((1 - labels).sum())
    goal = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    theta = np.array([1.0, 0.0])
    x = np.stack((margins, np.ones_like(margins)), axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - goal) + 1e-3 * (theta - [1.0, 0.0]))
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(theta[0]), 1e-3), float(theta[1])


def fit_rows(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """Model of labelled rows; with rows of one class or none every score is 1, 0 or 0.5."""
    if len(set(labels.tolist())) < 2:
        shift = 0.0 if not len(labels) else 40.0 if labels[0] else -40.0
        return Model(np.zeros(COLUMNS, np.float32), np.zeros(COLUMNS, np.float32), shift=shift)
    model = _svm(rows, labels)
    back = np.arange(len(rows)) % 4 == 0
    fit, check = np.flatnonzero(~back), np.flatnonzero(back)
    if len(set(labels[fit].tolist())) == 2 and len(set(labels[check].tolist())) == 2:
        part = _svm([rows[i] for i in fit], labels[fit])
        model.slope, model.shift = _curve(np.array([part.margin(rows[i]) for i in check]), labels[check])
    return model


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """Model of docs(doc_id, text) and labels(doc_id, target): 1 is good, null labels are left out.

    Rows that held_out() marks are never used; of several labels of a document the smallest holds, and
    of several texts that comes first by code point.  Rows count in the order of the hash of their id,
    as far as the bounds on rows and indicators go.
    """
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(target).alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # at most `rows` rows of two numbers

    def indicators(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Indicators()
        for batch in batches:
            columns = [pa.array(x.astype(np.int32)) for x in found.of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([x.tolist() for x in columns], pa.list_(pa.int32()))], names=["doc_id", "label", "columns"])

    chosen = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= TRAIN_CHARS).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    chosen = chosen.join(F.broadcast(sample.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))), "doc_id")
    single = chosen.groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # at most `rows` texts
    counted = cut(single.mapInArrow(frugal(indicators), "doc_id long, label int, columns array<int>"), "indicators")
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    within = counted.select("doc_id", F.sum(F.size("columns")).over(order).alias("upto")).where(F.col("upto") <= TRAIN_INDICATORS).select("doc_id")
    learnt = counted.join(F.broadcast(within), "doc_id").toArrow()
    drop_cut(counted)
    if not learnt.num_rows:
        return fit_rows([], np.zeros(0, np.int64))
    found = learnt.column("columns").combine_chunks()
    order = np.argsort(learnt.column("doc_id").to_numpy())
    return fit_rows([found[int(i)].values.to_numpy() for i in order], learnt.column("label").to_numpy()[order])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text) with held_out, score (0 to 1) and predicted.

    Every whole text is scored from its characters alone; null and empty texts, which have no
    indicators, get the score of the bias.  Repeated rows are scored each; an empty table
    gives an empty result; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Indicators()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([held.value.score(x) for x in found.of(batch.column("text"))], pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(frugal(run), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Indicators()
        for batch in batches:
            yield batch.filter(pa.array([held.value.score(x) >= threshold for x in found.of(batch.column(text))], pa.bool_()))

    return docs.mapInArrow(frugal(run), docs.schema)
