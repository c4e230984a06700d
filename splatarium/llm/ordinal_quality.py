"""Operator 4: ordinal cumulative-link regression on graded ratings.

Grades 0 < 1 < 2 come from the labels: toxic, then low quality, then good. The
model has one weight vector over hashed text features, shared by all grades, and
ordered thresholds: P(grade <= k) = sigmoid(threshold_k - w x). It gives every
document its expected grade and the probability of the top grade, by which
documents are selected.

Features are the distinct words of the whole text (runs of ASCII letters and
digits or other characters, lower case) and their first four bytes, hashed to
2^18 places, and a few classes of shares: symbols, upper case, repeated words,
length. A text's word features are scaled by the fourth root of their number.

The fit takes a bounded sample of the labelled rows, `SAMPLE` of them in the
order of a hash of doc_id; the model itself has a fixed size, so it can be sent
to every task. Scoring reads every document once, without a shuffle.

Defined cases: a null text is empty and has only share features; a document
without label is scored as any other; labels that are null count as 0 for toxic
and as 1 for quality; a label whose document is missing is not used, and of documents
that share its id one is taken, by a hash of the text; without any labelled document, or with one grade only, all documents are of the top grade.
Repeated rows are scored alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

BITS = 18
SAMPLE = 20_000
GRADES = 3
#: Bytes of a stem; words' values are divided by this power of their number.
STEM, SCALE = 4, 0.25
#: Share features follow the hashed ones: five kinds with ten classes each.
KINDS, CLASSES = 5, 10
SIZE = (1 << BITS) + KINDS * CLASSES

_WORDLIKE = np.zeros(256, bool)
_WORDLIKE[48:58] = _WORDLIKE[65:91] = _WORDLIKE[97:123] = _WORDLIKE[128:] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"#*$%&|<>{}[]=_^~!?")] = True


@dataclass(frozen=True)
class Fit:
    steps: int = 400
    rate: float = 0.1
    ridge: float = 5e-5
    #: It ends when the last so many steps gained less than this share.
    patience: int = 25
    least_gain: float = 1e-3
    #: A word has to stand in so many sampled documents to get a weight.
    least_documents: int = 3


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, value, number of features in each row) of a slice."""
    n = len(off) - 1
    word = _WORDLIKE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    cut = np.ones(len(buf) + 1, bool)
    if len(buf):
        cut[1:-1] = ~word[:-1] | ~word[1:]
    cut |= edge
    start, end = np.flatnonzero(word & cut[:-1]), np.flatnonzero(word & cut[1:]) + 1
    words = np.diff(np.searchsorted(start, off))
    row = np.repeat(np.arange(n), words)
    low = c.LOWER[buf]
    place = c.span_hashes(low, start, end) if len(start) else np.zeros(0, np.uint64)
    long = np.flatnonzero(end - start > STEM)
    stem = c.mix(c.span_hashes(low, start[long], start[long] + STEM) + np.uint64(1)) if len(long) else place[:0]
    seen = np.unique(np.concatenate([row, row[long]]) << BITS | (np.concatenate([place, stem]) >> np.uint64(64 - BITS)).astype(np.int64))
    row, place = seen >> BITS, seen & ((1 << BITS) - 1)
    distinct = np.bincount(row, minlength=n)
    value = (1 / np.maximum(distinct, 1) ** SCALE)[row]
    size = np.maximum(np.diff(off), 1)
    share = lambda flags: c.per_row(c.running(flags), off) / size
    letters = np.maximum(c.per_row(c.running(word), off), 1)
    level = lambda x: np.clip((x * CLASSES).astype(np.int64), 0, CLASSES - 1)
    kinds = [
        level(np.sqrt(share(_MARK[buf])) * 1.5), level(c.per_row(c.running((buf >= 65) & (buf < 91)), off) / letters), level(distinct / np.maximum(2 * words, 1)),
        np.clip(np.log2(size).astype(np.int64) // 2, 0, CLASSES - 1), level(np.sqrt(share(buf == 124)) * 3),
    ]
    extra = np.stack([(1 << BITS) + k * CLASSES + x for k, x in enumerate(kinds)], axis=1)
    counts = distinct + KINDS
    where = np.cumsum(counts) - counts
    feature, values = np.zeros(int(counts.sum()), np.int64), np.ones(int(counts.sum()))
    spot = np.arange(len(row)) + row * KINDS
    feature[spot], values[spot] = place, value
    feature[(where + distinct)[:, None] + np.arange(KINDS)] = extra
    return feature, values, counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Likelihood:
    """The mean negative log likelihood of graded rows, with a ridge, and its gradient.

    Parameters are the weights of the features that stand in enough rows, then the
    first threshold and the logarithms of the gaps, so thresholds stay in order.
    Grades weigh inversely to the root of how often they occur.
    """

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, how: Fit):
        counts = np.array([len(f) for f, _ in rows])
        place, value = np.concatenate([f for f, _ in rows]), np.concatenate([v for _, v in rows])
        row = np.repeat(np.arange(len(rows)), counts)
        often = np.bincount(place, minlength=SIZE) >= how.least_documents
        self.row, place, self.value = row[often[place]], place[often[place]], value[often[place]]
        self.used, self.at = np.unique(place, return_inverse=True)
        self.grades, self.ridge, self.n = grades, how.ridge, len(rows)
        share = np.bincount(grades, minlength=GRADES) / len(grades)
        weight = 1 / np.sqrt(np.maximum(share, 1e-9))[grades]
        self.weight = weight / weight.sum()

    def start(self) -> np.ndarray:
        return np.concatenate([np.zeros(len(self.used)), [-1.0, 0.0]])

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weights, thresholds)."""
        k = len(self.used)
        return x[:k], np.concatenate([[x[k]], x[k] + np.cumsum(np.exp(x[k + 1 :]))])

    def __call__(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        w, theta = self.split(x)
        grades, weight, k = self.grades, self.weight, len(w)
        score = np.bincount(self.row, self.value * w[self.at], self.n)
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        upper = np.where(grades == GRADES - 1, 1.0, _sigmoid(edges[grades + 1] - score))
        lower = np.where(grades == 0, 0.0, _sigmoid(edges[grades] - score))
        p = np.maximum(upper - lower, 1e-12)
        up, down = upper * (1 - upper) / p, lower * (1 - lower) / p
        d_theta = np.array([np.sum(weight * (down * (grades - 1 == j) - up * (grades == j))) for j in range(GRADES - 1)])
        grad = np.empty_like(x)
        grad[:k] = np.bincount(self.at, self.value * (weight * (up - down))[self.row], k) + self.ridge * w
        grad[k] = d_theta.sum()
        grad[k + 1 :] = d_theta[::-1].cumsum()[::-1][1:] * np.exp(x[k + 1 :])
        return float(-np.sum(weight * np.log(p)) + self.ridge / 2 * w @ w), grad


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, how: Fit = Fit()) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by Adam, until the likelihood hardly changes any more."""
    likelihood = Likelihood(rows, grades, how)
    x = likelihood.start()
    m, v, losses = np.zeros_like(x), np.zeros_like(x), []
    for step in range(1, how.steps + 1):
        loss, grad = likelihood(x)
        losses.append(loss)
        if step > how.patience and losses[-1 - how.patience] - loss < how.least_gain * abs(loss):
            break
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        x = x - how.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w, theta = likelihood.split(x)
    weights = np.zeros(SIZE)
    weights[likelihood.used] = w
    return weights, theta


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, how: Fit = Fit()) -> tuple[np.ndarray, np.ndarray]:
    """Fits on at most `sample` labelled rows of (doc_id, text) and
    (doc_id, quality, toxic). Features are made where the documents are; one task
    fits, on the bounded sample; the driver gets the model, of fixed size."""
    grade = F.when(F.coalesce("toxic", F.lit(0)) > 0, 0).when(F.coalesce("quality", F.lit(1)) == 0, 1).otherwise(2)
    some = labels.select(F.col("doc_id").alias("of"), grade.alias("grade")).dropna().orderBy(F.xxhash64("of"), "of", "grade").limit(sample)
    found = docs.join(F.broadcast(some), F.col("doc_id") == F.col("of"))  # at most `sample` rows of two numbers
    # one row for each sampled label, however many documents have its id; combined on the map side
    found = found.groupBy("doc_id", "grade").agg(F.max_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "grade")

    def make(batches):
        for batch in batches:
            for i, buf, off in c.slices(batch.column(1)):
                f, v, counts = features(buf, off)
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, n), batch.column(2).slice(i, n), c.fixed_list(f, counts, pa.int64()), c.fixed_list(v, counts, pa.float64())], ["doc_id", "grade", "f", "v"]
                )

    def learn(batches):
        rows, grades = [], []
        for batch in batches:
            grades += batch.column("grade").to_pylist()
            for f, v in zip(batch.column("f"), batch.column("v")):
                rows.append((f.values.to_numpy(), v.values.to_numpy()))
        if len(set(grades)) < 2:
            model = np.zeros(SIZE), np.array([-40.0, -40.0])
        else:
            model = fit(rows, np.array(grades), how)
        yield pa.RecordBatch.from_pydict({"weights": [model[0].tolist()], "thresholds": [model[1].tolist()]})

    made = c.saved(found.mapInArrow(make, "doc_id bigint, grade int, f array<bigint>, v array<double>"), "sample")
    got = made.repartition(1).sortWithinPartitions("doc_id", "grade").mapInArrow(learn, "weights array<double>, thresholds array<double>").first()
    if got is None:
        return np.zeros(SIZE), np.array([-40.0, -40.0])
    return np.array(got["weights"]), np.array(got["thresholds"])


def score(df: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text", select_from: float = 0.5) -> DataFrame:
    """df with expected_grade, top_probability and selected."""
    shared = df.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))
    added = ("expected_grade", "top_probability", "selected")
    df = df.drop(*added)
    at = df.columns.index(text)

    def run(batches):
        weights, theta = shared.value
        for batch in batches:
            for i, buf, off in c.slices(batch.column(at)):
                f, v, counts = features(buf, off)
                n = len(counts)
                total = np.bincount(np.repeat(np.arange(n), counts), v * weights[f], n)
                above = [1 - _sigmoid(t - total) for t in theta]  # P(grade > k)
                some = batch.slice(i, n)
                cols = [*some.columns, pa.array(np.sum(above, axis=0)), pa.array(above[-1]), pa.array(above[-1] >= select_from)]
                yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names, *added])

    return df.mapInArrow(run, df.select("*", F.lit(0.0).alias(added[0]), F.lit(0.0).alias(added[1]), F.lit(True).alias(added[2])).schema)


def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all of `documents` with a model fitted on `labels`."""
    docs = c.table(spark, sf_dir, "documents", spread=True).select("doc_id", "text")
    model = train(docs, c.table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", "expected_grade", "top_probability", F.col("selected").alias("kept"))
