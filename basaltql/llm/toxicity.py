"""Toxicity severity by cumulative-link (proportional odds) ordinal regression on sparse text features.

Grades 0 < 1 < ... < K-1 share one weight vector: P(grade >= k) = sigmoid(w.x - theta_k) with ordered
thresholds. The features are the presence of words and of word beginnings (inflected and compounded
forms share a beginning). The expected severity is the sum of P(grade >= k) over k.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basaltql.llm.common import written

#: Bound of the labelled rows that are fitted (documented parameter; chosen by hash, all if fewer).
TRAIN_ROWS = 20_000
#: Bound of the features kept, those most associated with the label.
MAX_FEATURES = 8_192
#: Least chi-square of a feature (about 5e-4 by chance).
MIN_CHI = 12.0
PREFIXES = (3, 4, 5, 6, 7)
_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 200_000


def word_features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


@dataclass(frozen=True)
class OrdinalModel:
    """weights: by feature; thresholds: ascending, one for each grade above 0."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k), a column for each k from 1."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - np.array(self.thresholds), -40, 40)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, n_features: int, l2: float = 1e-4, steps: int = 1200):
    """Weights and thresholds that maximise the penalised likelihood, by Adam on the full batch.

    (rows, cols): the set features, sparse. The thresholds are theta_1 and logs of positive gaps, so
    that their order holds throughout.
    """
    top = int(grades.max()) if len(grades) else 0
    if top == 0:
        return np.zeros(n_features), np.array([20.0])
    n = len(grades)
    share = [(grades >= k).mean() for k in range(1, top + 1)]
    cuts = np.array([np.log((1 - p) / p) for p in np.clip(share, 1e-6, 1 - 1e-6)])
    params = np.concatenate([np.zeros(n_features), cuts[:1], np.log(np.maximum(np.diff(cuts), 0.05))])
    first, second = np.zeros_like(params), np.zeros_like(params)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, steps + 1):
        w, theta = params[:n_features], np.concatenate([[params[n_features]], np.exp(params[n_features + 1 :])]).cumsum()
        score = np.bincount(rows, weights=w[cols], minlength=n)
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        low, high = sigmoid(score - edge[grades]), sigmoid(score - edge[grades + 1])  # P(>= y), P(>= y + 1)
        low[grades == 0], high[grades == top] = 1.0, 0.0
        likelihood = np.maximum(low - high, 1e-12)
        d_low, d_high = low * (1 - low), high * (1 - high)
        d_score = -(d_low - d_high) / likelihood / n
        d_theta = np.zeros(top)
        np.add.at(d_theta, grades[grades > 0] - 1, (d_low / likelihood / n)[grades > 0])
        np.add.at(d_theta, grades[grades < top], (-d_high / likelihood / n)[grades < top])
        tails = d_theta[::-1].cumsum()[::-1]
        d_w = np.bincount(cols, weights=d_score[rows], minlength=n_features) + l2 * w / max(1, n_features) ** 0.5
        grad = np.concatenate([d_w, tails[:1], tails[1:] * np.exp(params[n_features + 1 :])])
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        params = params - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    theta = np.concatenate([[params[n_features]], np.exp(params[n_features + 1 :])]).cumsum()
    return params[:n_features], theta


def _labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int) -> DataFrame:
    """At most about ``most`` labelled rows, by hash of the key: the same rows in any run and partitioning."""
    marks = labels.select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("grade"))
    marks = marks.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.max("grade").alias("grade"))
    marks = written(marks, "labels")
    share = min(1.0, most / max(1, marks.count()))
    drawn = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(drawn), "doc_id")  # about most rows


def fit_severity(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    train_rows: int = TRAIN_ROWS,
    max_features: int = MAX_FEATURES,
    min_docs: int = 5,
) -> OrdinalModel:
    """Fit the model on a bounded sample of labelled rows.

    ``label`` holds grades 0..K-1; binary labels are two grades, so severity then is the chance of the upper one.
    Of a doc_id with several labels the highest counts; labels and documents without doc_id teach nothing. Features are
    chosen by chi-square with any of the thresholds, ties by name.
    Without positive labels the model finds nothing. Feature counts are summed on the executors;
    the driver gets the ``max_features`` with the largest chi-square and the sample's set features, at most
    ``train_rows`` times ``max_features`` whatever the length of the texts.
    """
    sample = written(_labelled(docs, labels, key, text, label, train_rows), "labelled")

    sizes = {r["grade"]: r["count"] for r in sample.groupBy("grade").count().collect()}
    n, top = sum(sizes.values()), max(sizes, default=0)
    shares = [sum(m for g, m in sizes.items() if g >= k) / n for k in range(1, top + 1)] if n else []
    if not shares or shares[0] == 1:
        return OrdinalModel({}, (20.0 if not shares else -20.0,))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [Counter() for _ in range(top + 1)]  # documents of grade k or more that have a feature
            for body, grade in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = {f for w in words(body) for f in word_features(w)}
                for k in range(max(grade, 0) + 1):
                    seen[k].update(found)
            names = list(seen[0])
            columns = [pa.array([c[f] for f in names], pa.int64()) for c in seen]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *columns], names=["feature", *[f"n{k}" for k in range(top + 1)]])

    counts = [f"n{k}" for k in range(top + 1)]
    counted = sample.select("doc_id", "text", "grade").mapInArrow(count, "feature string, " + ", ".join(f"{c} long" for c in counts))
    counted = counted.groupBy("feature").agg(*[F.sum(c).alias(c) for c in counts]).where(F.col("n0") >= min_docs)
    expected = [F.col("n0") * F.lit(p) for p in shares]
    chis = [F.pow(F.col(f"n{k}") - e, F.lit(2.0)) / e for k, e in enumerate(expected, 1)]
    chi = F.greatest(*chis) if len(chis) > 1 else chis[0]
    best = counted.select("feature", chi.alias("chi")).where(F.col("chi") > MIN_CHI)
    best = best.orderBy(F.desc("chi"), "feature").limit(max_features).collect()
    index = {r["feature"]: i for i, r in enumerate(best)}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [{f for w in words(body) for f in word_features(w) if f in index} for body in batch.column(1).to_pylist()]
            sets = [sorted(index[f] for f in fs) for fs in found]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.list_(pa.int32())), batch.column(2)], names=["f", "grade"])

    coded = sample.select("doc_id", "text", "grade").mapInArrow(encode, "f array<int>, grade int").collect()
    grades = np.array([r["grade"] for r in coded], dtype=np.int64)
    rows = np.repeat(np.arange(len(coded)), [len(r["f"]) for r in coded])
    cols = np.array([f for r in coded for f in r["f"]], dtype=np.int64)
    w, theta = fit_ordinal(rows, cols, grades, len(index))
    return OrdinalModel({f: float(w[i]) for f, i in index.items()}, tuple(float(t) for t in theta))


def _scores(model: OrdinalModel):
    """Function from texts to linear scores, with a memory of its words' features."""
    weights, cache = model.weights, {}

    def score(bodies) -> np.ndarray:
        out = np.zeros(len(bodies))
        for i, body in enumerate(bodies):
            active: set[str] = set()
            for word in words(body.as_py()):
                known = cache.get(word)
                if known is None:
                    known = tuple(f for f in word_features(word) if f in weights)
                    if len(cache) >= _CACHE:
                        cache.clear()
                    cache[word] = known
                if known:
                    active.update(known)
            out[i] = sum(weights[f] for f in sorted(active))
        return out

    return score


def drop_toxic(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that ``score_severity`` does not call toxic."""
    column = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scores(model)
        for batch in batches:
            yield batch.filter(pa.array(model.at_least(score(batch.column(column)))[:, 0] < 0.5))

    return docs.mapInArrow(run, docs.schema)


def score_severity(docs: DataFrame, model: OrdinalModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of ``docs``: doc_id, expected_severity, grade (the most probable one), p_toxic, toxic (p_toxic >= 0.5).

    Whole texts are scored in one pass without a shuffle. Null and empty texts have no features and score
    as such. The weights (at most ``max_features``) travel with the function.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scores(model)
        for batch in batches:
            scores = score(batch.column(1))
            above = model.at_least(scores)
            chance = np.hstack([np.ones((len(scores), 1)), above]) - np.hstack([above, np.zeros((len(scores), 1))])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(above.sum(axis=1)),
                    pa.array(chance.argmax(axis=1).astype(np.int32)),
                    pa.array(above[:, 0]),
                    pa.array(above[:, 0] >= 0.5),
                ],
                names=["doc_id", "expected_severity", "grade", "p_toxic", "toxic"],
            )

    schema = "doc_id long, expected_severity double, grade int, p_toxic double, toxic boolean"
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
