"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(t_k - w.x) with ordered thresholds t and one vector w of hashed-text weights that all grades
share. x holds square roots of the relative frequencies of hashed features: words, their beginnings and endings, and
a few shapes. From w.x come the expected grade and the tail probability P(grade >= k) by which documents are selected.

The model is fitted on the driver, on at most SAMPLE documents, those of the rated ones at hand whose ids have the
smallest hashes; their whole texts are read. All documents are scored on the executors, which get the 2 ** BITS weights.

Cases: null and empty texts have no features and score 0, the neutral value, and are rejected (their tail
probability is set to 0); without any rating, or with one grade only, nothing is known and every document with words
is kept; a doc_id rated twice counts with its lowest grade, and one that several rows have with the least of their
texts; a null toxic says nothing against a document, a null quality is no rating; repeated documents score alike and tie;
very long texts are read whole; other columns pass through, but those with a result's name are replaced by it; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, quoted, ready, with_columns, without
from .words import _WHITE, mix, text_chunks, word_hashes

BITS = 18
SAMPLE = 4000
#: Grades: 0 toxic, 1 of low quality, 2 good.
GRADES = 3
DECAY = 3e-5


def features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text its sorted hashed features and their values."""
    words, bounds = word_hashes(texts)
    data = np.frombuffer(b"\n".join(texts) + b"\n" + b"\0" * 8, np.uint8)
    white = _WHITE[data[: len(data) - 8]]
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    if not white[0]:
        edge = np.concatenate([[0], edge])
    starts, stops = edge[::2], edge[1::2]
    length = stops - starts
    small = (data >= 97) & (data <= 122)
    big = (data >= 65) & (data <= 90)
    lower = np.where(big, data + 32, data).astype(np.uint64)
    kinds, prefix = [mix(words + np.uint64(1))], np.zeros(len(starts), np.uint64)
    for i in range(6):
        prefix = prefix * np.uint64(257) + np.where(i < length, lower[starts + i] + np.uint64(1), np.uint64(0))
        if i >= 3:
            kinds.append(mix(prefix * np.uint64(8) + np.uint64(i)))
    suffix = np.zeros(len(starts), np.uint64)
    for i in range(1, 4):
        suffix = suffix * np.uint64(257) + np.where(i <= length, data[np.maximum(stops - i, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    kinds.append(mix(suffix * np.uint64(8) + np.uint64(6)))
    n_big = np.add.reduceat(big, starts, dtype=np.int64) if len(starts) else length
    n_small = np.add.reduceat(small, starts, dtype=np.int64) if len(starts) else length
    shape = np.minimum(n_big, 3) * 2 + (n_small > 0)
    kinds.append(mix(shape.astype(np.uint64) * np.uint64(8) + np.uint64(7)))
    again = np.zeros(len(words), np.uint64)
    again[1:] = words[1:] == words[:-1]
    again[bounds[:-1][bounds[:-1] < len(words)]] = 0  # a text's first word follows none
    kinds.append(mix(again * np.uint64(8) + np.uint64(2)))
    hashed = (np.stack(kinds, 1) >> np.uint64(64 - BITS)).astype(np.int32) if len(words) else np.zeros((0, len(kinds)), np.int32)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        found, count = np.unique(hashed[a:b], return_counts=True)
        yield found, np.sqrt(count / max(1, b - a)).astype(np.float32)


@dataclass
class Ordinal:
    """Shared weights and ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    @classmethod
    def fit(cls, found: list[np.ndarray], values: list[np.ndarray], grades: np.ndarray, grades_n: int = GRADES, steps: int = 60, decay: float = DECAY, least: int = 3) -> Ordinal:
        """L-BFGS on the mean negative log-likelihood with an L2 penalty; rarer grades weigh more, by the root of their rarity."""
        weights = np.zeros(1 << BITS, np.float64)
        share = np.bincount(grades, minlength=grades_n) / max(1, len(grades))
        seen = share > 0
        if seen.sum() < 2:
            return cls(weights, np.full(grades_n - 1, -40.0) + np.arange(grades_n - 1))
        index, value = np.concatenate(found), np.concatenate(values)
        row = np.repeat(np.arange(len(found), dtype=np.int32), [len(f) for f in found])
        often = np.flatnonzero(np.bincount(index, minlength=len(weights)) >= least)  # rarer features keep weight 0
        place = np.full(len(weights), -1, np.int32)
        place[often] = np.arange(len(often))
        index = place[index]
        value, row, index = value[index >= 0], row[index >= 0], index[index >= 0]
        full, n, cuts = weights, len(often), grades_n - 1
        each = np.where(seen[grades], (1 / np.where(seen, share, 1))[grades], 0) ** 0.5
        each /= each.sum()

        def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
            """x: the weights, the first threshold, the logarithms of the gaps between thresholds."""
            thresholds = np.cumsum(np.concatenate([x[n : n + 1], np.exp(np.clip(x[n + 1 :], -10, 10))]))
            score = np.bincount(row, x[index] * value, len(found))
            ends = np.concatenate([[-np.inf], thresholds, [np.inf]])
            up, low = _sigmoid(ends[grades + 1] - score), _sigmoid(ends[grades] - score)
            p = np.maximum(up - low, 1e-12)
            du, dl = up * (1 - up) / p * each, low * (1 - low) / p * each
            slope = np.zeros(len(x))
            slope[:n] = np.bincount(index, (du - dl)[row] * value, n) + decay * x[:n]
            at = np.zeros(grades_n + 1)
            np.add.at(at, grades + 1, -du)
            np.add.at(at, grades, dl)
            later = np.cumsum(at[1:-1][::-1])[::-1]
            slope[n] = later[0]
            slope[n + 1 :] = later[1:] * np.exp(np.clip(x[n + 1 :], -10, 10))
            return float(-(each * np.log(p)).sum() + decay / 2 * (x[:n] ** 2).sum()), slope

        tail = np.clip(np.cumsum(share)[:-1], 1e-3, 1 - 1e-3)
        first = np.maximum.accumulate(np.log(tail / (1 - tail)) + 0.1 * np.arange(cuts))
        x = _lbfgs(loss, np.concatenate([np.zeros(n), first[:1], np.log(np.maximum(np.diff(first), 0.1))]), steps)
        weights, thresholds = x[:n], np.cumsum(np.concatenate([x[n : n + 1], np.exp(np.clip(x[n + 1 :], -10, 10))]))
        full[often] = weights
        return cls(full, thresholds)

    def tails(self, score: np.ndarray) -> np.ndarray:
        """[documents, grades - 1]: P(grade >= 1), P(grade >= 2), ..."""
        return _sigmoid(score[:, None] - self.thresholds[None])


def _lbfgs(loss, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Minimise by limited-memory quasi-Newton steps with backtracking."""
    value, slope = loss(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        way, held = slope.copy(), []
        for s, y, r in reversed(past):
            held.append(a := r * (s @ way))
            way -= a * y
        if past:
            s, y, r = past[-1]
            way /= r * (y @ y)
        for (s, y, r), a in zip(past, reversed(held), strict=True):
            way += s * (a - r * (y @ way))
        down, size = slope @ way, 1.0 if past else 1.0 / max(1e-12, np.sqrt(slope @ slope))
        if down <= 0:
            break
        while size > 1e-6:
            new_value, new_slope = loss(x - size * way)
            if new_value <= value - 1e-4 * size * down:
                break
            size /= 2
        else:
            break
        s, y = -size * way, new_slope - slope
        if (sy := s @ y) > 1e-12:
            past = [*past[-memory + 1 :], (s, y, 1 / sy)]
        x, done = x + s, value - new_value < 1e-6 * max(1e-9, abs(value))
        value, slope = new_value, new_slope
        if done:
            break
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def rated(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list, list, np.ndarray]:
    """Features and grades of at most sample rated documents."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    chosen = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("rated_id")).agg(F.min(grade).alias("grade"))
    ids = docs.where("text is not null").select(F.col("doc_id").alias("rated_id")).distinct()
    chosen = chosen.join(ids, "rated_id", "left_semi").orderBy(F.xxhash64("rated_id"), "rated_id").limit(sample)

    def run(batches):
        for batch in batches:
            a = 0
            for ids, chunk in text_chunks(batch.column(0), batch.column(1)):
                pairs = list(features(chunk))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(ids)), pa.array([f.tobytes() for f, _ in pairs], pa.binary()), pa.array([v.tobytes() for _, v in pairs], pa.binary())], names=["grade", "found", "value"])
                a += len(ids)

    text = docs.select("doc_id", "text")
    rows = text.join(F.broadcast(chosen), F.col("doc_id") == F.col("rated_id"))  # sample rows at most
    rows = rows.groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min("text").alias("text")).select("grade", "text").mapInArrow(run, "grade int, found binary, value binary").toArrow()
    order = np.lexsort(([x or b"" for x in rows["found"].to_pylist()], rows["grade"].to_numpy())) if rows.num_rows else []
    found, value = rows["found"].to_pylist(), rows["value"].to_pylist()
    return [np.frombuffer(found[i], np.int32) for i in order], [np.frombuffer(value[i], np.float32) for i in order], rows["grade"].to_numpy()[order].astype(np.int64) if rows.num_rows else np.zeros(0, np.int64)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    ready(docs.sparkSession)
    return Ordinal.fit(*rated(docs, labels, sample))


def score(docs: DataFrame, model: Ordinal, prefix: str = "") -> DataFrame:
    """docs with three columns more: score, expected_grade and tail_probability, that of the best grade."""
    spark = ready(docs.sparkSession)
    docs = without(docs, *(prefix + n for n in ("score", "expected_grade", "tail_probability")))
    shared = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))
    at = docs.columns.index("text")
    names = [prefix + n for n in ("score", "expected_grade", "tail_probability")]

    def run(batches):
        weights, thresholds = shared.value
        known = Ordinal(weights, thresholds)
        for batch in batches:
            s, words = [], []
            for _, chunk in text_chunks(batch.column(at), batch.column(at)):
                for found, value in features(chunk):
                    s.append(float(weights[found] @ value))
                    words.append(len(found) > 0)
            tails = known.tails(np.array(s)) if s else np.zeros((0, len(thresholds)))
            tails *= np.array(words, bool)[:, None]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array(tails.sum(1)), pa.array(tails[:, -1])], names=[*batch.schema.names, "r0", "r1", "r2"])

    return with_columns(docs, run, [T.StructField(n, T.DoubleType()) for n in names])


def select(docs: DataFrame, labels: DataFrame, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The documents that are more likely than least to have the best grade, with their own columns."""
    prefix = fresh(docs, "quality_tail_probability")[: -len("tail_probability")]
    return score(docs, fit(docs, labels, sample), prefix).where(F.col(prefix + "tail_probability") >= least).select(*[quoted(c) for c in docs.columns])
