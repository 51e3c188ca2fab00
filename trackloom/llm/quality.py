"""Text quality by Bradley-Terry pairwise ranking."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.llm._text import NON_SPACE, Words, byte_class, distinct, row_blocks

_CLASSES = {
    "upper": byte_class(lambda b: 65 <= b <= 90),
    "lower": byte_class(lambda b: 97 <= b <= 122 or b >= 128),
    "digit": byte_class(lambda b: 48 <= b <= 57),
    "stop": byte_class(lambda b: b in b".,;:?"),
    "noise": byte_class(lambda b: b in b"!#$%&*+/<=>@\\^_`{|}~"),
    "line": byte_class(lambda b: b == 10),
}
_LETTER = byte_class(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
FEATURES = [
    "log_words", "upper_rate", "digit_rate", "stop_rate", "noise_rate", "line_rate", "word_length", "noisy_words", "shouting_words",
    "letterless_words", "repeated_neighbours", "distinct_words", "commonest_word", "some_noise", "some_shouting", "long_words",
]


def features(column: pa.Array) -> np.ndarray:
    """(rows, features) from the texts alone; null and empty texts are all zeros."""
    out = np.zeros((len(column), len(FEATURES)))
    for row, data, offsets in row_blocks(column, 1 << 18):
        words, n = Words(data, offsets, NON_SPACE), len(offsets) - 1
        first = words.first
        count = np.diff(first)
        some, size = np.maximum(count, 1), np.maximum(np.diff(offsets), 1)

        def totals(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(flags)])
            return (sums[cuts[1:]] - sums[cuts[:-1]]).astype(float)

        by_class = {k: totals(t[data], offsets) for k, t in _CLASSES.items()}
        letters = np.maximum(by_class["upper"] + by_class["lower"], 1)

        def in_word(table: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(table[data])])
            return sums[words.ends] - sums[words.starts]

        noisy, upper, letter = in_word(_CLASSES["noise"]) > 0, in_word(_CLASSES["upper"]), in_word(_LETTER)
        shouting = (upper == letter) & (letter > 1)
        length = words.ends - words.starts
        same = np.zeros(len(words.hashes), dtype=bool)
        same[1:] = words.hashes[1:] == words.hashes[:-1]
        same[first[:-1][first[:-1] < len(same)]] = False
        varied, commonest = np.zeros(n), np.zeros(n)
        for i in np.flatnonzero(count):
            own = words.hashes[first[i] : first[i + 1]]
            varied[i] = len(distinct(own)) / min(len(own), 500)
            sample = np.sort(own)
            runs = np.flatnonzero(np.concatenate([[True], sample[1:] != sample[:-1], [True]]))
            commonest[i] = np.diff(runs).max() / len(own)
        noise_share, shout_share = totals(noisy, first) / some, totals(shouting, first) / some
        out[row : row + n] = np.stack([
            np.log1p(count), by_class["upper"] / letters, by_class["digit"] / size, by_class["stop"] / some, by_class["noise"] / size, by_class["line"] / some,
            totals(length, first) / some, noise_share, shout_share, totals(letter == 0, first) / some, totals(same, first) / some, np.minimum(varied, 1), np.where(count > 20, commonest, 0),
            np.minimum(1, 10 * noise_share), np.minimum(1, 10 * shout_share), totals(length > 30, first) / some,
        ], axis=1)
    return out


@dataclass(frozen=True)
class Ranking:
    """Strength of a text: ``weights`` on standardised features; ``threshold`` is a quantile of the training strengths."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.strength(x) - self.threshold, -30, 30)))


def fit_ranking(x: np.ndarray, better: np.ndarray, pairs: int = 100_000, ridge: float = 1e-3, steps: int = 30, seed: int = 7) -> Ranking:
    """Bradley-Terry: P(i is preferred to j) = logistic(w . (x_i - x_j)), over ``pairs`` random (better, worse) pairs.

    Newton's method on the mean logistic loss with a ridge. The threshold is the quantile of the
    strengths at the share of worse rows. Without both kinds nothing can be learnt: all scores are 0.5.
    """
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    w = np.zeros(len(FEATURES))
    good, bad = np.flatnonzero(better), np.flatnonzero(~better)
    if not len(good) or not len(bad):
        return Ranking(mean, scale, w, 0.0)
    z = np.clip((x - mean) / scale, -6, 6)
    random = np.random.Generator(np.random.PCG64(seed))
    gap = z[random.choice(good, pairs)] - z[random.choice(bad, pairs)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(gap @ w, -30, 30)))
        gradient = -(gap * p[:, None]).mean(axis=0) + ridge * w
        hessian = (gap * (p * (1 - p))[:, None]).T @ gap / len(gap) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return Ranking(mean, scale, w, float(np.quantile(z @ w, len(bad) / len(x))))


def held_out(doc_id) -> F.Column:
    """Rows whose crc32(doc_id as text) mod 3 is 1; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> Ranking:
    """Learn from at most ``sample_rows`` labelled rows, those with the least hash, none of them held out.

    Rows without quality or doc_id are left out; of repeated rows of one doc_id one is taken.
    """
    usable = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    def run(batches):
        for batch in batches:
            x = pa.array(list(features(batch.column("text"))), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), x], ["doc_id", "quality", "x"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")  # sample_rows at most
    rows = found.select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, x array<double>").groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return fit_ranking(np.array([r.x for r in rows]).reshape(-1, len(FEATURES)), np.array([r.quality == 1 for r in rows], dtype=bool))


def score_quality(docs: DataFrame, ranking: Ranking, keep_text: bool = True) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= 0.5, else 0) of every row.

    Null and empty texts are scored too, as texts without words. Repeated rows are each scored,
    other columns stay, those named score or predicted are replaced; no rows give no rows.
    """
    others = [c for c in docs.columns if c not in ("text", "score", "predicted")]
    asked = docs.select("text", F.struct(*others, F.lit(0).alias("_")).alias("row"))
    schema = T.StructType([*([asked.schema["text"]] if keep_text else []), asked.schema["row"], T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            score = pa.array(ranking.score(features(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([*([batch.column("text")] if keep_text else []), batch.column("row"), score], schema.names)

    order = [c for c in docs.columns if c not in ("score", "predicted") and (keep_text or c != "text")]
    found = asked.mapInArrow(run, schema).select(*(["text"] if keep_text else []), "row.*", "score")
    return found.select(*order, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
