"""Toxicity by non-negative positive-unlabelled learning.

A linear model over hashed words, and over beginnings that several words of a
text share, is trained in numpy from confirmed toxic texts (P) and texts
without a label (U). The risk is corrected by the class prior pi,

    pi * R_P(+) + max(0, R_U(-) - pi * R_P(-)),

so that no text has to be confirmed clean; where the second part turns
negative, the step goes against it instead (the non-negative estimator). The
prior is a parameter; by default it is estimated from P and U alone: the least
ratio of the shares of U, with a standard error, and of P above a threshold,
over thresholds that at least half of P exceeds, by scores of rows that the
scoring model has not seen.

Training is bounded: at most ``TRAIN_ROWS`` confirmed and as many unlabelled
rows outside the held-out fold, those of least hash of their id and text. Their
features, not their texts, come to the driver; near copies count once there.
Scoring covers every whole text in one scan with a broadcast of fixed size.

Defined results: a null or empty text has the score of the bias alone;
without a confirmed toxic or without an unlabelled text in training every
score is 0; of several labels of one id the highest counts, and null labels
are none; rows without an id are scored and never held out, nor trained on;
repeated rows have equal scores and train as one; a very long text takes time in
proportion; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import Words, arrow_schema, map_batches, mix64, narrow
from veridoc.llm.decontaminate import item_words

#: Most confirmed, and most unlabelled, rows that are used to fit the model.
TRAIN_ROWS = 10_000
#: Folds by crc32 of the id as text; fold 0 is held out.
FOLDS = 5
BITS = 18
#: A feature is used if it is in so many training texts at least, and its
#: rates in P and U differ by so many standard errors.
LEAST_TEXTS, LEAST_Z = 8, 4.0
#: Beginnings of so many bytes that so many different words of a text share.
BEGINNINGS, SHARED = (5, 6, 7), (2, 3, 4)
#: Texts that share one of so many min-hashes of their word shingles are near
#: copies in training.
COPY_HASHES, COPY_WORDS = 4, 5


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def features(text: str | None) -> np.ndarray:
    """Distinct hashed words of a whole text, and beginnings that several of
    them share."""
    words = Words(item_words(text))
    if not words.n:
        return np.empty(0, np.int64)
    known, at = np.unique(words.run_hashes(1), return_index=True)
    start, size = words.starts[at], (words.ends - words.starts)[at]
    found = [known]
    for k in BEGINNINGS:
        begun, n = np.unique(words.span_hashes(start[size >= k], k) + np.uint64(k), return_counts=True)
        found += [mix64(begun[n >= least] + np.uint64(least << 8)) for least in SHARED]
    return np.unique((np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64))


def copy_hashes(text: str | None) -> np.ndarray:
    """Min-hashes of a text's word shingles, which near copies mostly share."""
    s = Words(item_words(text)).shingles(COPY_WORDS)
    return np.array([mix64(s + np.uint64(k)).min() for k in range(1, COPY_HASHES + 1)] if len(s) else [0] * COPY_HASHES, np.uint64)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> float:
        z = self.bias + float(self.weights[x].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


class Rows:
    """Texts as rows of a sparse 0/1 matrix over selected features."""

    def __init__(self, rows: list[np.ndarray], column: np.ndarray):
        flat = np.concatenate([np.empty(0, np.int64), *rows])
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        known = column[flat] >= 0
        self.row, self.col, self.n = row[known], column[flat[known]], len(rows)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def back(self, g: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.col, g[self.row], width)


def risk(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray, np.ndarray]:
    """The two parts of the corrected risk of the logistic loss for scores of P
    and U, and slopes: of the first part by the scores of P, of the second by
    those of P and of U."""
    n, m = len(z_p), len(z_u)
    first = prior * np.logaddexp(0, -z_p).mean()
    second = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
    s_p, s_u = _sigmoid(z_p), _sigmoid(z_u)
    return first, second, prior * (s_p - 1) / n, -prior * s_p / n, s_u / m


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 400, rate: float = 0.1, decay: float = 0.05, beta: float = 0.0, gamma: float = 1.0) -> Model:
    """Full-batch Adam on the non-negative risk with the logistic loss, whose
    scores are probabilities; the weight decay is for all of P, as a prior of
    the weights would be."""
    size = 1 << BITS
    if not positive or not unlabelled or not 0 < prior < 1:
        return Model(np.zeros(size, np.float32), -60.0)
    in_p = np.bincount(np.concatenate(positive), minlength=size) / len(positive)
    in_u = np.bincount(np.concatenate(unlabelled), minlength=size) / len(unlabelled)
    spread = np.sqrt(in_u * (1 - in_u) * (1 / len(positive) + 1 / len(unlabelled)) + 1e-12)
    often = in_p * len(positive) + in_u * len(unlabelled) >= LEAST_TEXTS
    chosen = np.flatnonzero(often & (np.abs(in_p - in_u) / spread >= LEAST_Z))
    column = np.full(size, -1, np.int64)
    column[chosen] = np.arange(len(chosen))
    p, u, n = Rows(positive, column), Rows(unlabelled, column), len(chosen)
    w, b = np.zeros(n), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, steps + 1):
        _, second, by_p, less_p, by_u = risk(p.dot(w) + b, u.dot(w) + b, prior)
        gp, gu = (by_p + less_p, by_u) if second >= -beta else (-gamma * less_p, -gamma * by_u)
        grad = np.append(p.back(gp, n) + u.back(gu, n) + decay / p.n * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    weights = np.zeros(size, np.float32)
    weights[chosen] = w
    return Model(weights, float(b))


def class_prior(positive: list[np.ndarray], unlabelled: list[np.ndarray], parts: int = 5, first: float = 0.2) -> float:
    """Estimate of the share of positives in U, from P and U alone; ``first``
    is what the scoring models assume."""
    scores: tuple[list[float], list[float]] = ([], [])
    for k in range(parts):
        model = fit(*[[x for i, x in enumerate(rows) if i % parts != k] for rows in (positive, unlabelled)], first, steps=150)
        for rows, out in zip((positive, unlabelled), scores, strict=True):
            out += [model.score(x) for x in rows[k::parts]]
    of_p, of_u = map(np.sort, scores)
    if not len(of_p) or not len(of_u):
        return first
    at = np.unique(of_p[: len(of_p) // 2 + 1])
    share_u, share_p = ((len(x) - np.searchsorted(x, at)) / len(x) for x in (of_u, of_p))
    error = np.sqrt(share_u * (1 - share_u) / len(of_u))
    return float(np.clip(((share_u + error) / share_p).min(), 0.001, 0.5))


def without_copies(rows: list[np.ndarray], marks: list[np.ndarray]) -> list[np.ndarray]:
    """``rows`` but those that share a min-hash with one before."""
    seen: set[tuple[int, int]] = set()
    out = []
    for row, mark in zip(rows, marks, strict=True):
        own = set(enumerate(mark.tolist()))
        if seen.isdisjoint(own):
            seen |= own
            out.append(row)
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS, prior: float | None = None) -> Model:
    """Fits the model on rows outside the held-out fold. P are those labelled
    1; U are those without a label. Labels other than 1 are not looked at,
    but that their texts are no part of U."""
    known = labels.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label")).filter("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).filter(F.col("id").isNotNull() & ~held_out(F.col("id")))
    # Ids first: texts are read again for the chosen ones alone.
    toxic = known.filter(F.col("label") == 1).join(texts.select("id"), "id", "left_semi").select("id", F.lit(1).alias("label"))
    hidden = texts.select("id").join(known, "id", "left_anti").select("id", F.lit(0).alias("label")).distinct()
    chosen = reduce(DataFrame.union, [x.orderBy(F.xxhash64("id"), "id").limit(rows) for x in (toxic, hidden)])
    ddl = "label int, h bigint, words binary, marks binary"

    def run(rb: pa.RecordBatch) -> dict:
        found = [(features(x).astype(np.uint32).tobytes(), copy_hashes(x).tobytes()) for x in rb.column(2).to_pylist()]
        return {"label": rb.column(0), "h": rb.column(1), "words": [x for x, _ in found], "marks": [x for _, x in found]}

    found = map_batches(texts.join(F.broadcast(chosen), "id").select("label", F.xxhash64("id", "text"), "text"), run, ddl)
    p, u = (_gathered(found.filter(F.col("label") == k), rows) for k in (1, 0))
    return fit(p, u, class_prior(p, u) if prior is None else prior)


def _gathered(found: DataFrame, rows: int) -> list[np.ndarray]:
    """Features of so many rows, as an id may have any number of texts."""
    got = found.orderBy("h", "marks").limit(rows).toArrow().to_pandas()
    return without_copies([np.frombuffer(x, np.uint32).astype(np.int64) for x in got["words"]], [np.frombuffer(x, np.uint64) for x in got["marks"]])


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[key].dataType.simpleString()
    rows = narrow(df, key, text).select(F.col(f"`{key}`"), F.col(f"`{text}`"), held_out(F.col(f"`{key}`")).alias("__held"))

    def run(rb: pa.RecordBatch) -> dict:
        scores = [shared.value.score(features(x)) for x in rb.column(1).to_pylist()]
        return {key: rb.column(0), "held_out": rb.column(2), "score": scores, "predicted": [int(s >= 0.5) for s in scores]}

    return map_batches(rows, run, f"`{key}` {kind}, held_out boolean, score double, predicted int")


def keep_clean(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Rows of ``df``, all columns kept, whose score is below 0.5."""
    shared, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text)
    shape = arrow_schema(df.sparkSession, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            clean = [shared.value.score(features(x)) < 0.5 for x in rb.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(rb.columns, schema=shape).filter(pa.array(clean, pa.bool_()))

    return df.mapInArrow(run, df.schema)
