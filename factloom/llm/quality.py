"""Quality classifier by positive-unlabelled learning.

A linear model over figures of the text minimises the non-negative unbiased risk
`pi R_p(+) + max(0, R_u(-) - pi R_p(-))` with the logistic loss: trusted positives are labelled rows of
quality 1, unlabelled is the web text itself. With this loss the unbiased risk is convex, so Newton steps find its
least; the unlabelled part of each step, and the figures' means and scales, are sums over all documents, made where
the figures lie. Where the negatives' part of the risk falls below zero, the model is held back (a stronger decay)
until it does not. Only the positives are a sample: at most `MOST_POSITIVES` labelled documents, by a hash of doc_id.

The class prior pi is estimated from positives and unlabelled documents alone: a region that holds the share p of the
positives and u of all documents bounds it by u / p, and the least bound among regions above a score that keep
`KEPT_POSITIVES` of the positives is taken. Labels other than 1 are not used.

Labels, lang, source and doc_id are no inputs of a score.

Null text: empty, scored like any text. Null doc_id: scored, not held out, never labelled. Repeated rows:
one result each; rows that share a labelled doc_id are all positives, up to twice the bound. Labels that are null or
clash are left out. No labelled positives: no model, every score 1. Ties: equal texts have equal scores, and a score
of exactly the cut is accepted. Very long texts: whole. Other columns, whatever their names, are not read by the scores
and kept as they are by the filter. Empty table: no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table, texts, written

FOLDS, HELD_OUT = 5, 0
CUT = 0.3
MOST_POSITIVES = 12_000
KEPT_POSITIVES = 0.9
#: Few positives are fitted with a stronger decay, so that the prior is not read off their own fit.
STEPS, SETTLED, DECAY, DECAY_OF_FEW = 30, 1e-5, 1e-3, 10.0

_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_KINDS = [b"!", b"|", b"$%&*#", b".,", b"0123456789", b"\n", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"<>{}[]();=_/\\", _MARKS]


def figures(text: str) -> np.ndarray:
    """Fixed figures of a whole text: character shares, repetition, word and line shapes."""
    raw = text.encode()
    own, n = raw.split(), max(len(raw), 1)
    letters = max(n - raw.count(b" "), 1)
    shares = [(n - len(raw.translate(None, k)) if raw else 0) / letters for k in _KINDS]
    count = max(len(own), 1)
    unique = len(set(own))
    pairs = set(zip(own, own[1:]))
    same = sum(map(bytes.__eq__, own, own[1:])) / count
    lines = raw.split(b"\n")
    mean = sum(map(len, own)) / count
    extra = [same, 1 - unique / count, 1 - len(pairs) / max(count - 1, 1) if count > 1 else 0.0, 1 - len(set(lines)) / len(lines), mean / 20, np.log1p(n) / 12, np.log1p(count) / 10, n / len(lines) / 1000, np.log1p(n / len(lines)) / 10]
    base = np.array(shares + extra)
    steps = np.array([f(x) for x in (shares[0], shares[1], shares[2], shares[6], shares[9], same, extra[1], extra[2], extra[3]) for f in (np.sqrt, lambda v: min(v * 20, 1.0), lambda v: float(v > 0.3))])
    short = np.array([float(count < k) for k in (3, 8, 20, 50)])
    return np.concatenate([base, steps, short])


WIDTH = len(figures("a"))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last one is the bias

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return _sigmoid(_scaled(rows, self.mean, self.scale) @ self.weights)


def _scaled(rows: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.c_[(rows - mean) / scale, np.ones(len(rows))]


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("figures").flatten().to_numpy().reshape(-1, WIDTH).astype(np.float64)


class Unlabelled:
    """Sums over the figures of all documents, each in one pass that gathers a few thousand numbers."""

    def __init__(self, features: DataFrame):
        self.features = features
        n, first, second = np.split(self.total(lambda x: np.r_[len(x), x.sum(0), (x * x).sum(0)], 1 + 2 * WIDTH), [1, 1 + WIDTH])
        self.n = int(n[0])
        self.mean = first / max(self.n, 1)
        self.scale = np.sqrt(np.maximum(second / max(self.n, 1) - self.mean**2, 0)) + 1e-6

    def total(self, of, size: int) -> np.ndarray:
        def sums(batches):
            out = np.zeros(size)
            for batch in batches:
                if batch.num_rows:
                    out += of(_rows(batch))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(out)], ["k", "v"])

        found = self.features.select("figures").mapInArrow(sums, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        whole = np.zeros(size)
        whole[[r["k"] for r in found]] = [r["v"] for r in found]
        return whole

    def risk(self, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean loss of all documents as negatives, its gradient and its second derivatives."""
        k, mean, scale = WIDTH + 1, self.mean, self.scale
        upper = np.triu_indices(k)

        def of(rows):
            x = _scaled(rows, mean, scale)
            z = x @ w
            s = _sigmoid(z)
            return np.r_[np.logaddexp(0, z).sum(), x.T @ s, ((x * (s * (1 - s))[:, None]).T @ x)[upper]]

        out = self.total(of, 1 + k + len(upper[0])) / self.n
        second = np.zeros((k, k))
        second[upper] = out[1 + k :]
        return out[0], out[1 : 1 + k], second + np.triu(second, 1).T

    def above(self, w: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The share of documents at each cut of the score or above."""
        mean, scale = self.mean, self.scale
        return self.total(lambda rows: (_scaled(rows, mean, scale) @ w >= cuts[:, None]).sum(1), len(cuts)) / self.n


def fit(p: np.ndarray, unlabelled: Unlabelled, prior: float, start: np.ndarray | None = None) -> np.ndarray:
    """Weights that minimise the non-negative unbiased risk; p: the positives' scaled figures."""
    origin = np.r_[np.zeros(WIDTH), np.log(prior / (1 - prior))]
    w, step, best, decay = origin if start is None else start, None, None, max(DECAY, DECAY_OF_FEW / len(p))
    for _ in range(STEPS):
        loss, gradient, second = unlabelled.risk(w)
        penalty = np.r_[np.full(WIDTH, decay), 0.0]
        risk = loss - prior * (p @ w).mean() + 0.5 * (penalty * w * w).sum()
        if best is not None and risk > best[0] + 1e-12:
            if np.abs(step).max() < 1e-4:
                return best[1]
            step = step / 2
            w = best[1] + step
            continue
        if best is not None and best[0] - risk < SETTLED:
            if loss >= prior * np.logaddexp(0, p @ w).mean():
                return w
            decay, best = 4 * decay, None  # the negatives' part is below zero
            continue
        best = risk, w
        step = -np.linalg.solve(second + np.diag(penalty + 1e-9), gradient - prior * p.mean(0) + penalty * w)
        w = w + step
    return best[1] if best is not None else origin


def class_prior(p: np.ndarray, unlabelled: Unlabelled, w: np.ndarray) -> float:
    """The least ratio of all documents to positives above a score, among scores that keep most positives."""
    own = np.sort(p @ w)
    cuts = own[np.unique((np.linspace(0, 1 - KEPT_POSITIVES, 11) * (len(own) - 1)).astype(int))]
    share = (len(own) - np.searchsorted(own, cuts)) / len(own)
    return float(np.clip((unlabelled.above(w, cuts) / share).min(), 0.01, 0.99))


def _features(documents: DataFrame) -> DataFrame:
    """(doc_id, figures) of all documents, written, as each step of the training reads them."""

    def of(batches):
        for batch in batches:
            rows = np.array([figures(x) for x in batch.column("text").to_pylist()], np.float32).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * WIDTH), pa.array(rows.ravel()))], ["doc_id", "figures"])

    return written(texts(documents).mapInArrow(lean(of), "doc_id long, figures array<float>"), "figures")


def train(features: DataFrame, labels: DataFrame) -> Model | None:
    """The model, from the positive labels of the training folds and the figures of all documents; None: no positives."""
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    given = given.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) != HELD_OUT)
    given = given.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most and quality = 1")
    chosen = given.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_POSITIVES)
    found = features.join(F.broadcast(chosen), "doc_id", "left_semi").select("figures").limit(2 * MOST_POSITIVES).collect()
    if not found:
        return None
    unlabelled = Unlabelled(features)
    p = _scaled(np.array([r["figures"] for r in found], np.float64), unlabelled.mean, unlabelled.scale)
    first = fit(p, unlabelled, 0.5)
    return Model(unlabelled.mean, unlabelled.scale, fit(p, unlabelled, class_prior(p, unlabelled, first), first))


def quality_scores(documents: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of documents."""
    features = _features(documents)
    held = documents.sparkSession.sparkContext.broadcast(train(features, labels))

    def score(batches):
        for batch in batches:
            scores = held.value.scores(_rows(batch)) if held.value else np.ones(batch.num_rows)
            out = [x is not None and zlib.crc32(str(x).encode()) % FOLDS == HELD_OUT for x in batch.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.bool_()), pa.array(scores, pa.float64()), pa.array((scores >= cut).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return features.mapInArrow(lean(score), "doc_id long, held_out boolean, score double, predicted int")


def accepted(documents: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of documents that score `cut` or more."""
    held = documents.sparkSession.sparkContext.broadcast(train(_features(documents), labels))

    def choose(batches):
        for batch in batches:
            if held.value and batch.num_rows:
                own = np.array([figures(x or "") for x in batch.column("text").to_pylist()], np.float32).astype(np.float64)
                batch = batch.filter(pa.array(held.value.scores(own) >= cut, pa.bool_()))
            yield batch

    return documents.mapInArrow(lean(choose), documents.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
