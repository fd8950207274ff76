"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, stored

FEATURES = ("words", "mean_word", "upper", "digit", "bang", "pipe", "symbol", "other_punct", "distinct", "lines", "short_lines", "packed")
#: Share of the pooled covariance, and of its mean variance, in each class covariance.
SHRINK_POOLED, SHRINK_SCALE = 0.1, 0.01
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_SYMBOL = b"#$%&*^~_=+<>@\\"
_PUNCT = b".,;:'\"()[]{}-/?"


def statistics(text: bytes | None) -> list[float]:
    """Numbers about a whole text, transformed towards symmetry: logarithms of sizes, roots of shares."""
    b = text or b""
    n = max(len(b), 1)
    words = b.split()
    k = max(len(words), 1)
    rows = [x for x in b.split(b"\n") if x]
    share = lambda chars: ((len(b) - len(b.translate(None, chars))) / n) ** 0.5
    packed = len(zlib.compress(b, 1)) / n if b else 1.0
    return [
        float(np.log1p(len(words))), float(np.log1p(len(b) / k)), share(_UPPER), share(_DIGIT), share(b"!"), share(b"|"), share(_SYMBOL), share(_PUNCT),
        len(set(words)) / k, float(np.log1p(len(rows))), (sum(len(x) < 40 for x in rows) / max(len(rows), 1)) ** 0.5, float(np.log(packed + 0.02)),
    ]


def _statistic_batches(batches):
    for batch in batches:
        rows = np.array([statistics(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(rows[:, i]) for i in range(len(FEATURES))]], names=["doc_id", *FEATURES])


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each row's whole text."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_statistic_batches, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log weights of the classes 0 and 1."""

    means: np.ndarray
    inverse: np.ndarray
    log_weight: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1: the logistic of the difference of log densities and priors."""
        z = np.einsum("cij,ncj->nci", self.inverse, x[:, None, :] - self.means[None])
        logs = self.log_weight - 0.5 * (z**2).sum(axis=2)
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))


def fit(rows: DataFrame, pooled: float = SHRINK_POOLED, scale: float = SHRINK_SCALE) -> Discriminant | float:
    """Fit from rows (quality 0 or 1, statistics), all of them.

    Spark adds up counts, sums and products of each class; two rows of sums come to the
    driver, which factors the two covariances once. With one class only (or none), the
    result is that class's label as a constant score (0.5 for none).
    """
    d = len(FEATURES)
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)]
    products = [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    got = {int(r["quality"]): r for r in rows.where("quality in (0, 1)").groupBy("quality").agg(F.count("*").alias("n"), *sums, *products).collect()}
    if len(got) < 2:
        return float(next(iter(got), 0.5))
    n, mean, scatter = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for c, r in got.items():
        n[c], mean[c] = r["n"], [r[f"s{i}"] / r["n"] for i in range(d)]
        for i in range(d):
            for j in range(i, d):
                scatter[c, i, j] = scatter[c, j, i] = r[f"p{i}_{j}"] - n[c] * mean[c, i] * mean[c, j]
    common = scatter.sum(axis=0) / max(n.sum() - 2, 1)
    ridge = np.diag(np.maximum(np.diag(common), 1e-6))
    inverse, log_weight = np.zeros((2, d, d)), np.zeros(2)
    for c in (0, 1):
        own = scatter[c] / max(n[c] - 1, 1)
        share = max(pooled, d / (n[c] + d))  # small classes lean on the pooled covariance
        cov = (1 - scale) * ((1 - share) * own + share * common) + scale * ridge + 1e-9 * np.eye(d)
        factor = np.linalg.cholesky(cov)
        inverse[c] = np.linalg.inv(factor)
        log_weight[c] = np.log(n[c] / n.sum()) - np.log(np.diag(factor)).sum()
    return Discriminant(mean, inverse, log_weight)


def _score_batches(batches, model):
    for batch in batches:
        x = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(FEATURES))])
        scores = model.score(x) if isinstance(model, Discriminant) else np.full(batch.num_rows, model)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])


def held_out(doc_id) -> F.Column:
    """True where crc32 of the id as text leaves the remainder 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics with quality, of labelled rows outside the held-out third. A repeated label counts once; contradicting labels of a doc_id all count."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").distinct()
    return stats.where(~held_out(F.col("doc_id"))).join(known, "doc_id")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Null texts are empty and get the score of an empty text; rows without an id are scored
    but never learnt from; other columns are ignored; empty labels give 0.5; an empty table
    gives no rows.
    """
    stats = stored(document_statistics(docs))
    model = fit(training_rows(stats, labels))
    scored = stats.mapInArrow(partial(_score_batches, model=model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _keep_batches(batches, model, at: int):
    for batch in batches:
        x = np.array([statistics(t) for t in batch.column(at).cast(pa.binary()).to_pylist()]).reshape(-1, len(FEATURES))
        scores = model.score(x) if isinstance(model, Discriminant) else np.full(len(x), model)
        yield batch.filter(pa.array(scores >= 0.5))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected (score 0.5 or more), with their columns.

    The statistics are gathered once to fit and once more to filter, so no text is shuffled.
    """
    model = fit(training_rows(document_statistics(docs), labels))
    return mapped(docs, partial(_keep_batches, model=model, at=docs.columns.index("text")), docs.schema)
