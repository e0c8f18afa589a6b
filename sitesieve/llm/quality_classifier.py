"""Quality classifier: regularised quadratic discriminant analysis.

Eight transformed statistics of a text are taken as Gaussian in each class.  A class
covariance is shrunk towards the pooled one and that towards a
multiple of the identity; its Cholesky factor is computed once, and the
score is the logistic of the difference of the two log densities (with the
classes' shares as prior).  Moments come from one aggregation over all labelled rows
that may be learned from; only 2 rows of moments reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, saved
from .quality_rules import row_key
from .text_stats import with_statistics

TO_POOLED, TO_IDENTITY = 0.3, 0.05  #: shrinkage intensities
D = 8


def _transformed() -> list[Column]:
    s = {k: F.col(f"s.{k}").cast("double") for k in ("n_chars", "n_words", "word_chars", "n_symbols", "n_upper", "n_marks", "n_lines", "n_repeat_words", "n_distinct")}
    return [
        F.ln((s["word_chars"] + 5) / (s["n_words"] + 1)),
        F.ln((s["n_symbols"] + 1) / (s["n_chars"] + 50)),
        F.ln((s["n_upper"] + 1) / (s["n_chars"] + 20)),
        F.ln((s["n_marks"] + 1) / (s["n_chars"] + 50)),
        F.ln((s["n_repeat_words"] + 2) / (s["n_words"] + 10)),
        F.ln((s["n_distinct"] + 1) / (s["n_words"] + 1)) / F.ln(s["n_words"] + 10),
        F.ln((s["n_words"] + 5) / (s["n_lines"] + 0.5)),
        F.ln(s["n_words"] + 10),
    ]


def features(docs: DataFrame) -> DataFrame:
    """doc_id, key and x0..x7 of every row of ``docs``; a null text counts as empty."""
    rows = with_statistics(docs.select("doc_id", "text", row_key(docs).alias("key")))
    return rows.select("doc_id", "key", *[x.alias(f"x{i}") for i, x in enumerate(_transformed())])


class Discriminant:
    """Means, cached inverse Cholesky factors and log priors of the two classes."""

    def __init__(self, moments: dict[int, tuple[int, np.ndarray, np.ndarray]]):
        total = sum(n for n, _, _ in moments.values())
        pooled = sum(n * c for n, _, c in moments.values()) / total
        self.classes = {}
        for k, (n, mean, cov) in moments.items():
            cov = (1 - TO_POOLED) * cov + TO_POOLED * pooled
            cov = (1 - TO_IDENTITY) * cov + (TO_IDENTITY * np.trace(cov) / D + 1e-9) * np.eye(D)
            factor = np.linalg.cholesky(cov)
            self.classes[k] = (mean, np.linalg.inv(factor), math.log(n / total) - np.log(np.diag(factor)).sum())

    def log_density(self, k: int) -> Column:
        mean, inverse, constant = self.classes[k]
        z = [sum((float(inverse[i, j]) * (F.col(f"x{j}") - float(mean[j])) for j in range(i + 1)), F.lit(0.0)) for i in range(D)]
        return float(constant) - 0.5 * sum(v * v for v in z)

    def score(self) -> Column:
        if len(self.classes) < 2:
            return F.lit(float(1 in self.classes))
        return 1 / (1 + F.exp(F.greatest(F.least(self.log_density(0) - self.log_density(1), F.lit(700.0)), F.lit(-700.0))))


def fit(rows: DataFrame, labels: DataFrame) -> Discriminant | None:
    """Moments of the labelled rows; None without any. ``labels``: doc_id, quality (0 or 1)."""
    known = labels.where("quality in (0, 1)").select("doc_id", "quality").distinct()
    learn = rows.join(known, "doc_id").where(~held_out(F.col("doc_id")))
    cov = [(i, j) for i in range(D) for j in range(i + 1)]
    found = learn.groupBy("quality").agg(F.count("*").alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(D)], *[F.coalesce(F.covar_samp(f"x{i}", f"x{j}"), F.lit(0.0)).alias(f"c{i}_{j}") for i, j in cov]).collect()
    moments = {}
    for r in found:  # at most two rows
        c = np.zeros((D, D))
        for i, j in cov:
            c[i, j] = c[j, i] = r[f"c{i}_{j}"]
        moments[r["quality"]] = (r["n"], np.array([r[f"m{i}"] for i in range(D)]), c)
    return Discriminant(moments) if moments else None


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, train: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, key, held_out, score, predicted.

    ``train`` holds the documents that ``labels`` speaks of (``docs`` by default).  Rows with crc32(doc_id as text) mod 4 = 2 (held_out) teach nothing, and only
    the text enters a score.  Null texts score as empty ones.  A document
    with contradicting labels teaches both; if the labels hold one class
    only, every score is 0 or 1 accordingly, and 0.5 if there is none.  Repeated rows
    score alike; a null doc_id matches no label; other columns are ignored.
    """
    rows = saved(features(docs), "features")
    model = fit(rows if train is None else saved(features(train), "train"), labels)
    score = model.score() if model else F.lit(0.5)
    out = rows.select("doc_id", "key", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
