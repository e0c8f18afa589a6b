"""Language identification: nearest of several centroids per language.

A text is its vector of byte 1- to 3-gram counts (lower-cased, runs of ASCII
non-letters as one space, hashed into ``DIM`` buckets), weighted by
log(1 + count) * idf and scaled to length 1.  Each language's training vectors
are grouped by spherical k-means into up to ``CENTROIDS`` centroids; a text
gets the language of the centroid with the largest cosine, and is rejected if it
lies further from it than any training text of the language did, by a margin.

The model is fitted on at most about ``PER_LANGUAGE`` texts per language (and
``SAMPLE`` in all), chosen by a hash of doc_id: a bound on the driver's work, not
on the texts scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out
from .shingles import chunks

DIM = 4096
CENTROIDS = 4
PER_LANGUAGE, SAMPLE = 400, 4000
MARGIN = 0.1  #: of cosine, below the least similar training text
ROWS = 256  #: texts whose vectors are in memory at once


def _classes() -> np.ndarray:
    """Byte to byte: ASCII other than a-z becomes a space."""
    out = np.arange(256, dtype=np.uint32)
    out[:128] = 32
    out[97:123] = np.arange(97, 123)
    return out


_CLASS = _classes()


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """n-gram counts (texts x DIM) of a run of texts."""
    n = len(offsets) - 1
    code = _CLASS[data]
    owner = np.repeat(np.arange(n), np.diff(offsets))
    gap = code == 32
    same = owner[1:] == owner[:-1]
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = ~(gap[1:] & gap[:-1] & same)
    code, owner = code[keep], owner[keep]
    out = np.zeros(n * DIM, dtype=np.int64)
    for k in (1, 2, 3):
        m = len(code) - k + 1
        if m <= 0:
            break
        gram = np.full(m, k, dtype=np.uint32)
        for i in range(k):
            gram = gram * np.uint32(256) + code[i : i + m]
        bucket = (gram * np.uint32(2654435761)) >> np.uint32(20)
        inside = owner[:m] == owner[k - 1 :]
        out += np.bincount(owner[:m][inside] * DIM + bucket[inside], minlength=n * DIM)
    return out.reshape(n, DIM)


def runs(texts: pa.Array) -> Iterator[np.ndarray]:
    """Counts of a batch of texts, at most ``ROWS`` at a time."""
    for _, data, offsets in chunks(texts):
        for i in range(0, len(offsets) - 1, ROWS):
            o = offsets[i : i + ROWS + 1]
            yield counts(data[o[0] : o[-1]], o - o[0])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from a farthest-first start; at most ``k`` unit centroids."""
    centres = [unit(x.mean(axis=0, keepdims=True))[0]]
    while len(centres) < min(k, len(x)):
        near = (x @ np.array(centres).T).max(axis=1)
        centres.append(x[int(near.argmin())])
    centres = np.array(centres)
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        centres = np.array([unit(x[own == c].sum(axis=0, keepdims=True))[0] if (own == c).any() else centres[c] for c in range(len(centres))])
    return centres


class Centroids:
    def __init__(self, vectors: np.ndarray, langs: np.ndarray):
        n = len(vectors)
        df = (vectors > 0).sum(axis=0)
        self.idf = (np.log((n + 1) / (df + 1)) + 1).astype(np.float32)
        x = self.vectors(vectors)
        names, parts, limits = [], [], []
        for lang in sorted(set(langs.tolist())):
            own = x[langs == lang]
            centres = k_means(own, CENTROIDS)
            least = float((own @ centres.T).max(axis=1).min()) - MARGIN
            parts.append(centres), names.extend([lang] * len(centres)), limits.extend([least] * len(centres))
        self.names, self.centres, self.limits = np.array(names, dtype=object), np.concatenate(parts).astype(np.float32), np.array(limits)

    def vectors(self, c: np.ndarray) -> np.ndarray:
        return unit(np.log1p(c).astype(np.float32) * self.idf)

    def nearest(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, cosine, rejected) of each row of counts."""
        cos = self.vectors(c) @ self.centres.T
        best = cos.argmax(axis=1)
        value = cos[np.arange(len(best)), best].astype(np.float64)
        return self.names[best], np.clip(value, 0.0, 1.0), value < self.limits[best]


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Centroids | None:
    """Fit on rows with a lang, a letter and crc32(doc_id as text) mod 4 other than 2."""
    learn = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not sizes:
        return None
    each = max(1, min(per_language, sample // len(sizes)))
    # a hash of the row in [0, 2**31) under a limit for its language
    share = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, each / n))])
    place = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2**31)).cast("double") / 2.0**31
    # a language has at least its first few rows by that hash, however rare
    chosen = learn.where(place < F.element_at(share, F.col("lang")))
    first = learn.groupBy("lang").agg(F.min_by(F.struct("doc_id", "text"), place).alias("r")).select("lang", "r.doc_id", "r.text")
    chosen = chosen.select("lang", "doc_id", "text").unionAll(first)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [c.astype("<u4").tobytes() for part in runs(batch.column(1)) for c in part]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["lang", "c"])

    rows = chosen.select("lang", F.lower("text").alias("text")).mapInArrow(vectors, "lang string, c binary").limit(2 * sample + len(sizes)).collect()
    rows = sorted((r["lang"], bytes(r["c"])) for r in rows)  # the order in which tasks end must not matter
    return Centroids(np.array([np.frombuffer(c, dtype="<u4") for _, c in rows], dtype=np.float32), np.array([k for k, _ in rows], dtype=object))


def identify(docs: DataFrame, model: Centroids | None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, lang, nearest, score, rejected.

    nearest is the closest learned language, score its cosine (0 to 1), lang the same or
    ``und`` if rejected.  A text that is null or has no letter, and any text
    without a model, has nearest and lang ``und``, score 0 and is rejected.
    Whole texts are read; equal rows score alike; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, out = [], [], []
            for c in runs(batch.column("text")):
                parts = model.nearest(c) if model else (np.full(len(c), "und", dtype=object), np.zeros(len(c)), np.ones(len(c), dtype=bool))
                lang.append(parts[0]), score.append(parts[1]), out.append(parts[2])
            if not lang:
                continue
            lang, score, out = np.concatenate(lang), np.concatenate(score), np.concatenate(out)
            void = ~batch.column("letters").to_numpy(zero_copy_only=False)
            lang[void], score[void], out[void] = "und", 0.0, True
            best = lang.copy()
            lang[out] = "und"
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(best, pa.string()), pa.array(score), pa.array(out)], names=["doc_id", "lang", "nearest", "score", "rejected"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"), letters.alias("letters"))
    return rows.mapInArrow(run, "doc_id long, lang string, nearest string, score double, rejected boolean")
