"""op7's weights, centroids, cosines and rejection limits against plain loops in double precision."""

import math
import random

import numpy as np

from sitesieve.llm import language_id as L

from .cases import words


def vectors(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of texts of two invented languages, one with far more letters of the end of the alphabet."""
    rng = random.Random(seed)
    texts, langs = [], []
    for i in range(n):
        text = " ".join(words(rng, rng.randrange(5, 60)))
        if i % 3 == 0:
            text = text.translate(str.maketrans("abcdeilmnorst", "zyxwvjkqhgfpu"))
        texts.append(text.encode())
        langs.append("b" if i % 3 == 0 else "a")
    ends = np.cumsum([0, *map(len, texts)])
    return L.counts(np.frombuffer(b"".join(texts), dtype=np.uint8), ends), np.array(langs, dtype=object)


def weighted(counts, idf) -> list[float]:
    raw = [math.log1p(c) * w for c, w in zip(counts, idf)]
    size = math.sqrt(sum(v * v for v in raw)) or 1.0
    return [v / size for v in raw]


def test_model_equals_plain_loops():
    c, langs = vectors(45, 1)
    model = L.Centroids(c.astype(np.float32), langs)
    idf = [math.log((len(c) + 1) / (sum(row[j] > 0 for row in c) + 1)) + 1 for j in range(L.DIM)]
    assert np.allclose(model.idf, idf, rtol=1e-5)
    x = np.array([weighted(row, idf) for row in c])
    assert sorted(set(model.names)) == ["a", "b"] and len(model.names) <= 2 * L.CENTROIDS
    for lang in ("a", "b"):
        own, centres = x[langs == lang], model.centres[model.names == lang].astype(float)
        assert np.allclose(np.linalg.norm(centres, axis=1), 1, atol=1e-5)
        nearest = [max(range(len(centres)), key=lambda k: float(v @ centres[k])) for v in own]
        for k in set(nearest):  # a centroid is the direction of the sum of its texts
            total = sum(v for v, near in zip(own, nearest) if near == k)
            assert np.allclose(centres[k], total / np.linalg.norm(total), atol=1e-4)
        least = min(max(float(v @ k) for k in centres) for v in own) - L.MARGIN
        assert np.allclose(model.limits[model.names == lang], least, atol=1e-4)

    others, truth = vectors(30, 2)
    noise = np.zeros((2, L.DIM), dtype=np.int64)
    noise[0, :7] = 5  # a text of n-grams that no language has, and one without any
    names, values, rejected = model.nearest(np.concatenate([others, noise]).astype(np.float32))
    for i, row in enumerate([*others, *noise]):
        cosines = [sum(p * q for p, q in zip(weighted(row, idf), centre)) for centre in model.centres.astype(float)]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert abs(values[i] - min(1.0, max(0.0, cosines[best]))) < 1e-4
        if i < len(others):
            assert names[i] == model.names[best] == truth[i]
        if abs(cosines[best] - model.limits[best]) > 1e-4:
            assert rejected[i] == (cosines[best] < model.limits[best])
    assert rejected[len(others):].all()
