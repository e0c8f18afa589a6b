"""op4 against a plain computation of its features, moments and scores over the whole table."""

import re
import unicodedata
import zlib
from collections import Counter

import numpy as np

from sitesieve.llm import quality_classifier as C
from sitesieve.llm.queries import QUERIES

from ..conftest import SF


def features(text: str) -> list[float]:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    n, chars, letters = len(words), len(text), sum(map(len, words))
    symbols, marks = len(re.findall(r"[#*$%&|<>]", text)), text.count("!")
    upper = sum(unicodedata.category(c) == "Lu" for c in text)
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", line)) for line in text.split("\n"))
    return [
        np.log((letters + 5) / (n + 1)), np.log((symbols + 1) / (chars + 50)), np.log((upper + 1) / (chars + 20)), np.log((marks + 1) / (chars + 50)),
        np.log((len(repeated) + 2) / (n + 10)), np.log((len(set(words)) + 1) / (n + 1)) / np.log(n + 10), np.log((n + 5) / (lines + 0.5)), np.log(n + 10),
    ]


def test_query_equals_a_plain_fit(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    x = {r.doc_id: np.array(features(r.text or "")) for r in docs}
    out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    labels = {(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    learn = {k: np.array([x[i] for i, q in sorted(labels) if q == k and i in x and not out(i)]) for k in (0, 1)}
    total = sum(map(len, learn.values()))
    raw = {k: np.cov(v.T) for k, v in learn.items()}
    pooled = sum(len(learn[k]) * raw[k] for k in raw) / total

    def log_density(k, v):
        cov = (1 - C.TO_POOLED) * raw[k] + C.TO_POOLED * pooled
        cov = (1 - C.TO_IDENTITY) * cov + (C.TO_IDENTITY * np.trace(cov) / 8 + 1e-9) * np.eye(8)
        far = v - learn[k].mean(axis=0)
        return np.log(len(learn[k]) / total) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * far @ np.linalg.solve(cov, far)

    got = QUERIES["op4_quality_classifier"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(x)
    for r in got:
        want = 1 / (1 + np.exp(np.clip(log_density(0, x[r.doc_id]) - log_density(1, x[r.doc_id]), -700, 700)))
        assert abs(r.score - want) < 1e-6, (r, want)
        assert r.held_out == out(r.doc_id) and (r.predicted == int(want >= 0.7) or abs(want - 0.7) < 1e-6)
