"""Awkward rows that every operator meets: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, key string, id string, n int, part int, kept string, s string, component_id string, host int"


def words(rng, n, vocabulary=400):
    return [f"{'aeiou'[rng.randrange(5)]}{rng.randrange(vocabulary)}x" for _ in range(n)]


def texts(seed=3):
    """(doc_id, text): groups of near and exact copies, and the awkward ones."""
    rng = random.Random(seed)
    out = []
    for g in range(12):
        base = words(rng, rng.choice([60, 90, 200]))
        for c in range(rng.choice([1, 2, 9])):
            w = list(base)
            for _ in range(c % 4):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            out.append(" ".join(w) if c % 2 else "\n".join(" ".join(w[i : i + 11]) for i in range(0, len(w), 11)))
    out += [out[0], out[0], "", " \t\n", None, None, "one", "One", "two words", "TWO\nwords", "a b c", "x " * 3000 + "end", " ".join(words(rng, 30_000, 10**6)), "é漢字 😀 ß" * 40]
    rng.shuffle(out)
    rows = list(enumerate(out, 10))
    return rows + [rows[0], rows[5], (None, "no id at all"), (None, out[0])]


def docs(spark, rows=None):
    rows = texts() if rows is None else rows
    lang = [None, "en", "de"]
    return spark.createDataFrame([(i, t, lang[k % 3], None if k % 5 == 0 else "src", "k", "i", 1, 2, "no", "s", "c", 0) for k, (i, t) in enumerate(rows)], DOCS).repartition(3)


def empty(spark):
    return docs(spark, [])
