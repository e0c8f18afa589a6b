import random

import numpy as np
import pyarrow as pa

from sitesieve.llm import language_id as L
from sitesieve.llm.queries import QUERIES

from .cases import DOCS, docs, empty

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_contract(spark):
    got = QUERIES["op7_language_id"](spark, SF).collect()
    rows = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    langs = {r.lang for r in rows.values()}
    assert len(got) == len(rows)
    for r in got:
        letters = any(c.isalpha() for c in rows[r.doc_id].text or "")
        assert r.lang_pred in langs if letters else r.lang_pred == "und"
        assert 0 <= r.score <= 1
    held = [r for r in got if r.held_out and rows[r.doc_id].lang]
    assert sum(r.lang_pred == rows[r.doc_id].lang for r in held) >= 0.97 * len(held)


def test_counts_equal_brute_force():
    rng = random.Random(1)
    t = ["".join(rng.choice("abé  1#\n漢") for _ in range(rng.randrange(40))) for _ in range(300)] + ["", None, "a"]
    got = np.concatenate(list(L.runs(pa.array(t))))
    assert len(got) == len(t)
    for own, s in zip(got, t):
        b = "".join(c if not c.isascii() or c.islower() else " " for c in s or "").encode()
        while b"  " in b:
            b = b.replace(b"  ", b" ")
        expected = np.zeros(L.DIM, dtype=int)
        for k in (1, 2, 3):
            for i in range(len(b) - k + 1):
                h = k
                for x in b[i : i + k]:
                    h = (h * 256 + x) % 2**32
                expected[(h * 2654435761 % 2**32) >> 20] += 1
        assert (own == expected).all()


def test_awkward_rows_and_empty_tables(spark):
    assert L.identify(empty(spark), None).collect() == []
    assert L.fit(empty(spark)) is None
    d = docs(spark)
    assert {(r.lang, r.score, r.rejected) for r in L.identify(d, None).collect()} == {("und", 0.0, True)}
    model = L.fit(d)
    got = L.identify(d, model).collect()
    assert len(got) == d.count() and {r.nearest for r in got} <= {"en", "de", "und"}
    bare = spark.createDataFrame([(1, None), (2, ""), (3, "12 ## \n"), (4, "ß")], "doc_id long, text string")
    assert {r.doc_id: r.nearest == "und" for r in L.identify(bare, model).collect()} == {1: True, 2: True, 3: True, 4: False}


def test_rejection_and_rare_language(spark):
    rng = random.Random(6)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(60))
    rows = [(i, make("abcde") if i % 2 else make("vwxyz"), "aa" if i % 2 else "zz") for i in range(200)] + [(1001, make("klmno"), "kk"), (1002, make("klmno"), "kk"), (1003, make("klmno"), "kk")]
    frame = spark.createDataFrame([(i, t, k, "s", "k", "i", 1, 2, "no", "s", "c", 0) for i, t, k in rows], DOCS)
    model = L.fit(frame, per_language=20)
    assert set(model.names) == {"aa", "zz", "kk"}
    got = {r.doc_id: r for r in L.identify(frame, model).collect()}
    assert all(got[i].nearest == k and got[i].lang == k for i, _, k in rows)
    other = spark.createDataFrame([(1, make("漢字仮名交"))], "doc_id long, text string")
    r = L.identify(other, model).first()
    assert r.rejected and r.lang == "und" and r.nearest in ("aa", "zz", "kk")
