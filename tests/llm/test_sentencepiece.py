import random

import public_tokenizers
import pyarrow as pa
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from sitesieve.llm import sentencepiece_fst as S

from .cases import docs, empty, texts

PATH = public_tokenizers.path("piece_bpe_32k.model")
FST = S.Transducer(PATH)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_documents_equal_the_library(spark):
    rows = texts()
    got = S.decode(S.encode(docs(spark, rows), PATH), PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == LIBRARY.encode(r.text or "") and r.decoded == (r.text or "")


def test_empty_table_and_null_ids(spark):
    assert S.encode(empty(spark), PATH).collect() == []
    out = S.decode(spark.createDataFrame([(1, None, "x"), (2, [], "y")], "doc_id long, ids array<int>, decoded string"), PATH).collect()
    assert {r.doc_id: r.decoded for r in out} == {1: None, 2: ""}


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_equals_the_library(t):
    assert FST.encode([t]).to_pylist() == [LIBRARY.encode(t)]


def test_random_runs_equal_the_library():
    rng = random.Random(5)
    alphabet = "aabcdeest ▁ ▁\n\t.,-_09éßñ漢字́😀'\"(){}= "
    pieces = FST.text[300:9000:37]
    t = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(24))) for _ in range(4000)]
    t += ["".join(rng.choice(pieces) for _ in range(rng.randrange(8))) for _ in range(4000)]
    t += [" " * n + "x" * m for n in range(40) for m in (0, 1, 17, 40)]
    ids = FST.encode(t).to_pylist()
    assert ids == LIBRARY.encode(t)
    assert FST.decode(pa.array(ids, pa.list_(pa.int32()))).to_pylist() == LIBRARY.decode(ids)


def test_full_caches_start_anew(monkeypatch):
    monkeypatch.setattr(S, "CACHE", 50)
    monkeypatch.setattr(S, "SLOTS", 6)
    fst, rng = S.Transducer(PATH), random.Random(9)
    t = [" ".join("".join(rng.choice("abcdeinrst") for _ in range(rng.randrange(1, 12))) for _ in range(30)) for _ in range(60)]
    assert [y for i in range(0, 60, 7) for y in fst.encode(t[i : i + 7]).to_pylist()] == LIBRARY.encode(t)
    assert len(fst.paths) < 50 + 7 * 31


def test_merging_gives_each_shortest_path_one_finite_weight():
    """The compatibility of neighbours decides the segmentation: no second path exists."""
    rng = random.Random(1)
    for _ in range(200):
        s = "▁" + "".join(rng.choice("abcdeinrst") for _ in range(rng.randrange(1, 7)))
        paths = []

        def walk(at, path):
            if at == len(s):
                paths.append(path)
            for end in range(at + 1, len(s) + 1):
                t = FST.piece.get(s[at:end])
                if t is not None and FST.merged(([FST.text[path[-1]]] if path else []) and list(FST.text[path[-1]] + s[at:end]) or list(s[at:end])) == [*([FST.text[path[-1]]] if path else []), s[at:end]]:
                    walk(end, [*path, t])

        walk(0, [])
        assert paths == [LIBRARY.encode(s[1:])]
