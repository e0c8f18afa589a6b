import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sitesieve.llm import token_alignment as A

from .cases import docs, empty, texts

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


def byte_level():
    """Byte of each character of a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute(rows):
    own, sp, byte = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1]), byte_level()
    own.encode_special_tokens = True
    found = []
    for doc_id, text in rows:
        a = own.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        a_bytes = [bytes(byte[c] for c in own.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            found.append((doc_id, [], [], [], ""))
            continue
        ends = lambda parts: [sum(map(len, parts[: i + 1])) for i in range(len(parts))] if len(parts) < 300 else list(running(parts))
        ends_a, ends_b = ends(a_bytes), ends(b_bytes)
        both = sorted(set(ends_a) & set(ends_b))
        at_a, at_b = dict(zip(ends_a, a)), dict(zip(ends_b, b))
        links = [(at_a[e], at_b[e]) for e in both]
        groups, i, j = [], 0, 0
        for e in both:
            left, right = [], []
            while i < len(a) and ends_a[i] <= e:
                left.append(str(a[i])), (i := i + 1)
            while j < len(b) and ends_b[j] <= e:
                right.append(str(b[j])), (j := j + 1)
            groups.append(",".join(left) + "|" + ",".join(right))
        found.append((doc_id, a, b, links, ";".join(groups)))
    counts = Counter(x for f in found for x in f[3])
    top = Counter()
    for (a, b), n in counts.items():
        top[b] = max(top[b], n)
    return sorted(((i, len(a), len(b), len(links), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), groups)
                   for i, a, b, links, groups in found), key=str)


def running(parts):
    total = 0
    for p in parts:
        total += len(p)
        yield total


AWKWARD = ["<|endoftext|> and <s> or </s> <unk> <0x41>", "a▁b", "▁", " leading", "  two\n\n\nlines\t\ttabs ", "漢字 😀 ǅ ȿ", "\x00nul", "x" * 5000, "…“quotes”", " ", "\n", "é ​ zero"]


def fuzz(n=150):
    rng = random.Random(4)
    alphabet = ["a", "the", " ", "  ", "\n", "é", "漢", "1", "23", "<s>", "'s", "😀", "Ω", "\t", "un", "able", "."]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 25))) for _ in range(n)]


@pytest.mark.parametrize("share", [A.SHARE, 20])
def test_equals_brute_force(spark, share):
    """With all counts sent to the tasks, and with all but the most frequent joined."""
    rows = [(i, t[:40_000] if t else t) for i, t in texts()] + list(enumerate(AWKWARD + fuzz(), 1000))
    out = A.alignment_scores(docs(spark, rows), *PATHS, share=share)
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert A.alignment_scores(empty(spark), *PATHS).collect() == []
    out = A.alignment_scores(docs(spark, [(1, None), (2, "")]), *PATHS).collect()
    assert sorted(map(tuple, out)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_query(spark):
    from sitesieve.llm.queries import QUERIES

    out = QUERIES["op12_token_alignment"](spark, "/root/testdata/sf0.001")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    expected = {(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in brute(rows)}
    assert out.columns[-1] == "groups_sha256" and {tuple(r) for r in out.collect()} == expected
