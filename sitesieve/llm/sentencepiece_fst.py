"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The transducer is compiled once per task from a model of the sentencepiece library:
the normaliser (spaces to U+2581, a dummy prefix), an arc for each piece, and
for each character without a piece the arcs of its UTF-8 bytes.  A text
composed with it is a lattice from position 0 to its end, and its ids are
the shortest path in the tropical semiring (min, +).

The model at hand is byte-pair encoding, whose segmentation a sum of
piece scores does not give.  It is expressed exactly by states that
remember the last piece: the arc of piece t after piece u weighs 0 if merging the
characters of u and t gives u, t again, and infinity otherwise.  A
segmentation is the one that merging finds if and only if all its neighbours are
compatible in that sense, so exactly one path to each position has a finite weight and
the forward pass keeps one state per position.

No piece crosses certain places (before a run of spaces, around characters
of no longer piece), so the lattice is a chain of small ones, whose paths
are remembered in a bounded cache.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import per_process
from .shingles import mix

SPACE = "▁"
CACHE = 1 << 18  #: remembered segments; a full cache starts anew
SLOTS = 20  #: log2 of the remembered pairs of pieces
BATCH = 1 << 20  #: characters of the texts that are encoded together
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Transducer:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            spec = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        if spec.trainer_spec.model_type != spec.trainer_spec.BPE:
            raise ValueError("only byte-pair models have the compatibility weights used here")
        self.identity = spec.normalizer_spec.name == "identity" and not spec.normalizer_spec.remove_extra_whitespaces
        self.normaliser = model.normalize
        self.prefix = SPACE if spec.normalizer_spec.add_dummy_prefix else ""
        ids = range(model.vocab_size())
        special = {i for i in ids if model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i)}
        if any(p.type == p.USER_DEFINED for p in spec.pieces):
            raise ValueError("user-defined pieces are not supported")
        self.piece = {model.id_to_piece(i): i for i in ids if i not in special}
        self.score = {p: model.get_score(i) for p, i in self.piece.items()}
        self.text = [model.id_to_piece(i) for i in ids]
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.longest = max(map(len, self.piece))
        # what an id is in a decoded text
        self.surface = [t.replace(SPACE, " ").encode() for t in self.text]
        for i in special:
            self.surface[i] = b""
        self.surface[self.unknown] = spec.trainer_spec.unk_surface.encode()
        for b, i in self.byte.items():
            self.surface[i] = bytes([b])
        self.surface_bytes = pa.array(self.surface, pa.binary())
        # characters inside longer pieces; all others stand alone
        inner = {c for p in self.piece if len(p) > 1 for c in p}
        for c in inner - self.piece.keys():  # merged like any other; alone it becomes bytes
            self.piece[c] = len(self.text)
            self.text.append(c)
        self.segments = self._cuts()
        self.paths: dict[str, bytes] = {}  # ids as 32-bit integers
        self.width = len(self.text) + 1
        # a direct-mapped table of weights: a pair that another one displaced is worked out again
        self.fit_key, self.fit_value = np.full(1 << SLOTS, -1, np.int64), np.zeros(1 << SLOTS, bool)
        self.by_length = {}
        for k in range(1, self.longest + 1):
            own = [p for p in self.piece if len(p) == k]
            h = np.zeros(len(own), dtype=np.uint64)
            if own:
                codes = np.array(own, dtype=f"<U{k}").view(np.uint32).reshape(-1, k).astype(np.uint64)
                for i in range(k):
                    h = h * _BASE + mix(codes[:, i])
            order = np.argsort(h)
            self.by_length[k] = h[order], np.array([self.piece[p] for p in own], dtype=np.int64)[order], np.uint64(pow(int(_BASE), k, 1 << 64))
        self.inner = inner

    def _cuts(self):
        """A function that cuts a normalised text where no piece crosses.

        These places are before a run of spaces, and between a letter and anything else; letters that
        some piece joins with others count as the latter.
        """
        if any(SPACE in p.lstrip(SPACE) for p in self.piece):
            return re.compile("(?s).+").findall
        joined: set[str] = set()
        while True:
            letter = f"[^\\W\\d_{re.escape(''.join(sorted(joined)))}]"
            is_letter = re.compile(letter).match
            more = {c for p in self.piece for a, b in zip(p, p[1:]) if a != SPACE and bool(is_letter(a)) != bool(is_letter(b)) for c in (a, b) if is_letter(c)}
            if not more:
                return re.compile(f"{SPACE}*{letter}+|{SPACE}*(?:(?!{SPACE}|{letter})[\\s\\S])+|{SPACE}+").findall
            joined |= more

    def merged(self, symbols: list[str]) -> list[str]:
        """Merge neighbours, best score first and leftmost among equals."""
        symbols = list(symbols)
        while len(symbols) > 1:
            scores = [self.score.get(symbols[i] + symbols[i + 1], -np.inf) for i in range(len(symbols) - 1)]
            best = max(scores)
            if best == -np.inf:
                break
            i = scores.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def compatible(self, keys: np.ndarray) -> np.ndarray:
        """Which arcs have weight 0: a key is (u + 1) * width + t, t after u, u = -1 at the start."""
        slot = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)
        fit = self.fit_value[slot]
        new = self.fit_key[slot] != keys
        if new.any():
            unknown, inverse = np.unique(keys[new], return_inverse=True)
            found = []
            for key in unknown.tolist():
                u, t = divmod(key, self.width)
                parts = [self.text[t]] if not u else [self.text[u - 1], self.text[t]]
                found.append(self.merged("".join(parts)) == parts)
            fit[new] = np.array(found)[inverse]
            self.fit_key[slot[new]], self.fit_value[slot[new]] = keys[new], fit[new]
        return fit

    def shortest(self, words: list[str]) -> list[bytes]:
        """The paths (32-bit ids) through the lattices of runs of characters that have pieces, all lattices one position at a time.

        The state at a position only depends on the characters before it, so in sorted order
        each different beginning is worked out once.
        """
        n, width = len(words), max(map(len, words))
        order = sorted(range(n), key=words.__getitem__)
        size = np.array([len(words[i]) for i in order])
        codes = np.array([words[i] for i in order], dtype=f"<U{width}").view(np.uint32).reshape(n, width).astype(np.uint64)
        # polynomial prefix hashes name the substrings
        prefix = np.zeros((n, width + 1), dtype=np.uint64)
        for i in range(width):
            prefix[:, i + 1] = prefix[:, i] * _BASE + mix(codes[:, i])
        last, start = np.zeros((n, width + 1), np.int64), np.zeros((n, width + 1), np.int64)
        for i in range(1, width + 1):
            reach = np.flatnonzero(size >= i)
            first = np.ones(len(reach), dtype=bool)
            first[1:] = prefix[reach[1:], i] != prefix[reach[:-1], i]
            left = each = reach[first]
            for k in range(min(i, self.longest), 0, -1):
                hashes, pieces, power = self.by_length[k]
                if not len(left):
                    break
                if not len(hashes):
                    continue
                h = prefix[left, i] - prefix[left, i - k] * power
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = np.flatnonzero(hashes[at] == h)
                t = pieces[at[hit]]
                hit_rows = left[hit]
                good = self.compatible(last[hit_rows, i - k] * self.width + t)
                last[hit_rows[good], i], start[hit_rows[good], i] = t[good] + 1, i - k
                left = np.delete(left, hit[good])
            if len(left):
                raise AssertionError(f"no path to position {i} of {words[order[left[0]]]!r}")
            group = np.cumsum(first) - 1
            last[reach, i], start[reach, i] = last[each, i][group], start[each, i][group]
        # all paths at once, from their ends; ``steps`` has the last pieces first
        rows, at, steps = np.arange(n), size.copy(), []
        while at.any():
            steps.append(np.where(at > 0, last[rows, at] - 1, -1))
            at = start[rows, at]
        pieces = np.array(steps[::-1], dtype="<i4").T
        count = (pieces >= 0).sum(axis=1).tolist()
        data, wide = pieces.tobytes(), 4 * len(steps)
        out = [b""] * n
        for row, (i, m) in enumerate(zip(order, count)):
            end = (row + 1) * wide
            out[i] = data[end - 4 * m : end]
        return out

    def fallback(self, c: str) -> tuple[int, ...]:
        return tuple(self.byte[b] for b in c.encode()) if self.byte else (self.unknown,)

    def solve(self, segments: list[str]) -> None:
        """Put the paths of ``segments`` into the cache."""
        # characters that no longer piece holds are lattices of one arc
        inner = self.inner.issuperset
        whole = [s for s in segments if inner(s)]
        parts = {s: list(_runs(s, self.inner)) for s in segments if not inner(s)}
        runs = whole + list({r for p in parts.values() for known, r in p if known} - set(whole))
        # lattices of about equal length go together
        runs.sort(key=len)
        paths, i = {}, 0
        while i < len(runs):
            j = i + 1
            while j < len(runs) and len(runs[j]) <= max(8, 2 * len(runs[i])):
                j += 1
            paths.update(zip(runs[i:j], self.shortest(runs[i:j])))
            i = j
        if len(self.text) > len(self.surface):  # characters that only occur inside pieces become bytes
            own = lambda t: (t,) if t < len(self.surface) else self.fallback(self.text[t])
            paths = {r: _ids(i for t in np.frombuffer(path, "<i4").tolist() for i in own(t)) for r, path in paths.items()}
        self.paths.update((s, paths[s]) for s in whole)
        for s, p in parts.items():
            alone = lambda c: (self.piece[c],) if c in self.piece else self.fallback(c)
            self.paths[s] = b"".join(paths[run] if known else _ids(i for c in run for i in alone(c)) for known, run in p)

    def encode(self, texts: list[str]) -> pa.ListArray:
        """The ids of each text."""
        if self.identity:
            texts = [self.prefix + t.replace(" ", SPACE) if t else "" for t in texts]
        else:
            texts = [self.normaliser(t) for t in texts]
        cut = [self.segments(t) for t in texts]
        wanted = set().union(*cut)
        new = wanted - self.paths.keys()
        if len(self.paths) + len(new) > CACHE:
            self.paths.clear()
            new = wanted
        if new:
            self.solve(list(new))
        ids = [b"".join(map(self.paths.__getitem__, c)) for c in cut]
        offsets = np.cumsum([0, *(len(x) // 4 for x in ids)])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The texts of lists of ids; null lists are null, bytes that are no UTF-8 become U+FFFD."""
        flat = pa.ListArray.from_arrays(ids.offsets, self.surface_bytes.take(ids.values), mask=ids.is_null()) if len(ids) else pa.array([], pa.list_(pa.binary()))
        joined = pc.binary_join(flat, b"")
        try:
            texts = joined.cast(pa.string())
        except pa.ArrowInvalid:
            texts = pa.array([None if x is None else x.decode(errors="replace") for x in joined.to_pylist()], pa.string())
        if self.prefix:
            texts = pc.if_else(pc.starts_with(texts, " "), pc.utf8_slice_codeunits(texts, 1), texts)
        return texts


def _ids(ids) -> bytes:
    return np.fromiter(ids, dtype="<i4").tobytes()


def _runs(s: str, inside: set) -> Iterator[tuple[bool, str]]:
    """Runs of characters that are in ``inside`` or not."""
    if inside.issuperset(s):
        yield True, s
        return
    a = 0
    for i in range(1, len(s) + 1):
        if i == len(s) or (s[i] in inside) != (s[a] in inside):
            yield s[a] in inside, s[a:i]
            a = i


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs``' doc_id and ``text`` with ids, the pieces of the whole text; none for a null or empty text.

    Repeated rows and null doc_ids stay rows of their own; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = per_process(("sentencepiece", path), lambda: Transducer(path))
        for batch in batches:
            i = 0
            while i < len(batch):  # the ids of a few texts are in memory at once
                texts, chars = [], 0
                while i + len(texts) < len(batch) and len(texts) < 1000 and chars < BATCH:
                    texts.append(batch.column(1)[i + len(texts)].as_py() or "")
                    chars += len(texts[-1])
                part = batch.slice(i, len(texts))
                i += len(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), fst.encode(texts)], names=["doc_id", text, "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, f"doc_id long, {text} string, ids array<int>")


def decode(rows: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``rows`` with the text ``to`` of their ``ids``; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = per_process(("sentencepiece", path), lambda: Transducer(path))
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                column = pa.concat_arrays([part.column(ids)])  # offsets from 0 on
                yield pa.RecordBatch.from_arrays([*part.columns, fst.decode(column)], names=[*part.schema.names, to])

    rows = rows.drop(to)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(to, T.StringType())]))
