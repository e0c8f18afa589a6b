import base64
import gzip
import hashlib
import random

import pytest

from sitesieve.llm import warc as W
from sitesieve.llm.common import work_path

PAGES = "page_id long, url string, html string, file string, offset int, sha1 string, first int, n int"


def pages():
    rng = random.Random(3)
    rows = [(i, f"http://x/{i}", rng.choice(["", None, "same", f"<p>é {i}</p>" * rng.randrange(1, 400), "big" * 50_000])) for i in range(200)]
    return rows + [(500, None, "line\r\n\r\nbreak"), (501, "http://a\r\nb", "url break"), (502, "u", "WARC/1.1\r\n"), (None, "n", "only null"), (None, "n", "only null"), (None, "n", "same"), rows[0], (503, "u", "漢" * 1000)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "f", 1, "s", 2, 3) for r in rows], PAGES).repartition(4)


def expected(rows):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = max(first.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        top = first.get(html or "")
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == top or top is None else "revisit", None if i == top else top))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = pages()
    index = W.write_archives(frame(spark, rows), work_path(spark, "warc"))
    got = W.read_records(index).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)
    html = {i: h or "" for i, _, h in rows}
    for r in got:
        if r.record_type == "response" and r.page_id is not None:
            assert bytes(r.payload).decode() == html[r.page_id]
        if r.record_type == "revisit":
            assert r.payload is None


def test_files_are_plain_gzip_and_selections_read_alone(spark):
    folder = work_path(spark, "warc")
    index = W.write_archives(frame(spark, pages()), folder)
    entries = sorted((r.file, r.offset, r.length) for r in index.collect())
    for file in {f for f, _, _ in entries}:
        fs, path = W.file_system(file)
        with fs.open_input_stream(path, compression=None) as f:
            raw = f.read()
        own = [(o, n) for f, o, n in entries if f == file]
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) == len(raw)
        assert gzip.decompress(raw).count(b"WARC/1.1\r\nWARC-Type: ") == len(own)
    some = index.where("page_id % 7 = 0")
    assert {r.page_id for r in W.read_records(some).collect()} == {r.page_id for r in some.collect()}
    assert W.read_records(index.where("false")).collect() == []


def test_empty_table(spark):
    index = W.write_archives(frame(spark, []), work_path(spark, "warc"))
    assert W.read_records(index).collect() == []


def test_neighbouring_ranges_are_one_request():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 20 + W.GAP_BYTES, 5), ("a", 26 + 2 * W.GAP_BYTES, 5), ("b", 0, 5), ("b", 5, W.REQUEST_BYTES)]
    assert [len(r) for r in W._ranges(rows)] == [3, 1, 1, 1]


def test_damage_is_an_error():
    data = W.record(1, "u", "response", None, b"abc", 3, "X")
    assert W.parse(data)[1] == b"abc"
    with pytest.raises(ValueError):
        W.parse(data[:-1])
