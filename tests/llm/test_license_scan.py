import random
import re

import pytest

from sitesieve.llm import license_scan as L

from .cases import docs, empty, texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LINES = [
    "Released under the MIT License.", "MIT-License, mit license mit license", "THE APACHE LICENSE, Version 2.0", "gnu General  Public\nLicense", "license mit",
    "permit license", "mit licenses", "SPDX-License-Identifier: BSD-3-Clause", "https://www.gnu.org/licenses/gpl-3.0.html", "CC BY-NC 4.0", "amit license", "é mit license é",
    "distributed under the terms of the GNU General Public License, version 3 or later", "Mozilla Public License, v. 2.0 / Apache License", "public domain", "\u212aernel license",
]


def base(t):
    w = WORD.findall((t or "").translate(str.maketrans(L.UPPER, L.LOWER)))
    hits = [(k, label) for p, label in L.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    at = [k for k, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def detected(t):
    """The detections that no other one contains, one regular expression after the other."""
    low = re.sub(r"[ \t\n\x0b\f\r]+", " ", (t or "").lower())
    found = [(m.start(), m.end(), p, -i, label, c) for i, (label, regex, _, p, c) in enumerate(L.rules()) for m in re.finditer(regex, low)]
    order = sorted(found, key=lambda d: (d[0], -d[1], -d[2], -d[3]))
    return [d for k, d in enumerate(order) if not any(e[2] >= d[2] and e[1] >= d[1] for e in order[:k])]


def cases():
    rng = random.Random(7)
    rows = texts()
    for i in range(150):
        rows.append((2000 + i, rng.choice([" ", "\n", ". "]).join(rng.choice(LINES + ["plain words here"]) for _ in range(rng.randrange(1, 7)))))
    return rows + [(5000, "mit license " * 5000), (5001, LINES[0])]


def test_base_and_rules_equal_brute_force(spark):
    rows = cases()
    got = L.scan(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    seen = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str)
    assert seen == sorted(((i, *base(t)) for i, t in rows), key=str)
    own = {i: t for i, t in rows if i is not None and i != 5000}
    for r in got:
        if r.doc_id not in own:
            continue
        kept = detected(own[r.doc_id])
        labels = {d[4] for d in kept} | set(filter(None, r.base_labels.split(",")))
        assert r.labels == ",".join(sorted(labels)), own[r.doc_id]
        assert r.n_detections == len(kept) and r.score == max([d[5] for d in kept], default=0.5 if labels else 0.0)
    long = next(r for r in got if r.doc_id == 5000)
    assert (long.n_base, long.first_word, long.last_word, long.labels) == (5000, 0, 9998, "mit")


def test_suppression(spark):
    t = "Distributed under the terms of the GNU General Public License, version 3. See the MIT license."
    got = sorted((r.label, t.lower()[r.start : r.end]) for r in L.detections(docs(spark, [(1, t)])).collect())
    assert got == [("gpl-3.0", "distributed under the terms of the gnu general public license, version 3"), ("mit", "mit license")]


WRAPPED = ["released into the public\ndomain", "Creative\nCommons Zero", "CC  BY 4.0", "CC\tBY-SA\n4.0", "Creative  Commons Attribution\n4.0", "dedicated to  the\r\npublic  domain"]


def test_names_with_line_breaks_and_double_spaces(spark):
    rows = list(enumerate(WRAPPED))
    got = {r.doc_id: r for r in L.scan(docs(spark, rows)).collect()}
    spans = sorted((r.doc_id, r.label, r.start, r.end) for r in L.detections(docs(spark, rows)).collect())
    for i, t in rows:
        kept = detected(t)
        assert kept and got[i].labels == ",".join(sorted({d[4] for d in kept})), t
        assert got[i].n_detections == len(kept) and got[i].score == max(d[5] for d in kept)
    assert spans == sorted((i, d[4], d[0], d[1]) for i, t in rows for d in detected(t))


GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
MIT = GRANT + ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
TWO = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
NEITHER = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED"
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
UNTITLED = [
    ("mit", MIT), ("mit-0", GRANT + ". THE SOFTWARE IS PROVIDED"), ("x11", MIT + " Except as contained in this notice, the name of the X Consortium shall not be used"),
    ("ncsa", GRANT.replace("deal in", "deal with")), ("isc", ISC + ", provided that the above copyright notice and this permission notice appear in all copies."), ("0bsd", ISC + ". THE SOFTWARE IS PROVIDED"),
    ("bsd-2-clause", BSD + TWO + "THIS SOFTWARE IS PROVIDED"), ("bsd-3-clause", BSD + TWO + "3. " + NEITHER), ("bsd", BSD),
    ("bsd-4-clause", BSD + TWO + "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: by X. 4. " + NEITHER),
    ("clear-bsd", BSD.replace("permitted", "permitted (subject to the limitations in the disclaimer below)") + TWO + "* " + NEITHER),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable"), ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("gpl-2.0", GNU.format("", 2)), ("gpl-3.0", GNU.format("", 3)), ("lgpl-2.1", GNU.format("Lesser ", 2.1)), ("agpl-3.0", GNU.format("Affero ", 3)),
    ("gpl-2.0", "GPL v2"), ("gpl-2.0", "GPL-2.0+"), ("gpl", "GNU GPL"), ("gpl-3.0", "GPL-3.0-or-later"), ("gpl-3.0", "the GNU GPL, version 3"), ("lgpl-2.1", "LGPL-2.1-only"), ("agpl-3.0", "AGPLv3"),
    ("apache-2.0", "Apache-2.0"), ("apache-2.0", "Apache v2.0"), ("bsd-3-clause", "BSD-3-Clause"), ("bsd-2-clause", "2-clause BSD"), ("mpl-2.0", "MPL 2.0"), ("epl-1.0", "EPL-1.0"), ("mit", "MIT-licensed"),
]


def test_untitled_notices_and_short_forms(spark):
    rows = [(i, t.replace(" ", "\n" if i % 2 else "  ", 9)) for i, (_, t) in enumerate(UNTITLED)]
    rows += [(100, "example 2.0, simple 2.0, the gplus 2, GPL 2.5 and Apache 1.3")]
    got = {r.doc_id: r for r in L.scan(docs(spark, rows)).collect()}
    for i, t in rows:
        expected = UNTITLED[i][0] if i < 100 else ""
        kept = [] if i == 100 else [d[4] for d in detected(t)]
        assert got[i].labels.split(",") == sorted({*kept, *filter(None, got[i].base_labels.split(","))}) or i == 100, t
        assert set(got[i].labels.split(",")) - set(filter(None, got[i].base_labels.split(","))) <= {expected, ""} and expected in got[i].labels.split(","), (t, got[i].labels)


def test_hand_written_rules_hold_their_keyword():
    for label, regex, keyword in L.NOTICES + L.SHORT_FORMS:
        plain = regex.replace("[- ]", " ").replace("[cs]", "s").replace("\\", "").replace("(?:", "").replace(")?", "").replace("?", "")
        assert keyword in plain or keyword in regex.replace("\\", ""), (label, keyword)


def test_empty_table(spark):
    assert L.scan(empty(spark)).collect() == []


@pytest.mark.parametrize("rule", L.rules(), ids=lambda r: "")
def test_every_rule_needs_its_keyword_and_an_anchor(rule):
    label, regex, keyword, _, _ = rule
    assert 0 < rule[3] <= L.LEVELS
    body = regex.removeprefix(r"(?<![\w-])").removesuffix(r"(?![\w])")
    sample = re.sub(r"\(\?:https\?://\)\?\(\?:www\\\.\)\?", "", body)
    assert any(a.replace("licen", "licen") in sample.replace("\\", "").replace("[- ]", " ").replace("[cs]", "s") for a in L.ANCHORS), regex


def test_more_than_two_hundred_rules():
    assert len(L.rules()) > 200 and len(L.LICENSES) < 200
