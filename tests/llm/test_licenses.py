import re

import pytest

from clausewise.llm import licenses as L

TEXTS = [
    None,
    "",
    "cc by cc by-SA CC  BY",
    "Licensed under the Apache License, Version 2.0. GNU General Public\nLicense; MIT license MIT-License",
    "SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 WITH LLVM-exception",
    "SPDX-License-Identifier: MIT and",
    "é MIT licensé mit license9 öMIT license",
    "gnu gnu general public license license",
    "x " * 50_000 + "mit license",
]


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    starts, labels = [], set()
    for phrase, label in L.BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


@pytest.mark.parametrize("clash", [False, True])
def test_base_places(docs_of, clash):
    rows = L.scan(docs_of(list(enumerate(TEXTS)) + [(2, TEXTS[2]), (None, TEXTS[3])], clash)).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = TEXTS[3 if r.doc_id is None else r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.labels.split(",") == sorted(set(r.labels.split(",")))


@pytest.mark.parametrize(
    "text, value, written",
    [
        ("mit or gpl-2.0 and gpl-3.0", True, "(mit or (gpl-2.0 and gpl-3.0))"),
        ("(mit or gpl-2.0) and gpl-3.0", False, "((mit or gpl-2.0) and gpl-3.0)"),
        ("gpl-2.0 with classpath-exception-2.0 or bsd-3-clause", True, "((gpl-2.0 with classpath-exception-2.0) or bsd-3-clause)"),
    ],
)
def test_expressions(text, value, written):
    assert L.evaluate(L.parse(L.TOKEN.findall(text))) == (value, written)


@pytest.mark.parametrize("text", ["mit and", "(mit", "mit)", "or mit", "mit mit", "()", "(mit) gpl"])
def test_malformed(text):
    assert L.parse(L.TOKEN.findall(text)) is None


def test_tags(docs_of):
    row = L.scan(docs_of([(1, TEXTS[4])])).first()
    assert (row.labels, row.permissive, row.score) == ("apache,gpl,mit", True, 1.0)
    row = L.scan(docs_of([(1, TEXTS[5])])).first()
    assert (row.labels, row.permissive, row.score) == ("mit", None, 0.0)


def test_empty(docs_of):
    assert L.scan(docs_of([])).count() == 0
