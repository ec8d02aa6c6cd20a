"""Licence scan: phrases and identifier tags found by one Aho-Corasick pass, licence expressions by a shunting yard.

A text is lower-cased (A-Z) and cut into words, runs of ASCII letters, digits and anything beyond ASCII. The words,
joined by single spaces, run through the automaton once. Phrases match where all their words stand in a row.
A tag (``SPDX-License-Identifier:``) is followed, in the original text, by an expression up to the end of its line:
identifiers joined by AND, OR and WITH and grouped by parentheses, where WITH binds closest, then AND. A malformed
expression gives the identifiers that it has and no value. Null and empty texts have no words and no labels; a row
comes back for every row, repeated ones too.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm.textkit import slices

#: The base phrases, and further notices with their label.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "boost software license": "bsl",
    "this is free and unencumbered software": "unlicense",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
PERMISSIVE = ("mit", "apache", "bsd", "isc", "cc-by", "cc0", "bsl", "unlicense", "zlib", "0bsd", "ofl")
RANK = {"or": 1, "and": 2, "with": 3}
TAG_LINE = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)")
TOKEN = re.compile(r"\(|\)|[a-z0-9][a-z0-9.+:-]*")

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "expression string, permissive boolean"
)


def family(name: str) -> str:
    """The label of an identifier: its name without version and suffix."""
    name = re.sub(r"-(only|or-later)$", "", name.rstrip("+"))
    return re.sub(r"-?v?\d+(\.\d+)*(-clause)?$", "", name) or name


def parse(tokens: list[str]) -> list[str] | None:
    """Postfix form of an expression by the shunting-yard method; None if it is malformed."""
    out, waiting, operand = [], [], True
    for token in tokens:
        if token == "(":
            if not operand:
                return None
            waiting.append(token)
        elif token == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting or operand:
                return None
            waiting.pop()
        elif token in RANK:
            if operand:
                return None
            while waiting and waiting[-1] != "(" and RANK[waiting[-1]] >= RANK[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand = True
        else:
            if not operand:
                return None
            out.append(token)
            operand = False
    if operand or "(" in waiting:
        return None
    return out + waiting[::-1]


def evaluate(postfix: list[str]) -> tuple[bool, str]:
    """Whether a permissive choice satisfies the expression, and the expression with its grouping written out."""
    stack = []
    for token in postfix:
        if token in RANK:
            right, left = stack.pop(), stack.pop()
            value = left[0] or right[0] if token == "or" else left[0] if token == "with" else left[0] and right[0]
            stack.append((value, f"({left[1]} {token} {right[1]})"))
        else:
            stack.append((family(token) in PERMISSIVE, token))
    return stack[0]


def tag_expressions(text: str) -> list[tuple[list[str], list[str] | None]]:
    """Tokens and postfix form of every tagged expression; text after a complete expression on the line is left out."""
    found = []
    for line in TAG_LINE.findall(text):
        tokens, depth, operand = [], 0, True
        for token in TOKEN.findall(line):
            plain = token not in RANK and token not in "()"
            if not operand and plain and not depth:
                break
            depth += (token == "(") - (token == ")")
            tokens.append(token)
            operand = not (plain or token == ")")
        if tokens:
            found.append((tokens, parse(tokens)))
    return found


def automaton() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for phrase, (label, kind) in ({p: (v, "notice") for p, v in NOTICES.items()} | {p: (v, "base") for p, v in BASE.items()} | {TAG: ("", "tag")}).items():
        machine.add_word(f" {phrase} ", (len(phrase), label, kind))
    machine.make_automaton()
    return machine


_SPACED = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def scan_text(raw: bytes, machine: ahocorasick.Automaton) -> tuple:
    """The columns after doc_id for one text."""
    spaced = raw.translate(_SPACED).split()
    line = f" {b' '.join(spaced).decode()} "
    starts, base, more, tagged = [], set(), set(), False
    for end, (size, label, kind) in machine.iter(line):
        if kind == "base":
            starts.append(end - size)
            base.add(label)
        elif kind == "notice":
            more.add(label)
        else:
            tagged = True
    first = last = expression = permissive = None
    score = 0.9 if base else 0.7 if more else 0.0
    if starts:
        first, last = line.count(" ", 0, min(starts)) - 1, line.count(" ", 0, max(starts)) - 1
    if tagged:
        text = raw.decode().translate({c: c + 32 for c in range(65, 91)})
        values = []
        for tokens, postfix in tag_expressions(text):
            exception = False
            for token in tokens:
                if token not in RANK and token not in "()" and not exception:
                    more.add(family(token))
                exception = token == "with"
            if postfix:
                values.append(evaluate(postfix))
        if values:
            score = 1.0
            permissive, expression = all(v[0] for v in values), "; ".join(sorted({v[1] for v in values}))
    labels = ",".join(sorted(base | more))
    return len(spaced), len(starts), first, last, ",".join(sorted(base)), labels, score, expression, permissive


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` (and more) to one row per row: base places and labels, all labels, the tagged expression.

    ``score`` is 1 with a well-formed tag, 0.9 with a base phrase, 0.7 with another notice only, else 0.
    """

    def run(batches):
        machine = automaton()
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.string(), pa.bool_()]
        for batch in slices(batches):
            found = [scan_text(t or b"", machine) for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), *zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) if not isinstance(c, pa.Array) else c for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, SCHEMA)
