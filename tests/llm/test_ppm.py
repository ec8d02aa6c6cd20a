import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from clausewise.llm import ppm as P

TEXTS = ["abracadabra abc", "ABCab  x", "", None, "éa b", "abab abab", "abracadabra abc", "q" * 3000 + " tail", "the cat sat", "the cat ran", "a\tcat\vnap"] + [f"the dog {i} ran {i * 37}" for i in range(40)]


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(train, test):
    counts = defaultdict(Counter)

    def line(t):
        return [P.START] * P.ORDER + list(low(t).encode()) + [P.END]

    for t in train:
        s = line(t)
        for i in range(P.ORDER, len(s)):
            for k in range(P.ORDER + 1):
                counts[tuple(s[i - k : i])][s[i]] += 1
    out = []
    for t in test:
        s, total = line(t), 0.0
        for i in range(P.ORDER, len(s)):
            barred = set()
            for k in range(P.ORDER, -1, -1):
                seen = counts.get(tuple(s[i - k : i]))
                if seen is None:
                    continue
                here = {a: n for a, n in seen.items() if a not in barred}
                whole = sum(here.values()) + len(here)
                if s[i] in here:
                    total += math.log10(here[s[i]] / whole)
                    break
                if here:
                    total += math.log10(len(here) / whole)
                barred |= set(here)
            else:
                total -= math.log10(P.SYMBOLS - len(barred))
        out.append(total)
    return out


@pytest.mark.parametrize("nodes, frequent", [(P.BLOCK_NODES, P.FREQUENT), (60, 5)])
def test_matches_brute_force(docs_of, nodes, frequent):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1, TEXTS[1])]
    got = P.score(docs_of(rows, clash=True), block_nodes=nodes, frequent=frequent).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    train = [t for i, t in rows if not held(i)]
    assert len(got) == len(rows) and any(held(i) for i, _ in rows)
    want = dict(zip([i for i, _ in rows], brute(train, [t for _, t in rows]), strict=True))
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", low(t))
    count = Counter(w for t in train for w in split(t))
    tokens, kinds = sum(count.values()) + len(train), len(count) + 1
    for r in got:
        words = split(TEXTS[r.doc_id])
        base = sum(math.log10((count[w] + 1) / (tokens + kinds + 1)) for w in words) + math.log10((len(train) + 1) / (tokens + kinds + 1))
        assert r.held_out == held(r.doc_id) and r.train_tokens == tokens and r.n_tokens == len(words) + 1
        assert r.n_known == sum(count[w] > 0 for w in words) + 1
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, want[r.doc_id], rel_tol=1e-9)


def test_nothing_to_learn_from(docs_of):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = P.score(docs_of([(held, "ab")])).first()
    assert math.isclose(row.score, -3 * math.log10(P.SYMBOLS)) and row.n_known == 0 and row.train_tokens == 0 and row.base_score == 0
    assert P.score(docs_of([])).count() == 0
