import hashlib
import re

import pytest

from clausewise.llm import private_data as P

#: The expressions as they are given; the operator uses guarded forms.
GIVEN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    "a@b.c_d@e.f x", "aa..b@c.d.", "é😀 1.2.3.4 +1 (988) 555-2485 4041894974608795 x", "256.1.1.1 0001.2.3.4 1.2.3.4.5 1.2.3.4.5.6.7.8",
    "4111-1111 1111 1111 2", "+1+12345678 +12 34-", "", None, "x@y", "a@b-c.d-e 1.2.3.4@x.y", "+1234567890.12.3.4", "0" * 20 + " " + "0" * 16, "1 " * 40,
    "4111 1111 1111 1111", "\x01 a@b.c \x02", "000.000.0.0 99999999999999999999.1.1.1", "1" * 30_000 + " a@b.cd", "a" * 30_000 + "@b", "+" * 500 + "1 234 567 89",
]


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute(text):
    out = []
    for kind, expression in GIVEN.items():
        for m in re.finditer(expression, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


@pytest.mark.parametrize("clash", [False, True])
def test_base_matches_brute_force(docs_of, clash):
    rows = P.find(docs_of(list(enumerate(TEXTS)) + [(0, TEXTS[0]), (None, TEXTS[2])], clash)).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        want = brute(TEXTS[2 if r.doc_id is None else r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in GIVEN]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert r.spans == ",".join(want) and r.n_more == 0


def bootstrapped():
    seeds = [(i, f"aa bb{i % 7} customer number is +1 (988) 555-{1000 + i}, thanks") for i in range(30)]
    unseen = [(100 + i, f"my Customer  Number is 555-{2000 + i} thanks") for i in range(3)]
    others = [(200 + i, f"aa order code is 555-{7000 + i} thanks") for i in range(3)]
    wrong = [(300, "the customer number is unknown2you thanks")]
    return seeds + unseen + others + wrong


def test_patterns_find_unseen_identifiers(docs_of):
    rows = {r.doc_id: r for r in P.find(docs_of(bootstrapped())).collect()}
    assert {i for i, r in rows.items() if r.n_more} == {100, 101, 102}
    assert rows[100].spans == "phone:23:31" and rows[100].n_phone == 0


def test_rare_patterns_are_not_believed(docs_of):
    rows = P.find(docs_of([(1, "her number is +1 (988) 555-1000 ok"), (2, "her number is 555-2000 ok")])).collect()
    assert sum(r.n_more for r in rows) == 0


def test_redaction(docs_of):
    docs = docs_of(bootstrapped() + [(400, None), (401, ""), (402, "plain"), (403, "+1234567890.12.3.4 é😀 a@b.c"), (403, "+1234567890.12.3.4 é😀 a@b.c")], clash=True)
    out = P.redact(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == docs.count()
    assert got[100].text == "my Customer  Number is <PHONE> thanks" and got[100].n_chars == len(got[100].text)
    assert got[0].text == "aa bb0 customer number is <PHONE>, thanks"
    assert (got[400].text, got[401].text, got[402].text, got[402].n_chars) == (None, "", "plain", 5)
    assert got[403].text == "<PHONE> é😀 <EMAIL>"


def test_plan_has_no_python(docs_of):
    plan = P.find(docs_of(bootstrapped()))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow", plan)


def test_empty(docs_of):
    assert P.find(docs_of([])).count() == 0 and P.redact(docs_of([])).count() == 0
