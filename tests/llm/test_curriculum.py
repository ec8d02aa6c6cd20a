import math

import pytest

from clausewise.llm import curriculum as C

ROWS = [(1, "a b c", "x"), (2, "d e", "x"), (2, "d e", "x"), (3, None, "x"), (4, "", "y"), (5, "f " * 400, "y"), (6, "g h", None), (None, "i j k", ""), (8, "l\tm\nn", "z")]


def brute_targets(sizes, weights=C.WEIGHTS, most=3):
    """Water filling by rounds."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("clash", [False, True])
def test_targets_and_taken(docs_of, clash):
    rows = C.mix(docs_of(ROWS, clash)).collect()
    assert len(rows) == len(ROWS)
    sizes = {}
    for _, text, source in ROWS:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = brute_targets(sizes)
    for r in rows:
        assert r.size == len(next(t for i, t, s in ROWS if i == r.doc_id and s == r.source) or "") or r.size <= 400
        assert r.source_size == sizes[r.source]
        assert math.isclose(r.target, want[r.source], rel_tol=1e-12)
        assert 0 <= r.taken <= 3 * r.size
    for source, target in want.items():
        taken = sum(r.taken for r in rows if r.source == source)
        assert taken == math.floor(target + 1e-9)


def test_reruns_agree_whatever_the_buckets(docs_of, monkeypatch):
    docs = docs_of([(i, "w " * (i % 7), f"s{i % 3}") for i in range(200)])
    one = sorted(map(tuple, C.mix(docs).select("doc_id", "taken", "position").collect()))
    monkeypatch.setattr(C, "BUCKET_ROWS", 1)
    two = sorted(map(tuple, C.mix(docs.repartition(5)).select("doc_id", "taken", "position").collect()))
    assert one == two


def test_positions_follow_the_schedule(docs_of):
    docs = docs_of([(i, "w w", f"s{i % 3}") for i in range(3000)])
    rows = C.mix(docs).filter("taken > 0").collect()
    for rank, early in ((0, 0.5 * (1.5 + 1.0) / 2), (1, 0.5), (2, 0.25 / 1.0)):
        mine = [r.position for r in rows if r.source_rank == rank + 1]
        # share of first copies that are due in the first half of the demand of one round
        rounds = rows and next(r.quota / r.source_size for r in rows if r.source_rank == rank + 1)
        got = sum(p < 0.5 for p in mine) / len(mine)
        assert abs(got - min(1.0, early * max(1.0, rounds))) < 0.06


def test_due_time_inverts_the_integral(llm_spark):
    from pyspark.sql import functions as F

    knots = C.SCHEDULES[2]
    df = llm_spark.range(0, 101).select((F.col("id") / 100.0).alias("u")).withColumn("t", C.due_time(F.col("u"), knots))
    for u, t in df.collect():
        area = 0.5 * t if t <= 0.5 else 0.25 + 0.5 * (t - 0.5) + 2.0 * (t - 0.5) ** 2
        assert math.isclose(area, u * 1.0, abs_tol=1e-9)


def test_mixed_documents_are_whole_and_near_what_is_taken(docs_of):
    docs = docs_of(ROWS, clash=True)
    out = C.mixed_documents(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and out.columns[len(docs.columns) :] == ["position_", "copy", "words_"]
    rows = out.collect()
    given = {(r.doc_id, r.text) for r in docs.collect()}
    assert all(len(r.text.split()) == r.words_ and (r.doc_id, r.text) in given for r in rows)
    taken, sizes = {}, {}
    for r in C.mix(docs).collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
        sizes.setdefault(r.source, []).append(r.size)
    for source, words in taken.items():
        assert abs(sum(r.words_ for r in rows if r.source == source) - words) <= max(sizes[source]) / 2
    assert [r.position_ for r in rows] == sorted(r.position_ for r in rows)


def test_the_last_copy_goes_to_the_nearer_side(docs_of):
    # targets of 6 and 13 words: 6 of 10 count as all, 3 more of 10 as none
    docs = docs_of([(1, "x " * 10, "a"), (2, "y " * 10, "b")])
    rows = sorted((r.doc_id, r.copy, r.words, r.text) for r in C.mixed_documents(docs).collect())
    assert rows == [(1, 0, 10, "x " * 10), (2, 0, 10, "y " * 10)]


def test_a_source_keeps_a_row(docs_of):
    # 33 of the 100 words of the only document of "a"
    docs = docs_of([(1, "x " * 100, "a"), (2, "y " * 50, "b"), (3, "z " * 50, "c")])
    rows = sorted((r.doc_id, r.copy, r.words) for r in C.mixed_documents(docs).collect())
    assert rows == [(1, 0, 100), (2, 0, 50), (3, 0, 50), (3, 1, 50)]


def test_empty_table(docs_of):
    assert C.mix(docs_of([])).count() == 0
    assert C.mixed_documents(docs_of([])).count() == 0


def test_texts_without_words(docs_of):
    assert {r.taken for r in C.mix(docs_of([(1, None), (2, " ")])).collect()} == {0}
