import os
import random
import subprocess
import sys
import zlib

import pytest

from clausewise.llm import toxicity as T

BAD = ["moron", "idiot", "worthless", "pathetic"]


def corpus(n=900, seed=3):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.choice([3, 40, 400]))]
        toxic = i % 4 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", ".", "!"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def scored(llm_spark, docs_of):
    docs, labels = corpus()
    table = llm_spark.createDataFrame([(i, 1, t) for i, t in labels] + [(None, 1, 1), (0, 1, None), (5000, 0, 1)], "doc_id long, quality int, toxic int")
    extra = [(7000, "he is a morron here"), (7001, None), (7002, ""), (7003, "blue sugar"), (7005, "你好 世界"), (None, "an idiot"), (7004, "x " * 60_000 + "idiot")]
    docs_df = docs_of(docs + extra + [extra[0]], clash=True)
    return labels, T.score(docs_df, table).collect(), docs_df, table


def test_held_out_accuracy(scored):
    labels, rows, _, _ = scored
    by = {r.doc_id: r for r in rows}
    out = [(i, t) for i, t in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(out) > 200 and all(by[i].held_out for i, _ in out) and not any(by[i].held_out for i, _ in labels if (i, _) not in out)
    right = sum(by[i].predicted == t for i, t in out)
    assert right / len(out) > 0.97


def test_defined_results(scored):
    _, rows, _, _ = scored
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 908 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert by[7001].score == by[7002].score == 0
    assert by[7004].predicted == 1
    assert by[7000].score > 5 * by[7003].score  # a misspelling that was never seen
    assert by[7003].predicted == by[7005].predicted == 0  # words that were never seen


def test_filter_keeps_columns(scored):
    _, rows, docs, labels = scored
    kept = T.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if not r.predicted)


def test_without_labels(llm_spark, docs_of):
    none = llm_spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in T.score(docs_of([(1, "moron")]), none).collect()] == [0.0]
    assert T.score(docs_of([]), none).count() == 0
    assert T.without_toxic(docs_of([(1, "moron")]), none).count() == 1


def test_oversized_text_first(llm_spark, docs_of, monkeypatch):
    """A text above the byte budget at the first hash place, and repeated rows and ids, leave the rest of the sample alone."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(T, "SAMPLE_BYTES", 1 << 20)
    docs, labels = corpus(300)
    table = llm_spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int")
    order = [r.doc_id for r in table.filter(~T.held_out(F.col("doc_id"), 3, 1)).orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    huge, second = order[0], order[1]
    docs = [(i, "blue " * 300_000 if i == huge else x) for i, x in docs]
    plain, learnt = T.labelled_sample(docs_of(docs), table)
    assert [len(x) for x in plain.to_pylist()] == [len(dict(docs)[i]) for i in order[1:]] and set(learnt.tolist()) == {0, 1}
    again = docs_of(docs + [d for d in docs if d[0] == second] * 700 + [(order[2], "another text"), (huge, "blue sky")])
    texts, toxic = T.labelled_sample(again, table)
    assert len(texts) == len(toxic) == len(order) and texts[0].as_py() == "blue sky"
    assert texts.to_pylist()[3:] == plain.to_pylist()[2:]
    assert T.labelled_sample(again.repartition(7), table)[0].equals(texts)
    # the same scores as if the text were not there
    scores = lambda rows: {r.doc_id: r.score for r in T.score(docs_of(rows), table).collect() if r.doc_id != huge}
    found = scores(docs)
    assert found == pytest.approx(scores([d for d in docs if d[0] != huge]), abs=1e-6) and max(found.values()) > 0.7


def test_training_leaves_no_memory_in_the_driver():
    """What training took stayed with the process: 52 MB for this sample, 195 MB for one of 6,242 texts of check_s."""
    code = """
import random, re
import numpy as np, pyarrow as pa
from clausewise.llm import toxicity as T

def held():
    return sum(map(int, re.findall(r"Pss_(?:Anon|Shmem): +([0-9]+)", open("/proc/self/smaps_rollup").read()))) / 1024

def sample(docs, labels):
    rng = random.Random(1)
    plain = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(40000)]
    texts = [" ".join(rng.choice(plain) for _ in range(400)) + " idiot" * (i % 9 == 0) for i in range(1500)]
    return pa.array(texts), np.array([int(i % 9 == 0) for i in range(1500)])

T.labelled_sample = sample
before = held()
assert T.learnt(None, None) is not None
print(held() - before)
"""
    env = {**os.environ, "PYTHONPATH": os.path.join(os.path.dirname(__file__), "..", "..")}
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=env, check=True).stdout
    assert float(out) < 30
