import importlib.util

import pytest

import corpus_pipeline as C
from clausewise.llm import queries as Q

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    from __spark_entry__ import queries

    names = list(queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert importlib.util.find_spec("clausewise.llm") is not None


def test_stages_and_run(llm_spark):
    from clausewise.session import materialise

    docs = llm_spark.read.parquet(f"{SF}/documents.parquet")
    columns, step, kept = docs.columns, docs, []
    for name, stage in C.STAGES:
        step = materialise(stage(llm_spark, step, SF))
        assert step.columns[: len(columns)] == columns and (name == "mixing" or step.columns == columns)
        kept.append(step.select("doc_id").distinct().count())
    assert kept == sorted(kept, reverse=True) and kept[-1] > 100
    key = ["doc_id", "copy"]
    again = C.run(llm_spark, SF)
    assert again.select(*key, "text", "position").exceptAll(step.select(*key, "text", "position")).count() == 0


def test_stages_take_empty_tables(llm_spark, docs_of):
    for _, stage in C.STAGES:
        assert stage(llm_spark, docs_of([]), SF).count() == 0


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_sql_twin(llm_spark, name):
    import duckdb

    from check import canonical

    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    a, b = canonical(Q.QUERIES[name](llm_spark, SF).toPandas()), canonical(con.execute(Q.ORACLES[name]).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b) and (a == b).all().all()
