import pytest

from clausewise.llm.textkit import prepare
from clausewise.session import tune

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Words that collide with names used inside the operators.
CLASH = {"score": 1.5, "row": 7, "size": 3, "key": "k", "seed": 5, "component": 9, "position": 2, "words": 4, "_key": "x", "turn": 1, "_doc": "d", "_bad": 1, "_spans": "s"}


@pytest.fixture(scope="session")
def llm_spark(spark):
    return prepare(tune(spark))


@pytest.fixture(scope="session")
def docs_of(llm_spark):
    def make(rows, clash=False):
        """Documents of (doc_id, text[, source]); with ``clash`` extra columns whose names the operators use inside."""
        from pyspark.sql import functions as F

        given = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src", len(r[1]) if r[1] is not None else None) for r in rows]
        df = llm_spark.createDataFrame(given, DOCS)
        if clash:
            for name, value in CLASH.items():
                df = df.withColumn(name, F.lit(value))
        return df

    return make
