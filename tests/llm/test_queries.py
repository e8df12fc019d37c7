"""The registered corpus queries on the smallest data, and the pipeline's stages."""

import glob
import os

import duckdb
import pytest

from codebrook.llm import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, name):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = registry.queries()[name](spark, data)
    want = con.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda names, rows: sorted(str([r[names.index(c)] for c in sorted(names)]) for r in rows)
    assert key(df.columns, df.collect()) == key(columns, want.fetchall())


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, seen, data)
        assert kept.columns == docs.columns, name
        assert kept.count() <= seen.count()
        seen = kept.cache()
    packed = corpus_pipeline.STAGES[-1][1](spark, seen, data)
    assert packed.select("doc_id").distinct().count() == seen.count()
