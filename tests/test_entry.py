"""The driver's contract: names, SQL that DuckDB can run, and the flagship query."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert {"family", "feature", "count"} <= set(df.columns) and df.count() > 0


@pytest.mark.parametrize("name", ["feature_stats", "confusion", "roc_auc", "transform_linear_log_quantize", "transform_ngram", "mutual_information", "score_softmax"])
def test_rows_match_sql(spark, name):
    from tools.compare import canonical

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = entry.queries()[name](spark, SF).toPandas(), db.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)
