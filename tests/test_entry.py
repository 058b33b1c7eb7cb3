import __spark_entry__


def test_queries_and_sql_have_the_same_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_sql_agrees_on_the_smallest_data(spark):
    import os

    import duckdb
    import pandas as pd
    import pytest

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    con = duckdb.connect()
    for f in os.listdir(d):
        con.execute(f"create view {f.split('.')[0]} as select * from '{d}/{f}'")
    from storyloom.plans import oracle, queries

    for name in ("scene_passages", "sentences", "sentence_scores", "ngram_terms", "confusion_recall"):
        left = queries.QUERIES[name](spark, d).toPandas()
        right = con.execute(oracle.ORACLES[name]).df()
        cols = sorted(left.columns)
        assert cols == sorted(right.columns)

        def value(x):
            """One spelling of a value, whichever engine it comes from."""
            if pd.isna(x):
                return None
            return f"{x:.6f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

        rows = lambda df: (tuple(value(x) for x in r) for r in df[cols].astype(object).itertuples(index=False, name=None))
        assert sorted(map(str, rows(left))) == sorted(map(str, rows(right))), name
