import __spark_entry__ as E

from tests.conftest import SF_SMALL


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert set(df.columns) == {"admission_type_id", "n", "positives", "rate", "share"}


def test_oracle_keys_subset():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_sql_queries_match_duckdb_small(spark):
    import duckdb

    from scripts.check_oracle import TABLES, rows_of
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    qs, oracle = E.queries(), E.oracle_sql()
    for name in ["rate_by_admission_type", "split_stratified", "oversample_exact", "roc_auc",
                 "threshold_sweep", "entity_frequency", "code_group_fine", "undersample"]:
        a = rows_of(qs[name](spark, SF_SMALL).toPandas())
        b = rows_of(con.sql(oracle[name]).df())
        assert a == b, name
