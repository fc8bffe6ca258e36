"""Driver contract: every oracle key has a query, every oracle statement binds
in DuckDB against the driver's tables, and entry() keeps its schema."""

import duckdb

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def test_oracle_keys_are_queries_and_sql_binds():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 55
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    for name, sql in o.items():
        con.execute("EXPLAIN " + sql)            # parses and binds every statement


def test_entry_schema(spark):
    df = entry.entry(spark)
    assert [f.name for f in df.schema.fields] == ["SK_ID_CURR", "TARGET"]
    assert df.count() > 0
