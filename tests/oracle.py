"""Comparison of a query with its SQL in DuckDB, as multisets of rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(table, columns):
    return sorted(tuple(repr(x) for x in r.values()) for r in table.select(columns).to_pylist())


def assert_matches(spark, sf, query, sql):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = db.execute(sql).to_arrow_table()
    got = query(spark, sf).toArrow()
    columns = sorted(want.column_names)
    assert sorted(got.column_names) == columns
    assert rows(got, columns) == rows(want, columns)
