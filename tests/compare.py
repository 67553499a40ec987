"""Rows of a query and of its SQL, in a form that compares."""

from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def cell(v):
        return round(v, 6) + 0.0 if isinstance(v, float) else v

    return sorted((tuple(cell(r[k]) for k in order) for r in rows), key=repr)


def same(query, sql, spark, sf=SF):
    df = query(spark, sf)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    r = c.sql(sql)
    want = canonical(r.columns, r.fetchall())
    assert sorted(df.columns) == sorted(r.columns)
    assert got == want
