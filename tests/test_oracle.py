"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import datetime
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
SQL = entry_module.oracle_sql()


def plain(rows: list[tuple]) -> list[tuple]:
    def one(x: object) -> object:
        if isinstance(x, float):
            return round(x, 4) + 0.0
        return x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else x

    return sorted((tuple(one(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from '{p}'")
    got = entry_module.queries()[name](spark, SF)
    columns = sorted(got.columns)
    told = db.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({SQL[name]})").fetchall() if set(columns) else []
    mine = plain([tuple(r) for r in got.select(*[f"`{c}`" for c in columns]).collect()])
    assert mine == plain(told)
    assert mine


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
