"""Runs registered queries against their SQL twins on one data folder."""

from __future__ import annotations

from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for path in Path(folder).glob("*.parquet"):
        files = f"{path}/*.parquet" if path.is_dir() else str(path)
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{files}')")
    return db


def plain(value) -> str:
    if isinstance(value, float):
        return "nan" if value != value else f"{value:.6g}"
    if isinstance(value, list | tuple):
        return str([plain(v) for v in value])
    return str(value)


def canonical(rows, columns) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([plain(row[i]) for i in order]) for row in rows)


def compare(spark, db, folder: str, query, sql: str) -> None:
    df = query(spark, folder)
    ours = canonical([tuple(r) for r in df.collect()], df.columns)
    found = db.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    theirs = canonical(found.fetchall(), columns)
    assert ours == theirs
