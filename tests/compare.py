"""Compare a Spark result with DuckDB's: same columns, same rows, any order."""

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(repr(row[i]) for i in order) for row in rows))


def oracle_rows(con, sql):
    result = con.execute(sql)
    columns = [item[0] for item in result.description]
    return columns, result.fetchall()


def mismatch(frame, con, sql):
    """None when equal, or a short account of the difference."""
    columns, expected = oracle_rows(con, sql)
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(columns)}"
    got = canonical(frame.columns, [tuple(row) for row in frame.collect()])
    want = canonical(columns, expected)
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    different = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(different)} rows differ, first {different[0]}" if different else None
