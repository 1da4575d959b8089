"""Compare registered queries with their SQL: ``python tests/check_oracle.py [sf] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(None if pd.isna(r[i]) else r[i] for i in order) for r in rows]
    return sorted(plain, key=repr)


KINDS = {
    "VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "BOOLEAN": "boolean", "DATE": "date",
    "TIMESTAMP": "timestamp_ntz",
}


def difference(query, sql: str, spark, con, sf_dir: str) -> str | None:
    """``None`` when both give the same columns, column kinds and rows."""
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    answer = con.execute(sql)
    columns = [d[0] for d in answer.description]
    kinds = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in answer.description}
    theirs = rows_of(columns, answer.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if dict(df.dtypes) != kinds:
        return f"types {set(df.dtypes) ^ set(kinds.items())}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}"
    for a, b in zip(mine, theirs):
        if [repr(x) for x in a] != [repr(x) for x in b]:
            return f"{a} != {b}"
    return None


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from aircapture.session import get_session

    sf_dir = f"/root/testdata/sf{argv[0] if argv else '0.001'}"
    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connection(sf_dir), oracle_sql(), 0
    for name, query in queries().items():
        if argv[1:] and not any(name.startswith(p) for p in argv[1:]):
            continue
        start = time.time()
        try:
            problem = difference(query, sqls[name], spark, con, sf_dir) if name in sqls else "no SQL"
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:400]}"
        bad += problem is not None
        print(f"{name:32s} {time.time() - start:6.1f}s {'ok' if problem is None else problem}", flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
