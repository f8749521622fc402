"""Compare a query with its SQL in DuckDB: python tests/compare.py FOLDER [NAME...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(folder).glob("*.parquet")):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else f'{p}/*.parquet'}'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples, columns by name."""
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, (float, np.floating)) and np.isnan(v)):
            return "~"
        if isinstance(v, (list, tuple, np.ndarray)):
            return str([cell(x) for x in v])
        if isinstance(v, dict):
            return str(sorted((k, cell(x)) for k, x in v.items()))
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (int, float, np.number)):
            return f"{float(v):.6f}".replace("-0.000000", "0.000000")
        if hasattr(v, "isoformat"):
            return pd.Timestamp(v).isoformat()
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False, name=None))


def difference(spark_df, sql: str, con) -> str:
    """'' if equal, else what differs."""
    got, want = spark_df.toPandas(), con.sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = normal(got), normal(want)
    if a == b:
        return ""
    sa, sb = set(a), set(b)
    return f"{len(a)} and {len(b)} rows; only here {list(sa - sb)[:3]}; only in SQL {list(sb - sa)[:3]}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tidemark.session import builder

    folder, names = sys.argv[1], sys.argv[2:]
    spark = builder("8").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, failed = connect(folder), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            if name in sql:
                said = difference(query(spark, folder), sql[name], con) or "ok"
            else:
                said = f"no SQL, {query(spark, folder).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"ERROR {str(e)[:1500]}"
        failed += said != "ok" and not said.startswith("no SQL")
        print(f"{name}: {said} ({time.time() - t:.1f} s)", flush=True)
    sys.exit(failed > 0)
