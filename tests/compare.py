"""Run named queries and their SQL side by side and compare all values."""

from __future__ import annotations

import math
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    conn = duckdb.connect()
    for name in TABLES:
        conn.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return conn


SQL_TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value if value is None else str(value)


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(spark, conn, query, sql: str, sf_dir: str) -> str:
    """Empty when equal, otherwise what differs."""
    mine = query(spark, sf_dir)
    result = conn.execute(sql)
    names = [d[0] for d in result.description]
    types = {(d[0], str(d[1])) for d in result.description}
    own_types = {(name, SQL_TYPES.get(kind, kind)) for name, kind in mine.dtypes}
    if types != own_types:
        return f"columns {sorted(own_types - types)} against {sorted(types - own_types)}"
    found = rows_of(mine.columns, mine.collect())
    wanted = rows_of(names, result.fetchall())
    if found == wanted:
        return ""
    only, lacking = list((found - wanted).items())[:2], list((wanted - found).items())[:2]
    return f"{sum(found.values())} rows against {sum(wanted.values())}; only here {str(only)[:600]}; lacking {str(lacking)[:600]}"


if __name__ == "__main__":
    import os
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from msgpulse import plans, session

    sf, wanted = sys.argv[1], sys.argv[2:]
    spark = session.build("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    conn, bad = connect(sf), 0
    for name, query in plans.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            sql = plans.oracle_sql().get(name)
            if sql is None:
                text = f"rows only, {len(query(spark, sf).collect())}"
            else:
                text = differences(spark, conn, query, sql, sf)
                bad += bool(text)
                text = text or "equal"
        except Exception as e:  # noqa: BLE001
            bad, text = bad + 1, f"{type(e).__name__}: {str(e)[:900]}"
        print(f"{name:32s} {time.time() - start:6.2f}s {text}", flush=True)
    print("different:", bad)
