"""Compare a registered query with its SQL: same columns, same rows, order ignored."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def differences(df, con, sql: str) -> str | None:
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        extra = set(map(repr, got)) - set(map(repr, want))
        short = set(map(repr, want)) - set(map(repr, got))
        return f"rows {len(got)} != {len(want)}\n  spark only {list(extra)[:2]}\n  sql only {list(short)[:2]}"
    for g, w in zip(got, want):
        if repr(g) != repr(w):
            return f"{got_cols}\n  spark {g}\n  sql   {w}"
    return None


def main(names: list[str], folder: str) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from clausegrid.session import build_session

    spark = build_session(
        master="local[8]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.clausegrid.inputParts": "8", "spark.driver.memory": "12g",
           "spark.log.level": "ERROR"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in queries:
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracle:
                problem = differences(df, con, oracle[name])
                note = "ok" if problem is None else "DIFF " + problem[:900]
            else:
                note = f"rows only: {len(df.collect())}"
                problem = None
        except Exception as exc:  # noqa: BLE001
            problem = note = "FAIL " + str(exc)[:900]
        bad += problem is not None
        print(f"{name:32} {time.time() - start:6.2f}s {note}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sf = "/root/testdata/sf0.01"
    args = sys.argv[1:]
    if args and args[0].startswith("sf"):
        sf = f"/root/testdata/{args.pop(0)}"
    sys.exit(main(args, sf) > 0)
