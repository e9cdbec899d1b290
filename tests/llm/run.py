"""Time queries of the training-data operators and compare them with their SQL: run.py [sf] name ..."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from checking import connect, differences  # noqa: E402

from clausegrid.session import build_session  # noqa: E402


def main(args):
    import __spark_entry__ as entry

    folder = f"/root/testdata/{args.pop(0)}"
    spark = build_session(
        master="local[8]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    for name in args:
        start = time.time()
        df = entry.queries()[name](spark, folder)
        sql = entry.oracle_sql().get(name)
        if sql:
            note = differences(df, con, sql) or "ok"
        else:
            note = f"{len(df.collect())} rows"
        print(f"{name} {time.time() - start:.1f}s {note[:1500]}", flush=True)
        df.show(5, truncate=40)


if __name__ == "__main__":
    main(sys.argv[1:])
