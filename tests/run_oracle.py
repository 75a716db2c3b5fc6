"""python tests/run_oracle.py FOLDER [NAME...]: check registered queries against DuckDB."""

from __future__ import annotations

import sys
import time
import traceback

sys.path.insert(0, "/root/repo")
sys.path.insert(0, "/root/repo/tests")

import oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from vaultry.session import build_session  # noqa: E402


def main() -> None:
    folder, names = sys.argv[1], sys.argv[2:]
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(folder)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if names and not any(n in name for n in names):
            continue
        t = time.time()
        try:
            df = fn(spark, folder)
            if name in sqls:
                problem = oracle.compare(df, con, sqls[name])
                n = ""
            else:
                n = f"{df.count()} rows, no oracle"
                problem = None
        except Exception:
            problem = "".join(traceback.format_exc())[-1800:]
        took = time.time() - t
        print(f"{'ok ' if problem is None else 'BAD'} {name} {took:.1f}s {n if problem is None else ''}", flush=True)
        if problem:
            bad += 1
            print(problem, flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
