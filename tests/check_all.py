"""Run every query at one scale against its SQL: python -m tests.check_all <folder> [name ...]"""

from __future__ import annotations

import sys
import time

import __spark_entry__ as contract
from glyphflow.session import local_session
from tests.compare import connect, differences


def main() -> None:
    folder, names = sys.argv[1], sys.argv[2:]
    spark = local_session()
    con = connect(folder)
    sql = contract.oracle_sql()
    bad = 0
    for name, run in contract.queries().items():
        if names and name not in names:
            continue
        started = time.perf_counter()
        try:
            df = run(spark, folder)
            if name in sql:
                problems = differences(df, con, sql[name])
            else:
                problems = [] if df.count() > 0 else ["no rows"]
        except Exception as error:
            problems = [f"{type(error).__name__}: {str(error)[:700]}"]
        bad += bool(problems)
        took = time.perf_counter() - started
        print(f"{'FAIL' if problems else 'ok  '} {name} {took:.1f}s {'' if name in sql else '(no sql)'}", flush=True)
        for p in problems:
            print("     ", p[:1500], flush=True)
    print(f"{bad} failing")


if __name__ == "__main__":
    main()
