"""Run all or the named queries against their SQL twins and print one line each.

    python tests/check_queries.py [name ...]
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from hazardflow.session import build_session  # noqa: E402
from tests.oracle import SF_DIR, connect, difference  # noqa: E402


def main(names):
    spark = build_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(), oracle_sql(), 0
    for name, run in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            frame = run(spark, SF_DIR)
            if name in sqls:
                problem = difference(frame, con, sqls[name])
            else:
                problem = None if frame.count() else "no rows"
        except Exception as error:  # report every query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        mark = "ok  " if problem is None else "BAD "
        print(f"{mark}{name} {time.time() - start:.1f}s {'' if name in sqls else '(rows only)'} {problem or ''}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
