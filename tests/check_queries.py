"""Run all (or the named) queries against their SQL and print what differs.

    python tests/check_queries.py /root/testdata/sf0.01 [query ...]
"""

import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import SparkSession  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from tests.compare import connect, differences  # noqa: E402


def main(folder: str, names: list[str]) -> int:
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", os.environ.get("CHECK_PARTITIONS", "8"))
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(folder), 0
    for name, build in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        sql = oracle_sql().get(name)
        try:
            df = build(spark, folder)
            problems = differences(df, con, sql) if sql else []
            rows = "" if sql else f"{df.count()} rows, no SQL"
        except Exception as error:  # report and go on with the next query
            problems, rows = [f"{type(error).__name__}: {str(error)[:1500]}"], ""
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s {rows}", flush=True)
        for problem in problems:
            print("     ", problem, flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
