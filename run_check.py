"""Compare every query with its DuckDB text: python run_check.py [folder] [name prefix...]"""

import sys
import time

from scoutframe.plans import check
from scoutframe.plans.catalog import ORACLES, QUERIES
from scoutframe.session import local_session

if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    prefixes = tuple(a for a in sys.argv[2:] if a != "-v")
    spark = local_session("8", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = check.duckdb_connection(folder)
    good = bad = 0
    for name in QUERIES:
        if prefixes and not name.startswith(prefixes):
            continue
        started = time.time()
        try:
            if name in ORACLES:
                problem = check.compare(spark, con, folder, name)
            else:
                problem = None if QUERIES[name](spark, folder).count() else "empty"
        except Exception as exc:  # report and go on with the next query
            problem = f"{type(exc).__name__}: {str(exc)[:900]}"
        good, bad = good + (problem is None), bad + (problem is not None)
        if problem or "-v" in sys.argv:
            print(f"{name}: {problem} [{time.time() - started:.1f}s]", flush=True)
    print(f"{good} agree, {bad} do not")
