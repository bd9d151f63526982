"""Time the DuckDB oracle statements on one data folder (single-node reference).

    python tools/duckdb_bench.py [sf_dir]
Prints one JSON line like bench.py.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessera.oracle.harness import duckdb_connection  # noqa: E402
from tessera.oracle.sql import ORACLE_SQL  # noqa: E402


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.1"
    con = duckdb_connection(sf_dir)
    con.execute(f"SET threads = {int(os.environ.get('BENCH_CPUS', '8'))}")
    timings = {}
    t_all = time.perf_counter()
    for name, sql in ORACLE_SQL.items():
        t0 = time.perf_counter()
        con.sql(sql).fetchall()
        timings[name] = round(time.perf_counter() - t0, 3)
    total = round(time.perf_counter() - t_all, 3)
    print(json.dumps({"metric": "duckdb_total_seconds", "value": total, "unit": "sec", "queries": timings,
                      "sf_dir": sf_dir}))


if __name__ == "__main__":
    main(sys.argv[1:])
