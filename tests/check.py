"""``python tests/check.py [prefix ...]``: compare registered queries with their SQL at sf0.01."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle
from almanac.session import build_session

import __spark_entry__ as entry

SF = os.environ.get("CHECK_SF", "/root/testdata/sf0.01")


def main(prefixes):
    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(SF)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            if name in sqls:
                msg = oracle.compare(spark, SF, fn, sqls[name], con)
            else:
                n = fn(spark, SF).count()
                msg = None if n else "no rows"
        except Exception as e:  # report every query, then go on
            msg = f"{type(e).__name__}: {str(e)[:900]}"
        bad += msg is not None
        print(f"{'ok  ' if msg is None else 'FAIL'} {name} {'sql' if name in sqls else 'rows'} {time.time()-t:.1f}s {msg or ''}", flush=True)
    print("failures", bad)


main(sys.argv[1:])
