"""Run registered queries against their SQL in DuckDB and report differences.

Usage: python check.py [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from ebbmark.session import session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def normal(value):
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    from registry import QUERIES
    spark = session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                            "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    bad = 0
    for name, entry in QUERIES.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            frame = entry.run(spark, folder)
            names = sorted(frame.columns)
            mine = [tuple(normal(r[c]) for c in names) for r in frame.collect()]
        except Exception as error:  # report and go on with the next query
            print(f"FAIL {name}: {str(error)[:1500]}", flush=True)
            bad += 1
            continue
        spark_s = time.time() - start
        if entry.sql is None:
            print(f"ROWS {name}: {len(mine)} rows {spark_s:.1f}s", flush=True)
            continue
        start = time.time()
        try:
            result = db.execute(entry.sql)
        except duckdb.Error as error:
            print(f"FAIL {name}: {str(error)[:500]}", flush=True)
            bad += 1
            continue
        theirs_names = [d[0] for d in result.description]
        order = [theirs_names.index(c) for c in names] if sorted(theirs_names) == names else None
        rows = result.fetchall()
        if order is None:
            print(f"COLS {name}: {names} vs {sorted(theirs_names)}", flush=True)
            bad += 1
            continue
        theirs = [tuple(normal(r[i]) for i in order) for r in rows]
        types = {c: t for c, t in zip(theirs_names, [str(d[1]) for d in result.description])}
        a, b = sorted(mine, key=repr), sorted(theirs, key=repr)
        same = len(a) == len(b) and all(x == y for x, y in zip(a, b))
        odd = [f"{c}:{types[c]}" for c in names if types[c] in ("HUGEINT",) or "DECIMAL" in types[c]]
        print(f"{'ok  ' if same else 'DIFF'} {name}: {len(a)}/{len(b)} rows, {spark_s:.1f}s, sql {time.time() - start:.1f}s"
              + (f" types {odd}" if odd else ""), flush=True)
        if not same:
            bad += 1
            here, there = (set(x) if all(map(_hashable, x)) else None for x in (a, b))
            extra = a[:3] if here is None or there is None else [x for x in a if x not in there][:3]
            missing = b[:3] if here is None or there is None else [x for x in b if x not in here][:3]
            print("   ", names, "\n    spark:", extra, "\n    sql:  ", missing, flush=True)
    return 1 if bad else 0


def _hashable(row) -> bool:
    try:
        hash(row)
        return True
    except TypeError:
        return False


if __name__ == "__main__":
    sys.exit(main())
