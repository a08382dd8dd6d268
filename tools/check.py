"""Run registered queries against their SQL and report differences.

    python tools/check.py [--sf DIR] [name or prefix ...]
"""

from __future__ import annotations

import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/", 2)[0])
from terravox.plans import QUERIES  # noqa: E402
from terravox.session import build_session, ship_package  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def main(argv):
    sf = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    spark = build_session("check", "local[8]", 8)
    ship_package(spark)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    bad = []
    for name, q in QUERIES.items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        t0 = time.time()
        try:
            df = q.run(spark, sf)
            cols = sorted(df.columns)
            got = canon([tuple(r) for r in df.select(*cols).collect()])
            t1 = time.time()
            if q.sql is None:
                print(f"rows  {name}: {len(got)} rows {t1 - t0:.1f}s", flush=True)
                continue
            rel = con.sql(q.sql)
            want = canon(con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({q.sql})").fetchall())
            t2 = time.time()
            ok = got == want
            print(f"{'ok   ' if ok else 'DIFF '} {name}: {len(got)}/{len(want)} rows spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s", flush=True)
            if not ok:
                bad.append(name)
                d = [(a, b) for a, b in zip(got, want) if a != b]
                print("   cols", cols)
                for a, b in d[:3]:
                    print("   ", a, "\n   ", b)
        except Exception as e:  # report and go on to the next query
            bad.append(name)
            print(f"ERROR {name}: {str(e)[:900]}", flush=True)
    print("FAILED", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
