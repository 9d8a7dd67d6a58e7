"""Run registered queries and their SQL side by side: ``python tests/compare.py <folder> [names]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def tables(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


def differences(spark, con, folder, query, sql):
    """Rows only in Spark and rows only in SQL, as multisets, with both sizes."""
    df = query(spark, folder)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows_of(names, cur.fetchall())
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    from collections import Counter

    a, b = Counter(ours), Counter(theirs)
    return list((a - b).elements()), list((b - a).elements()), len(ours), len(theirs)


def main():
    from linkloom.plans.oracles import ORACLES
    from linkloom.plans.queries import QUERIES
    from linkloom.session import local_session

    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, con = local_session(8, 8), tables(sys.argv[1])
    for name in names:
        start = time.time()
        try:
            if name not in ORACLES:
                print(f"{name:24s} no SQL, {QUERIES[name](spark, folder).count()} rows", flush=True)
                continue
            more, less, n, m = differences(spark, con, folder, QUERIES[name], ORACLES[name])
            state = "ok" if not more and not less else "DIFF"
            print(f"{name:24s} {state} {n} {m} {time.time() - start:.1f}s", flush=True)
            if state != "ok":
                print("   only spark", len(more), [str(x)[:260] for x in more[:2]], "\n   only sql  ", len(less), [str(x)[:260] for x in less[:2]], flush=True)
        except Exception as error:  # noqa: BLE001
            print(f"{name:24s} FAIL {str(error)[:420]!r}", flush=True)


if __name__ == "__main__":
    main()
