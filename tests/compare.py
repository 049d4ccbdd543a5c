"""Run queries beside their DuckDB twins: python tests/compare.py [sf] [name part ...]."""

from __future__ import annotations

import datetime as dt
import decimal
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else value + 0.0
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.isoformat(" ")
    if isinstance(value, dt.date):
        return value.isoformat()
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return ([columns[i] for i in order],
            sorted((tuple(plain(row[i]) for i in order) for row in rows),
                   key=lambda row: [(v is None, str(type(v)), str(v)) for v in row]))


def compare(spark_df, con, sql):
    """Empty text when both sides agree, else the first difference."""
    left = table(spark_df.columns, spark_df.collect())
    cursor = con.execute(sql)
    right = table([c[0] for c in cursor.description], cursor.fetchall())
    if left[0] != right[0]:
        return f"columns {sorted(set(left[0]) ^ set(right[0]))}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} vs {len(right[1])}"
    wrong = [(a, b) for a, b in zip(left[1], right[1]) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    if wrong:
        a, b = wrong[0]
        cells = [(c, x, y) for c, x, y in zip(left[0], a, b) if x != y or type(x) is not type(y)]
        return f"{len(wrong)} rows differ, first {cells[:4]}"
    return ""


def main() -> None:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from shelfcast.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    spark = build_session("compare", "local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"/root/testdata/sf{sf}"
    con, twins, bad = connect(folder), entry.oracle_sql(), []
    for name, run in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            if name in twins:
                text = compare(df, con, twins[name])
                rows = ""
            else:
                text, rows = "", f"rows only: {df.count()}"
        except Exception as error:
            text, rows = f"{type(error).__name__}: {str(error)[:600]}", ""
        if text:
            bad.append(name)
        print(f"{'BAD ' if text else 'ok  '} {name} {time.time() - start:.1f}s {rows} {text}", flush=True)
    print("twins without query:", sorted(set(twins) - set(entry.queries())))
    print("BAD:", bad)


if __name__ == "__main__":
    main()
