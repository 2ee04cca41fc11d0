"""Runs registered queries against their SQL twins in DuckDB."""

from __future__ import annotations

import decimal
import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v) if v != v.to_integral_value() else int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    return v


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    data = [tuple(plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(data, key=lambda r: [(x is None, str(type(x).__name__), str(x)) for x in r])


def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def run_duck(con, sql):
    cur = con.execute(sql)
    odd = [f"{d[0]} {d[1]}" for d in cur.description if any(t in str(d[1]).upper() for t in ("DECIMAL", "HUGEINT", "NUMBER(38"))]
    if odd:
        print("       type of", odd)
    return [d[0] for d in cur.description], cur.fetchall()


def differences(spark_df, con, sql):
    """Empty list when both sides hold the same rows."""
    names, rows = canonical(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    onames, orows = canonical(*run_duck(con, sql))
    if names != onames:
        return [f"columns {names} != {onames}"], len(rows)
    if len(rows) != len(orows):
        return [f"rows {len(rows)} != {len(orows)}", f"first {rows[:2]} / {orows[:2]}"], len(rows)
    bad = [(a, b) for a, b in zip(rows, orows) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    return [f"{len(bad)} rows differ, e.g. {bad[0][0]} / {bad[0][1]}"] if bad else [], len(rows)


def session(master="local[8]", **conf):
    from pyspark.sql import SparkSession

    b = SparkSession.builder.master(master).appName("gapwise-check")
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.session.timeZone": "UTC",
        "spark.checkpoint.dir": "/tmp/gapwise-checkpoints",
        **conf,
    }
    for k, v in base.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


if __name__ == "__main__":
    sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry

    sf, wanted = sys.argv[1], sys.argv[2:]
    spark = session()
    if wanted and wanted[0] == "--split":
        wanted = wanted[1:]
        spark.conf.set("gapwise.hot.rows", "25")
    con = duck(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in qs.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            if name in sqls:
                bad, n = differences(fn(spark, sf), con, sqls[name])
            else:
                bad, n = [], fn(spark, sf).count()
        except Exception as e:  # noqa: BLE001
            bad, n = [f"{type(e).__name__}: {str(e)[:700]}"], -1
        failed += bool(bad)
        print(f"{'FAIL' if bad else 'ok  '} {name:40s} rows={n:<8d} {time.time() - t:6.2f}s {'' if name in sqls else '(no SQL)'}")
        for b in bad:
            print("      ", b)
    print("failed", failed)
