"""Run registered queries next to their SQL check: ``python -m tests.oracle sf0.001 key…``."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import tempfile
import time
import traceback
from decimal import Decimal

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()
TYPES = {
    "tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT",
    "float": "FLOAT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
}


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]").appName("tabloom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tabloom-tests-")).config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(root: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{root}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, Decimal)):
        f = float(v)
        if math.isnan(f):
            return "nan"
        return f"{f + 0.0:.9g}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def compare(spark, con, key: str, fn, sql: str | None, root: str) -> str:
    df = fn(spark, root)
    cols = sorted(df.columns)
    rows = df.select(*[f"`{c}`" for c in cols]).collect()
    if sql is None:
        return f"rows-only {len(rows)}" if rows else "EMPTY"
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    got = rel.fetchall()
    if sorted(names) != cols:
        return f"COLUMNS spark={cols} sql={sorted(names)}"
    types = {r[0]: r[1] for r in con.execute(f"describe {sql}").fetchall()}
    bad = [
        f"{c}: {t} vs {types[c]}" for c, t in df.dtypes
        if TYPES.get(t, t.upper().replace("DECIMAL", "DECIMAL")) != types[c].replace(", ", ",")
        and not (t.startswith("decimal") and types[c].replace(" ", "").lower() == t)
    ]
    if bad:
        return "TYPES " + "; ".join(bad)
    idx = [names.index(c) for c in cols]
    a = sorted(tuple(canon(v) for v in r) for r in rows)
    b = sorted(tuple(canon(r[i]) for i in idx) for r in got)
    if len(a) != len(b):
        return f"ROWS {len(a)} vs {len(b)} {a[:1]} {b[:1]}"
    for x, y in zip(a, b):
        if x != y:
            return f"VALUES {cols}\n   spark={str(x)[:600]}\n   sql  ={str(y)[:600]}"
    return f"ok {len(a)}" if a else "EMPTY"


def main(argv: list[str]) -> int:
    from tabloom import catalog

    catalog.load()
    root = f"/root/testdata/{argv[0]}"
    keys = argv[1:] or list(catalog.QUERIES)
    if keys[0].startswith("@"):
        mod = [k[1:] for k in keys]
        keys = [
            k for k, f in catalog.QUERIES.items()
            if f.__closure__[0].cell_contents.__module__.rsplit(".", 1)[1] in mod
        ]
    spark, con = session(), duck(root)
    failed = []
    for key in keys:
        t = time.time()
        try:
            msg = compare(spark, con, key, catalog.QUERIES[key], catalog.SQL.get(key), root)
        except Exception as e:  # report and go on with the next key
            msg = "ERROR " + str(e)[:700]
            if "-v" in sys.argv:
                traceback.print_exc()
        good = msg.startswith(("ok", "rows-only"))
        took = time.time() - t
        if not good:
            failed.append(key)
            print(f"{key}: {msg}", flush=True)
        elif took > float(os.environ.get("SLOW", 6)):
            print(f"   slow {key}: {took:.1f}s {msg}", flush=True)
    print(f"{len(keys) - len(failed)}/{len(keys)} good; failed: {' '.join(failed)}")
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main([a for a in sys.argv[1:] if a != "-v"]))
