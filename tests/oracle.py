"""Compares registered queries with their SQL: python tests/oracle.py [sf_dir] [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        if p.exists():
            c.execute(f"create view {t} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def plain(x):
    if x is None or type(x).__name__ in ("NAType", "NaTType"):
        return "null"
    if isinstance(x, float) and x != x:
        return "null"
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, float):
        return f"{x:.9g}"
    if type(x).__name__ in ("Timestamp", "datetime", "datetime64"):
        return str(x)[:26]
    if type(x).__name__ == "Decimal":
        return f"{float(x):.9g}"
    return str(x) if not isinstance(x, int) else f"{float(x):.9g}" if abs(x) < 2**50 else str(x)


def rows_of(pdf):
    cols = sorted(pdf.columns)
    return sorted(tuple(plain(v) for v in r) for r in pdf[cols].astype(object).itertuples(index=False, name=None)), cols


def compare(spark, sf_dir: str, name: str, run, sql: str) -> str:
    """Empty if equal, else what differs."""
    got, gc = rows_of(run(spark, sf_dir).toPandas())
    want, wc = rows_of(connect(sf_dir).sql(sql).df())
    if gc != wc:
        return f"{name}: columns {gc} and {wc}"
    if got != want:
        odd = [(g, w) for g, w in zip(got, want) if g != w][:2]
        return f"{name}: {len(got)} and {len(want)} rows, {str(odd)[:600]}"
    return ""


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    q, o = e.queries(), e.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or [n for n in q if n in o]:
        t = time.time()
        try:
            if name in o:
                said = compare(spark, sf, name, q[name], o[name])
            else:
                said = ""
                print(name, "rows only:", q[name](spark, sf).count())
        except Exception as x:  # noqa: BLE001
            said = f"{name}: {type(x).__name__} {str(x)[:700]}"
        bad += bool(said)
        print(("DIFF " + said) if said else f"ok {name}", f"{time.time() - t:.1f}s", flush=True)
    print("differences:", bad)


if __name__ == "__main__":
    main()
