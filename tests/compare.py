"""Runs registered queries against DuckDB: ``python -m tests.compare [-s sf] [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)

    def norm(v):
        if v is None or v is pd.NaT:
            return "\x00null"
        if isinstance(v, float):
            return "nan" if v != v else repr(v + 0.0)
        if hasattr(v, "item"):
            return norm(v.item())
        return repr(v)
    return sorted(tuple(norm(v) for v in row) for row in pdf[cols].astype(object).itertuples(index=False))


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    got = df.toArrow()
    want = con.sql(sql).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {sorted(got.column_names)} != {sorted(want.column_names)}"
    if got.num_rows != want.num_rows:
        return f"rows {got.num_rows} != {want.num_rows}"
    a, b = (sorted(tuple(repr(v + 0.0) if isinstance(v, float) else repr(v) for v in row)
                   for row in zip(*[t.column(c).to_pylist() for c in sorted(t.column_names)]))
            for t in (got, want))
    for x, y in zip(a, b):
        if x != y:
            return f"{sorted(got.column_names)}: spark {x} != duckdb {y}"
    kinds = [(c, str(got.schema.field(c).type), str(want.schema.field(c).type))
             for c in sorted(got.column_names)
             if str(got.schema.field(c).type) != str(want.schema.field(c).type)]
    return f"types {kinds}" if kinds else None


def session(cores: int = 8):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("fedtab-tests")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv: list[str]) -> int:
    import __spark_entry__ as e
    sf = "0.01"
    if argv[:1] == ["-s"]:
        sf, argv = argv[1], argv[2:]
    d = f"/root/testdata/sf{sf}"
    spark, con = session(), duck(d)
    queries, sqls = e.queries(), e.oracle_sql()
    bad = 0
    for name in argv or queries:
        t = time.time()
        try:
            df = queries[name](spark, d)
            if name in sqls:
                res = compare(df, con, sqls[name])
                n = ""
            else:
                n = f" rows={len(df.collect())} (no SQL)"
                res = None
        except Exception as ex:  # noqa: BLE001 - report and go on
            res, n = f"{type(ex).__name__}: {str(ex)[:1500]}", ""
        bad += res is not None
        print(f"{'ok  ' if res is None else 'FAIL'} {name} {time.time() - t:.1f}s{n} {res or ''}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
