"""Run registered queries next to their SQL checks: ``python tests/compare.py [name-prefix ...]``."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    rows = []
    for row in pdf[cols].itertuples(index=False):
        rows.append(tuple("<null>" if v is None or v is pd.NA or v != v else v for v in row))
    return sorted(rows, key=lambda r: tuple(str(v) for v in r))


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    cols = sorted(got.columns)
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    kinds = {c: (str(got[c].dtype), str(want[c].dtype)) for c in cols}
    # pandas shows a long column with nulls as float64 or as Int64, by who hands it over
    same = {c for c, k in kinds.items() if set(k) == {"float64", "Int64"} and got[c].isna().any()}
    odd = {c: k for c, k in kinds.items() if k[0] != k[1] and c not in same and len(got) and not got[c].isna().all()}
    bad = [(g, w) for g, w in zip(canonical(got), canonical(want)) if g != w]
    if bad:
        return f"{len(bad)} rows differ, e.g. {bad[0][0]} vs {bad[0][1]} ({cols})"
    return f"types {odd}" if odd else None


def main() -> None:
    from targetloom.session import build_session
    import __spark_entry__ as entry

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "10g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, checks = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[1:]
    good = bad = free = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            spent = time.time() - start
            if name not in checks:
                free += 1
                print(f"ROWS {name}: {len(got)} rows {spent:.1f}s {got.head(2).values.tolist()}", flush=True)
                continue
            start = time.time()
            diff = differences(got, con.execute(checks[name]).df())
            if diff:
                bad += 1
            else:
                good += 1
            print(f"{'DIFF' if diff else 'OK  '} {name}: {len(got)} rows {spent:.1f}s/{time.time() - start:.1f}s {diff or ''}", flush=True)
        except Exception as exc:  # report and go on with the next query
            bad += 1
            print(f"FAIL {name}: {type(exc).__name__} {str(exc)[:700]}", flush=True)
    print(f"{good} equal, {bad} bad, {free} without SQL")
    spark.stop()


if __name__ == "__main__":
    main()
