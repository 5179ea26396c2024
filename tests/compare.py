"""Runs named queries and their SQL over the same tables and compares the rows.

    python -m tests.compare <scale folder> [query ...]
"""

import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

import __spark_entry__ as entry  # noqa: E402


def oracle(sf_dir: str):
    db = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return db


def differences(spark, db, name: str, sf_dir: str) -> str | None:
    """None when the rows agree, else what differs first."""
    frame = entry.queries()[name](spark, sf_dir)
    got_columns = sorted(frame.columns)
    got = sorted((tuple(r) for r in frame.select(*got_columns).collect()), key=repr)
    cursor = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    want = sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=repr)
    if got_columns != sorted(columns):
        return f"columns {got_columns} != {sorted(columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; first {got[:1]} {want[:1]}"
    for g, w in zip(got, want, strict=True):
        if g != w:
            return f"{dict(zip(got_columns, g, strict=True))} != {dict(zip(got_columns, w, strict=True))}"
        if any(type(x) is not type(y) for x, y in zip(g, w, strict=True)):
            return f"types {list(map(type, g))} != {list(map(type, w))} in {g}"
    return None if got else "no rows"


def main() -> None:
    from tallyhouse.session import build_session
    sf_dir, *names = sys.argv[1:]
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    db, bad = oracle(sf_dir), 0
    for name in names or entry.queries():
        start = time.time()
        try:
            if name in entry.oracle_sql():
                wrong = differences(spark, db, name, sf_dir)
            else:
                wrong = None if entry.queries()[name](spark, sf_dir).count() else "no rows"
        except Exception as error:  # noqa: BLE001
            wrong = f"{type(error).__name__}: {str(error)[:700]}"
        bad += wrong is not None
        kind = "sql " if name in entry.oracle_sql() else "rows"
        print(f"{'ok  ' if wrong is None else 'FAIL'} {kind} {time.time() - start:6.2f}s {name}"
              + (f"\n     {wrong}" if wrong else ""), flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
