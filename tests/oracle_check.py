"""Run queries next to their SQL and compare the rows.

    python tests/oracle_check.py [--sf /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    if hasattr(value, "isoformat"):
        return str(value).split("+")[0]
    if isinstance(value, float):
        return repr(value)
    return str(value)


def _rows(table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [[_cell(v) for v in table.column(n).to_pylist()] for n in names]
    return sorted(zip(*columns), key=repr)


def _kind(arrow_type) -> str:
    text = str(arrow_type)
    return {"large_string": "string", "string_view": "string"}.get(text, "timestamp" if text.startswith("timestamp") else text)


def compare(spark_df, con, sql: str) -> str | None:
    """None if both give the same names, types and rows, else what differs."""
    mine = spark_df.toArrow()
    theirs = con.execute(sql).to_arrow_table()
    if sorted(mine.column_names) != sorted(theirs.column_names):
        return f"columns {sorted(mine.column_names)} != {sorted(theirs.column_names)}"
    types = {n: (_kind(mine.schema.field(n).type), _kind(theirs.schema.field(n).type)) for n in mine.column_names}
    wrong = {n: t for n, t in types.items() if t[0] != t[1]}
    if wrong:
        return f"types {wrong}"
    a, b = _rows(mine), _rows(theirs)
    if len(a) != len(b):
        extra = [r for r in a if r not in set(b)][:2], [r for r in b if r not in set(a)][:2]
        return f"rows {len(a)} != {len(b)}; {extra}"
    different = [(x, y) for x, y in zip(a, b) if x != y]
    if different:
        return f"{len(different)} of {len(a)} rows differ, e.g. {str(different[0])[:600]}"
    return None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry
    from vocatio.session import build_session

    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(args.sf)
    oracles, failed = entry.oracle_sql(), []
    for name, function in entry.queries().items():
        if args.names and not any(n == name or (n.endswith("*") and name.startswith(n[:-1])) for n in args.names):
            continue
        start = time.time()
        try:
            result = function(spark, args.sf)
            if name in oracles:
                problem = compare(result, con, oracles[name])
                n = "="
            else:
                problem, n = None, f"rows={result.count()}"
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:700]}", "!"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        if problem:
            failed.append(name)
        print(f"{'FAIL' if problem else 'ok  '} {name:28s} {time.time() - start:6.1f}s {n} {problem or ''}", flush=True)
    print("failed:", failed)
    return len(failed)


if __name__ == "__main__":
    sys.exit(main())
