"""Run registered queries beside their DuckDB text and compare rows, column names and values.

``python -m tests.compare [--sf 0.01] [name ...]``
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import hashlib
import time
from concurrent.futures import ThreadPoolExecutor

import duckdb

from estatelens.plans.derived import BASE_TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in BASE_TABLES:
        con.execute(f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')")
    return con


def plain(value: object) -> str:
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value):.6f}"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return str(value)


def digest(names: list[str], rows: list[tuple]) -> tuple[int, str, list[str]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    texts = sorted("\x1f".join(plain(row[i]) for i in order) for row in rows)
    return len(rows), hashlib.sha256("\x1e".join(texts).encode()).hexdigest(), texts


def compare(spark, con, name: str, query, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    start = time.time()
    df = query(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    n, mine, texts = digest(df.columns, rows)
    if sql is None:
        return True, f"{name}: {n} rows, no oracle, {took:.1f}s"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    m, theirs, expected = digest(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return False, f"{name}: columns {sorted(df.columns)} != {sorted(names)}"
    types = {d[0]: str(d[1]).lower() for d in result.description}
    spark_types = dict(df.dtypes)
    kinds = {"bigint": "bigint", "integer": "int", "varchar": "string", "boolean": "boolean", "double": "double", "number": "", "string": "string", "bool": "boolean"}
    odd = {c: (spark_types[c], t) for c, t in types.items() if kinds.get(t, t) not in ("", spark_types[c])}
    note = f" types {odd}" if odd else ""
    if (n, mine) == (m, theirs):
        return True, f"{name}: {n} rows ok, {took:.1f}s{note}"
    a, b = sorted(set(texts) - set(expected))[:3], sorted(set(expected) - set(texts))[:3]
    return False, f"{name}: MISMATCH {n} != {m} rows, {took:.1f}s\n   spark only {a}\n   duckdb only {b}{note}"


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--threads", type=int, default=4)
    args = parser.parse_args()
    from __spark_entry__ import oracle_sql, queries
    from estatelens import session

    spark = session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, sqls, bad = f"/root/testdata/sf{args.sf}", oracle_sql(), []
    con = connect(sf_dir)
    todo = queries()
    chosen = [n for n in todo if not args.names or any(n.startswith(p) for p in args.names)]

    def check(name: str) -> tuple[str, bool, str]:
        try:
            return name, *compare(spark, con.cursor(), name, todo[name], sqls.get(name), sf_dir)
        except Exception as error:  # report and go on: one line per query
            return name, False, f"{name}: ERROR {str(error)[:600]}"

    with ThreadPoolExecutor(args.threads) as pool:
        for name, ok, text in pool.map(check, chosen):
            if not ok:
                bad.append(name)
            print(text, flush=True)
    print(f"{len(chosen) - len(bad)} of {len(chosen)} good; bad: {bad}; unused oracles: {sorted(set(sqls) - set(todo))}")


if __name__ == "__main__":
    main()
