"""Run registered queries next to their SQL oracle and compare types and values."""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(value + 0.0)
    return repr(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


KINDS = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences between a Spark result and its oracle, empty when equal."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in result.description}
    wanted = _rows(names, result.fetchall())
    types = dict(spark_df.dtypes)
    problems = []
    if set(types) != set(names):
        return [f"columns {sorted(types)} != {sorted(names)}"]
    problems += [f"type {n}: {types[n]} != {kinds[n]}" for n in names if types[n] != kinds[n]]
    found = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if len(found) != len(wanted):
        problems.append(f"rows {len(found)} != {len(wanted)}")
    if found != wanted:
        left, right = set(found) - set(wanted), set(wanted) - set(found)
        problems.append(f"columns {sorted(names)}; {len(left)} only in Spark, e.g. {sorted(left)[:2]}")
        problems.append(f"{len(right)} only in oracle, e.g. {sorted(right)[:2]}")
    return problems


def main(sf_dir: str, names: list[str]) -> int:
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as e
    from tests.session import local_session

    spark = local_session()
    con = connect(sf_dir)
    queries, oracles = e.queries(), e.oracle_sql()
    bad = 0
    for name in names or list(queries):
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problems = compare(df, con, oracles[name])
                count = con.execute(f"SELECT count(*) FROM ({oracles[name]})").fetchone()[0]
            else:
                problems, count = [], df.count()
        except Exception as error:  # report and go on
            problems, count = [f"{type(error).__name__}: {str(error)[:1200]}"], -1
        bad += bool(problems)
        mark = "FAIL" if problems else ("ok" if name in oracles else "rows-only")
        print(f"{mark:9} {name:24} rows={count:7} {time.time() - start:6.2f}s", flush=True)
        for p in problems:
            print("    ", p[:1500])
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
