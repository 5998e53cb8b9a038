"""Run queries beside their SQL twins: `python -m verification.compare [sf_dir] [name ...]`."""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

from verification.oracles import ORACLES
from verification.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


_TYPES = {
    "INTEGER": "int", "BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "DATE": "date",
    "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean",
}


def _key(row: tuple) -> tuple:
    return tuple((v is None, "" if v is None else round(v, 4) if isinstance(v, float) else v) for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-9)
    return a == b


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf_dir: str, name: str) -> str:
    """'' if the query equals its twin in columns, types and rows, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    mine = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=_key)
    if name not in ORACLES:
        return "" if mine else "no rows"
    con.execute(ORACLES[name])
    described = {d[0]: str(d[1]) for d in con.description}
    if sorted(described) != columns:
        return f"columns {columns} vs {sorted(described)}"
    at = [list(described).index(c) for c in columns]
    theirs = sorted((tuple(r[i] for i in at) for r in con.fetchall()), key=_key)
    problems = [
        f"type of {c}: {kind} vs {described[c]}" for c, kind in df.dtypes if _TYPES.get(described[c]) != kind
    ]
    if len(mine) != len(theirs):
        problems.append(f"{len(mine)} rows vs {len(theirs)}")
    for a, b in zip(mine, theirs):
        if not all(_same(x, y) for x, y in zip(a, b)):
            problems.append(f"{columns}\n   spark {str(a)[:700]}\n   duck  {str(b)[:700]}")
            break
    if not mine and not theirs:
        problems.append("(no rows on either side)")
    return "; ".join(problems)


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con, bad = session(), duck(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name)
        except Exception as error:
            problem = "".join(traceback.format_exception_only(error))[:500]
        bad += bool(problem)
        print(f"{'ok  ' if not problem else 'BAD '} {name:28s} {time.time() - start:6.2f}s {problem}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
