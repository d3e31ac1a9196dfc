"""Run queries next to their SQL and report the differences: ``python -m checks.compare [folder] [names]``."""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.oracles import ORACLES
from checks.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


# Doubles agree when they differ by less than this share of the larger one; all else must be equal.
TOLERANCE = 1e-9

_INTEGERS = {"tinyint", "smallint", "int", "bigint", "hugeint"}
_KINDS = {"varchar": "string", "integer": "int", "float": "double"}


def kind(name: str) -> str:
    """Type names of both engines on one scale: integers of any width, doubles, texts, booleans, lists."""
    name = name.lower()
    name = _KINDS.get(name, name)
    if name.startswith("array<") or name.endswith("[]"):
        return "list"
    return "integer" if name in _INTEGERS else "decimal" if name.startswith("decimal") else name


def unequal(a: object, b: object) -> bool:
    if a is None or b is None:
        return a is not b
    if type(a) is not type(b):
        return True
    if isinstance(a, float):
        return not (a == b or abs(a - b) <= TOLERANCE * max(abs(a), abs(b)) or a != a and b != b)
    return a != b


def _sortable(row: tuple) -> tuple:
    """Doubles come last and rounded, so that rows that agree stand at the same place."""
    exact = tuple((v is not None, str(v)) for v in row if not isinstance(v, float))
    return exact, tuple(f"{v:.7e}" for v in row if isinstance(v, float))


def differences(spark: SparkSession, db: duckdb.DuckDBPyConnection, sf_dir: str, name: str) -> str | None:
    """A short text when the two results differ in columns, types, number of rows or a value."""
    frame, relation = QUERIES[name](spark, sf_dir), db.sql(ORACLES[name])
    got_kinds = {c: kind(t) for c, t in frame.dtypes}
    want_kinds = {c: kind(str(t)) for c, t in zip(relation.columns, relation.types)}
    if got_kinds != want_kinds:
        return f"columns {got_kinds} instead of {want_kinds}"
    columns = sorted(got_kinds)
    got = sorted((tuple(row[c] for c in columns) for row in frame.collect()), key=_sortable)
    places = [relation.columns.index(c) for c in columns]
    want = sorted((tuple(row[i] for i in places) for row in relation.fetchall()), key=_sortable)
    if len(got) != len(want):
        return f"{len(got)} rows instead of {len(want)}"
    for a, b in zip(got, want):
        wrong = [c for c, x, y in zip(columns, a, b) if unequal(x, y)]
        if wrong:
            return f"{wrong} in {dict(zip(columns, a))} instead of {dict(zip(columns, b))}"
    return None


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    builder = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config(
        "spark.ui.showConsoleProgress", "false"
    )
    spark = builder.config("spark.sql.shuffle.partitions", "8").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(sf_dir)
    failed = 0
    for name in names:
        start = time.perf_counter()
        try:
            problem = differences(spark, db, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failed += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.perf_counter() - start:.1f}s {problem or ''}")
    print(f"{len(names) - failed} of {len(names)} agree")


if __name__ == "__main__":
    main()
