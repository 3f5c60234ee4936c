"""Named views over the source tables.

A view is SQL with the few spots in which engines differ behind a Dialect. A query on a view is one statement: the views
that it needs as common table expressions, then the view. Spark's optimizer sees the whole, so column pruning and filters
reach the Parquet scans through any depth of views; nothing is registered in the session's catalog.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Dialect:
    """Spark SQL."""

    name = "spark"

    def days(self, later: str, earlier: str) -> str:
        return f"datediff({later}, {earlier})::bigint"

    def plus_days(self, date: str, n: str) -> str:
        return f"date_add({date}::date, ({n})::int)"

    def pattern(self, p: str) -> str:
        return "r'" + p + "'"

    def replace(self, s: str, p: str, to: str) -> str:
        return f"regexp_replace({s}, {self.pattern(p)}, '{to}')"

    def matches(self, s: str, p: str) -> str:
        return f"({s} rlike {self.pattern(p)})"

    def extract(self, s: str, p: str, group: int) -> str:
        return f"regexp_extract({s}, {self.pattern(p)}, {group})"

    def count_matches(self, s: str, p: str) -> str:
        return f"regexp_count({s}, {self.pattern(p)})::bigint"

    def starts(self, s: str, p: str) -> str:
        return f"startswith({s}, {p})"

    def percentile(self, x: str, p: float) -> str:
        return f"percentile({x}, {p})"

    def rint(self, x: str) -> str:
        return f"rint({x})::bigint"

    def sha256(self, s: str) -> str:
        return f"sha2({s}, 256)"

    def text_agg(self, value: str, by: str, order: str) -> str:
        return f"listagg({value}, '{by}') within group (order by {order})"

    def shingles(self, s: str, n: int) -> str:
        return f"array_distinct(transform(sequence(1, greatest(length({s}) - {n - 1}, 0), 1), i -> substr({s}, i, {n})))"

    def words(self, s: str) -> str:
        return rf"filter(split({s}, r'\s+'), w -> w <> '')"

    def items(self, array: str) -> str:
        """A column that makes a row of each item."""
        return f"explode({array})"

    def size(self, array: str) -> str:
        return f"size({array})::bigint"

    def week(self, x: str) -> str:
        return f"date_trunc('week', {x})::date"

    def month(self, x: str) -> str:
        return f"date_trunc('month', {x})::date"

    def table(self, name: str, sf_dir: str) -> str:
        return f"SELECT * FROM parquet.`{sf_dir}/{name}.parquet`"

    def number(self, x: str) -> str:
        """A double, rounded so that the order of summation doesn't show."""
        return f"round(({x})::double, 6)"

    def hash_bits(self, s: str) -> str:
        """The first 15 hex digits of the sha256 as a number."""
        return f"conv(substr(sha2({s}, 256), 1, 15), 16, 10)::bigint"

    def intersect_size(self, a: str, b: str) -> str:
        return f"size(array_intersect({a}, {b}))"


class Oracle(Dialect):
    """DuckDB SQL."""

    name = "duckdb"

    def days(self, later, earlier):
        return f"date_diff('day', ({earlier})::date, ({later})::date)::bigint"

    def plus_days(self, date, n):
        return f"(({date})::date + ({n})::int)"

    def pattern(self, p):
        return "'" + p + "'"

    def replace(self, s, p, to):
        return f"regexp_replace({s}, '{p}', '{to}', 'g')"

    def matches(self, s, p):
        return f"regexp_matches({s}, '{p}')"

    def count_matches(self, s, p):
        return f"len(regexp_extract_all({s}, '{p}'))::bigint"

    def starts(self, s, p):
        return f"starts_with({s}, {p})"

    def percentile(self, x, p):
        return f"quantile_cont({x}, {p})"

    def rint(self, x):
        return f"({x})::bigint"

    def sha256(self, s):
        return f"sha256({s})"

    def text_agg(self, value, by, order):
        return f"string_agg({value}, '{by}' ORDER BY {order})"

    def shingles(self, s, n):
        return f"list_distinct(list_transform(range(1, greatest(length({s}) - {n - 2}, 1)), lambda i: substr({s}, i, {n})))"

    def words(self, s):
        return rf"list_filter(regexp_split_to_array({s}, '\s+'), lambda w: w <> '')"

    def items(self, array):
        return f"unnest({array})"

    def size(self, array):
        return f"len({array})::bigint"

    def table(self, name, sf_dir):
        raise LookupError(name)

    def hash_bits(self, s):
        return f"('0x' || substr(sha256({s}), 1, 15))::bigint"

    def intersect_size(self, a, b):
        return f"len(list_intersect({a}, {b}))"


SPARK, DUCKDB = Dialect(), Oracle()
VIEWS: dict[str, Callable[[Dialect], str]] = {}


def view(name: str) -> Callable[[Callable[[Dialect], str]], Callable[[Dialect], str]]:
    """Declare a view; its body names the views and tables that it reads."""

    def add(body: Callable[[Dialect], str]) -> Callable[[Dialect], str]:
        if name in VIEWS or name in TABLES:
            raise ValueError(f"{name} is declared twice")
        VIEWS[name] = body
        return body

    return add


def render(name: str, dialect: Dialect, sf_dir: str = "") -> str:
    """The statement that selects a view."""
    done: dict[str, str] = {}

    def need(x: str, path: tuple[str, ...]) -> None:
        if x in done:
            return
        if x in path:
            raise ValueError(f"{x} reads itself")
        if x in TABLES:
            if dialect.name == "spark":
                done[x] = dialect.table(x, sf_dir)
            return
        body = VIEWS[x](dialect)
        for y in dict.fromkeys(re.findall(r"\b(?:FROM|JOIN)\s+([a-z][a-z0-9_]*)\b", body)):
            if y != x and (y in VIEWS or y in TABLES):
                need(y, (*path, x))
        done[x] = body

    need(name, ())
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in done.items()) + f"\nSELECT * FROM {name}"


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(render(name, SPARK, sf_dir))

    run.__name__ = name
    return run


def oracle(name: str) -> str:
    return render(name, DUCKDB)
