"""Registry of checked queries: a Spark call and, where SQL can say it, a twin."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from .fixtures import duck_view, views
from .lake import Lake

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CTES: dict[str, str] = {f"v_{n}": duck_view(n) for n in views("duck")}

CTES["v_as_of"] = "select max(ts) as as_of from events"
CTES["v_claims_as_of"] = "select max(l_shipdate) as as_of from lineitem"


def plain_types(df: DataFrame) -> DataFrame:
    """Decimals as doubles, dates and timestamps as text: equal in both engines."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        out.append(c.alias(f.name))
    return df.select(*out)


def with_ctes(body: str) -> str:
    """Prefix the CTEs a body needs, in dependency order."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bv_\w+\b", text)):
            if name in CTES and name not in order:
                visit(CTES[name])
                order.append(name)

    visit(body)
    if not order:
        return body
    return "with " + ",\n".join(f"{n} as ({CTES[n]})" for n in order) + "\n" + body


def oracle() -> dict[str, str]:
    """Complete SQL text per query."""
    return {name: with_ctes(body) for name, body in SQL.items()}


def query(name: str, sql: str | None = None):
    """Register `fn(lake) -> DataFrame` under a name."""

    def register(fn: Callable[[Lake], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return plain_types(fn(Lake(spark, folder)))

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


# --- SQL text helpers -----------------------------------------------------------


def rdiv(num: str, den: str, digits: int) -> str:
    """Half-up rounded quotient of two non-negative integers, computed exactly."""
    p = 10**digits
    return (
        f"(cast((2 * cast({num} as hugeint) * {p} + ({den})) // (2 * cast({den} as hugeint)) as double) / {p})"
    )


def avg_dec(col: str, scale: int, digits: int, cond: str | None = None) -> str:
    """Half-up rounded mean of a non-negative decimal column."""
    when = f" filter (where {cond})" if cond else ""
    s = f"cast(sum({col}){when} * {10**scale} as hugeint)"
    n = f"(count({col}){when} * {10**scale})"
    return f"(case when count({col}){when} = 0 then null else {rdiv(s, f'nullif({n}, 0)', digits)} end)"


def ts_text(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


def num_text(expr: str) -> str:
    return f"regexp_replace(cast(cast({expr} as decimal(24,6)) as varchar), '\\.?0+$', '')"


def day_text(expr: str) -> str:
    return f"cast(cast({expr} as date) as varchar)"
