"""Query registry: one entry per operator, with the SQL that must give the same rows.

A spec such as ``"run:i frame:i v:6 name:s"`` fixes the output columns: ``i``
casts to BIGINT, ``s`` to STRING, ``b`` to BOOLEAN and a digit rounds a DOUBLE
to that many places. It is applied to both sides, so they share one schema. A
nudge far below the last place goes on before rounding, so that exact halves (a
mean of prices, say) round one way in spite of the last bit of a sum.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_SPARK = {"i": "bigint", "s": "string", "b": "boolean"}
_SQL = {"i": "BIGINT", "s": "VARCHAR", "b": "BOOLEAN"}


def _parse(spec: str) -> list[tuple[str, str]]:
    return [tuple(item.split(":")) for item in spec.split()]


def _nudge(kind: str) -> str:
    return f"1.7e-{int(kind) + 4}"


def shape(df: DataFrame, spec: str) -> DataFrame:
    cols = []
    for name, kind in _parse(spec):
        c = F.col(name)
        cols.append(
            (c.cast(_SPARK[kind]) if kind in _SPARK else F.round(c.cast("double") + float(_nudge(kind)), int(kind)) + F.lit(0.0)).alias(name)
        )
    return df.select(*cols)


def _expand_hypot(sql: str) -> str:
    """DuckDB has no ``hypot``: write each call out as the root of two squares."""
    while (start := sql.rfind("hypot(")) >= 0:
        depth, args, begin, i = 1, [], start + 6, start + 6
        while depth:
            ch = sql[i]
            depth += (ch == "(") - (ch == ")")
            if (ch == "," and depth == 1) or depth == 0:
                args.append(sql[begin:i])
                begin = i + 1
            i += 1
        sql = f"{sql[:start]}sqrt(pow({args[0]}, 2) + pow({args[1]}, 2)){sql[i:]}"
    return sql


def shape_sql(sql: str, spec: str) -> str:
    cols = [
        f"CAST({name} AS {_SQL[kind]}) AS {name}"
        if kind in _SQL
        else f"round(CAST({name} AS DOUBLE) + {_nudge(kind)}, {kind}) + 0.0 AS {name}"
        for name, kind in _parse(spec)
    ]
    return f"SELECT {', '.join(cols)} FROM ({_expand_hypot(sql.strip())}) AS q"


def query(key: str, spec: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``key``."""

    def wrap(fn):
        if key in QUERIES:
            raise KeyError(f"duplicate query {key}")
        QUERIES[key] = lambda spark, sf_dir: shape(fn(spark, sf_dir), spec)
        if sql is not None:
            ORACLES[key] = shape_sql(sql, spec)
        return fn

    return wrap
