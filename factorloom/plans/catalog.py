"""The registry of the panel queries, each with its DuckDB twin over the same fixture views.

A query names its columns once: plain, ``~`` for doubles (rounded to six digits on both sides; ``!`` to two, where values
are large sums, and ``^`` to nine, where short decimals would lie halfway) and ``#`` for whole numbers (64 bit on both
sides).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.plans.fixtures import VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Named relations of the twins: SQL text in which other names of this table or fixture views may stand.
RELATIONS: dict[str, str] = {}


DIGITS = {"~": 6, "!": 2, "^": 9}


def columns(spec: str) -> list[tuple[str, str]]:
    return [(c[0], c[1:]) if c[0] in "~!^#" else ("", c) for c in spec.split()]


def needed(sql: str) -> list[str]:
    """The relations that sql uses, in an order in which each comes after those that it uses itself."""
    known = RELATIONS | VIEWS
    out: list[str] = []
    for name in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", sql):
        if name in known:
            for inner in [*needed(known[name]), name]:
                if inner not in out:
                    out.append(inner)
    return out


def oracle(spec: str, sql: str) -> str:
    known = RELATIONS | VIEWS
    parts = [f"{name} AS ({known[name]})" for name in needed(sql)]
    picked = [f"round({c}, {DIGITS[kind]}) AS {c}" if kind in DIGITS else f"CAST({c} AS BIGINT) AS {c}" if kind else c for kind, c in columns(spec)]
    return (f"WITH {', '.join(parts)} " if parts else "") + f"SELECT {', '.join(picked)} FROM ({sql}) AS result"


def query(name: str, spec: str, sql: str | None) -> Callable:
    """Register a function of Tables as a query; sql is its twin, None where SQL can't express it."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = build(Tables(spark, sf_dir))
            picked = [F.round(F.col(c).cast("double"), DIGITS[kind]) if kind in DIGITS else F.col(c).cast("long") if kind else F.col(c) for kind, c in columns(spec)]
            return df.select(*[x.alias(c) for x, (_, c) in zip(picked, columns(spec))])

        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = oracle(spec, sql)
        return build

    return register
