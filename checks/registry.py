"""Registered queries and their independent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, list[str]] = {}


def query(name: str, sql: str | None, covers: str):
    """Register a query; ``covers`` lists the operator ids it exercises."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        COVERS[name] = covers.split()
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


# --- small SQL text helpers -------------------------------------------------------


def rnd(x: str, digits: int = 6) -> str:
    return f"round(({x})::double, {digits})"


def even(x: str, digits: int) -> str:
    scale = 10**digits
    return f"(round_even(({x}) * {scale}.0, 0) / {scale}.0)"


def clip(x: str, lo: float | None, hi: float | None) -> str:
    out = x
    if lo is not None:
        out = f"greatest({out}, {lo})"
    if hi is not None:
        out = f"least({out}, {hi})"
    return f"(case when {x} is not null then {out} end)"


def steps(x: str, ladder, op: str, otherwise, missing="null") -> str:
    arms = " ".join(f"when {x} {op} {t} then {s}" for t, s in ladder)
    return f"(case when {x} is null then {missing} {arms} else {otherwise} end)::double"


def pct(x: str, part: str) -> str:
    """Average-tie percentile rank, nulls stay null."""
    return (
        f"(case when {x} is not null then (rank() over (partition by {part}, ({x}) is null order by {x})"
        f" + (count(*) over (partition by {part}, {x}) - 1) / 2.0)"
        f" / count({x}) over (partition by {part}) end)"
    )


def desc_rank(x: str, part: str) -> str:
    """Descending average-tie rank, truncated."""
    return (
        f"cast(floor(rank() over (partition by {part} order by {x} desc nulls last)"
        f" + (count(*) over (partition by {part}, {x}) - 1) / 2.0) as int)"
    )
