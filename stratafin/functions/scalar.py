"""Scalar building blocks: null-safe arithmetic, clipping, rounding, ladders."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def safe_double(value: str | Column) -> Column:
    """Number or NULL: text that is no number, NaN and infinities become NULL."""
    number = col(value).try_cast("double")
    return F.when(F.isnan(number) | (F.abs(number) == float("inf")), None).otherwise(number)


def ratio(top: str | Column, bottom: str | Column) -> Column:
    """Division that yields NULL on a zero or missing denominator."""
    below = col(bottom).cast("double")
    return col(top).cast("double") / F.nullif(below, F.lit(0.0))


def ratio_if_positive(top: str | Column, bottom: str | Column) -> Column:
    below = col(bottom).cast("double")
    return F.when(below > 0, col(top).cast("double") / below)


def clip(value: str | Column, low: float | None = None, high: float | None = None) -> Column:
    """Clamp to bounds; NULL stays NULL (unlike greatest/least, which skip NULLs)."""
    x = col(value)
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(x.isNotNull(), out)


def half_even(value: str | Column, digits: int) -> Column:
    """Round half to even on the scaled double, the convention of array libraries."""
    scale = 10.0**digits
    return F.rint(col(value) * F.lit(scale)) / F.lit(scale)


def settled_mean(value: str | Column, digits: int) -> Column:
    """Mean of values that carry ``digits`` decimals: the sum is settled to those
    decimals first, so the result does not depend on the order partial sums met."""
    scale = F.lit(10.0**digits)
    return F.rint(F.sum(col(value)) * scale) / scale / F.count(col(value))


def first_nonzero(*values: str | Column) -> Column:
    """First value that is neither missing nor zero (``a or b`` over numbers)."""
    return F.coalesce(*[F.nullif(safe_double(v), F.lit(0.0)) for v in values])


def first_text(*values: str | Column) -> Column:
    """First text that is neither missing nor blank."""
    return F.coalesce(*[F.nullif(F.trim(col(v)), F.lit("")) for v in values])


def ladder_above(value: str | Column, steps: Sequence[tuple], otherwise, missing=None) -> Column:
    """Score of the first step whose threshold is strictly below ``value``."""
    return _ladder(col(value), steps, lambda x, t: x > F.lit(t), otherwise, missing)


def ladder_below(value: str | Column, steps: Sequence[tuple], otherwise, missing=None) -> Column:
    """Score of the first step whose threshold is strictly above ``value``."""
    return _ladder(col(value), steps, lambda x, t: x < F.lit(t), otherwise, missing)


def ladder_at_least(value: str | Column, steps: Sequence[tuple], otherwise, missing=None) -> Column:
    return _ladder(col(value), steps, lambda x, t: x >= F.lit(t), otherwise, missing)


def ladder_at_most(value: str | Column, steps: Sequence[tuple], otherwise, missing=None) -> Column:
    return _ladder(col(value), steps, lambda x, t: x <= F.lit(t), otherwise, missing)


def _ladder(x: Column, steps, test, otherwise, missing) -> Column:
    out = F.when(x.isNull(), F.lit(missing))
    for threshold, score in steps:
        out = out.when(test(x, threshold), F.lit(score))
    return out.otherwise(F.lit(otherwise))


def holds(condition: Column) -> Column:
    """Three-valued logic folded to two: unknown counts as false."""
    return F.coalesce(condition, F.lit(False))


def with_missing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add absent optional columns as typed NULLs so the plan has one shape."""
    absent = {c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


def default_columns(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Add missing columns and fill NULLs with their default."""
    exprs = {}
    for name, value in defaults.items():
        exprs[name] = F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value)
    return df.withColumns(exprs)


def winsorise(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Clip every bounded column that is present."""
    return df.withColumns({c: clip(F.col(c).cast("double"), lo, hi) for c, (lo, hi) in bounds.items() if c in df.columns})


def literal_rows(rows: Iterable[dict]) -> Column:
    """Fixed rows as one array-of-struct literal, so a small constant table can
    be exploded beside a big one without any join."""
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in row.items()]) for row in rows])


def band(value: str | Column, bands: Sequence[tuple[float, str]], top: str) -> Column:
    """Label of the first band whose upper edge is at or above ``value``."""
    return ladder_at_most(value, bands, top)
