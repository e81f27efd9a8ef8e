"""Small column-expression helpers shared by the operators.

All of them build Catalyst expressions (no Python per row), so they stay
inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_null(dtype: str = "double") -> Column:
    return F.lit(None).cast(dtype)


def clamp(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    # greatest/least skip NULLs; keep NULL in, NULL out.
    return F.when(c.isNull(), lit_null()).otherwise(out)


def div(a: Column, b: Column) -> Column:
    """a / b, NULL when b is 0 or NULL (ANSI-safe)."""
    return F.try_divide(a, b)


def finite(c: Column) -> Column:
    """NaN and +-inf become NULL (pandas treats them as missing)."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), lit_null()).otherwise(d)


def r(c: Column, places: int = 2) -> Column:
    return F.round(c, places)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC_TYPES) and not isinstance(dtype, T.BooleanType)


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, DATETIME_TYPES)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in ex]


def datetime_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if is_datetime(f.dataType) and f.name not in ex]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in ex]


def q(name: str) -> str:
    """Back-quote a column name for SQL expressions."""
    return "`" + name.replace("`", "``") + "`"


def skewness_adjusted(c: Column) -> Column:
    """Sample skewness as pandas reports it (bias corrected)."""
    n = F.count(c).cast("double")
    g1 = F.skewness(c)
    return g1 * F.sqrt(n * (n - 1)) / (n - 2)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", *,
                   equal: Sequence[str] = ()) -> DataFrame:
    """Join on ``keys`` with NULL equal to NULL, and on ``equal`` by plain equality
    (NULL meets nothing); the key columns of the left side are kept."""
    names = [*keys, *equal]
    other = right.select(*[F.col(q(c)).alias(f"__r_{c}") if c in names else F.col(q(c)) for c in right.columns])
    on = F.lit(True)
    for c in keys:
        on = on & F.col(q(c)).eqNullSafe(F.col(q(f"__r_{c}")))
    for c in equal:
        on = on & (F.col(q(c)) == F.col(q(f"__r_{c}")))
    return left.join(other, on, how).drop(*[f"__r_{c}" for c in names])
