"""Text fields to values, null where they are none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def number(df: DataFrame, name: str) -> Column:
    """A finite double; columns that are numeric already are only checked."""
    kind = dict(df.dtypes)[name]
    v = F.col(name).cast("double") if kind != "string" else F.when(F.trim(name).rlike(_NUMBER), F.trim(name)).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def timestamp(text: Column) -> Column:
    """``2025-05-01 01:02:03``, also without leading zeros."""
    return F.try_to_timestamp(F.trim(text), F.lit("yyyy-M-d H:m:s"))


def seconds(text: Column) -> Column:
    return F.unix_timestamp(timestamp(text))
