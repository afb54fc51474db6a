"""Reading and changing stored rows: filters, pages, updates and deletes, as new DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matching(filters: dict | None) -> Column:
    """All columns equal their values; a list means one of, None null."""
    parts = [F.col(c).isin(v) if isinstance(v, list) else F.col(c).isNull() if v is None else F.col(c) == v for c, v in (filters or {}).items()]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def browse(df: DataFrame, filters: dict | None = None, skip: int = 0, limit: int = 50, order_by: list | None = None) -> DataFrame:
    """A page of the rows that match. The order should be total, or pages may overlap."""
    out = df.where(matching(filters))
    if order_by:
        out = out.orderBy(*order_by)
    return out.offset(skip).limit(limit) if skip else out.limit(limit)


def get(df: DataFrame, key: dict) -> DataFrame:
    return df.where(matching(key)).limit(1)


def exists(df: DataFrame, column: str, value) -> bool:
    return not df.where(F.col(column) == value).isEmpty()


def has_data(df: DataFrame) -> bool:
    return not df.isEmpty()


def existing(values: DataFrame, column: str, df: DataFrame, key: str) -> DataFrame:
    """The rows of values whose column is a key of df: many existence checks as one semi join."""
    return values.join(df.select(F.col(key).alias("_key")), F.col(column) == F.col("_key"), "left_semi")


def update(df: DataFrame, key: dict, changes: dict) -> DataFrame:
    """df with the values of `changes` (values or Columns) in the rows that match."""
    return df.withColumns({c: F.when(matching(key), v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, v in changes.items()}) if changes else df


def delete(df: DataFrame, key: dict) -> DataFrame:
    return df.where(~F.coalesce(matching(key), F.lit(False)))


def next_key(df: DataFrame, key: str) -> DataFrame:
    """One row: next_id, one more than the largest integer key, or than the number of rows where keys aren't integers."""
    largest = F.max(F.col(key).try_cast("long"))
    return df.agg((F.coalesce(largest, F.count(F.lit(1))) + 1).alias("next_id"))


def known_columns(df: DataFrame, columns: list[str], generated: list[str] = ()) -> DataFrame:
    """df without columns that the target doesn't know or fills by itself."""
    return df.select(*[c for c in df.columns if c in columns and c not in generated])
