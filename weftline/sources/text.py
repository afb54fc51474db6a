"""Rows as text: CSV lines and INSERT statements, quoted as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NESTED = (T.StructType, T.ArrayType, T.MapType)


def as_text(name: str, kind: T.DataType) -> Column:
    value = F.col(f"`{name}`")
    if isinstance(kind, NESTED):
        return F.to_json(value)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(value))
    return value.cast("string")


def csv_field(text: Column) -> Column:
    """Null is empty; quoted where a comma, a quote or a line end stands in it."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike('[,"\n\r]'), quoted).otherwise(text), F.lit(""))


def csv_line(df: DataFrame) -> Column:
    """The row of df, which must be a selection of the frame that the column is used on."""
    return F.concat_ws(",", *[csv_field(as_text(f.name, f.dataType)) for f in df.schema.fields])


def literal(name: str, kind: T.DataType) -> Column:
    """NULL, TRUE or FALSE, a bare number, or text between single quotes."""
    text = as_text(name, kind)
    if isinstance(kind, T.BooleanType):
        text = F.upper(text)
    elif not isinstance(kind, T.NumericType):
        text = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(text, F.lit("NULL"))


def insert_literal(table: str, df: DataFrame) -> Column:
    columns = ", ".join(f.name for f in df.schema.fields)
    return F.concat(F.lit(f"INSERT INTO {table} ({columns}) VALUES ("), F.concat_ws(", ", *[literal(f.name, f.dataType) for f in df.schema.fields]), F.lit(");"))
