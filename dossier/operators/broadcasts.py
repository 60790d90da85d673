"""Broadcasts behind a bound of bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a table that may be broadcast, as row_bytes() counts them.
BROADCAST_BYTES = 64 << 20


def _fixed_width(kind: T.DataType) -> int | None:
    """Bytes of a value, about; None if it depends on the value."""
    if isinstance(kind, T.StructType):
        widths = [_fixed_width(f.dataType) for f in kind.fields]
        return None if None in widths else 16 + sum(widths)
    return None if isinstance(kind, T.StringType | T.BinaryType | T.ArrayType | T.MapType) else 8


def _width(value: Column, kind: T.DataType) -> Column:
    fixed = _fixed_width(kind)
    if fixed is not None:
        return F.lit(fixed).cast("long")
    if isinstance(kind, T.StructType):
        return sum((_width(value[f.name], f.dataType) for f in kind.fields), F.lit(16).cast("long"))
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.MapType):
        return _width(F.map_keys(value), T.ArrayType(kind.keyType)) + _width(F.map_values(value), T.ArrayType(kind.valueType))
    fixed = _fixed_width(kind.elementType)
    if fixed is not None:
        return F.coalesce(F.size(value), F.lit(0)).cast("long") * fixed + 16
    return F.coalesce(F.aggregate(value, F.lit(16).cast("long"), lambda total, x: total + _width(x, kind.elementType)), F.lit(16).cast("long"))


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row of df, from its lengths of texts and lists."""
    return sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16).cast("long"))


def bounded_broadcast(df: DataFrame, most: int | None = None) -> DataFrame | None:
    """df with a broadcast hint if its rows have at most so many bytes together, else None: the caller joins another way."""
    size = df.agg(F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= (BROADCAST_BYTES if most is None else most) else None


def few_or_all(df: DataFrame) -> DataFrame:
    """df, broadcast if it is small enough; beyond that a join with it shuffles both sides by key.

    df is read to be measured, so what is costly to make is better written to the shared folder first.
    """
    few = bounded_broadcast(df)
    return df if few is None else few
