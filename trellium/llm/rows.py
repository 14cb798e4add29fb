"""The caller's columns in one struct, so that none can clash with an operator's own.

``carry`` puts them into the column ``row``; what the operator needs of them, and what it
adds, stands beside it under its own names until ``restore`` unpacks the struct. Names
are compared as Spark does by default, without regard to case.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType


def named(name: str) -> Column:
    """The column of just this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def kept(df: DataFrame, replaced: Iterable[str]) -> list[str]:
    gone = {x.lower() for x in replaced}
    return [c for c in df.columns if c.lower() not in gone]


def carry(df: DataFrame, replaced: Iterable[str] = (), **own: Column) -> DataFrame:
    """``row``, a struct of all columns but those replaced, and the operator's own columns."""
    columns = [named(c) for c in kept(df, replaced)]
    row = F.struct(*(columns or [F.lit(True).alias("none")]))
    return df.select(row.alias("row"), *[x.alias(name) for name, x in own.items()])


def restore(names: Iterable[str]) -> list[Column]:
    """The columns of these names out of ``row``."""
    return [F.col("row").getField(n).alias(n) for n in names]


def schema(df: DataFrame, *more: tuple[str, str]) -> StructType:
    """The schema of ``df`` with more fields; what Arrow code returns may be null anywhere."""
    out = StructType()
    for field in df.schema.fields:
        out = out.add(field.name, field.dataType, True)
    for name, kind in more:
        out = out.add(name, DataType.fromDDL(kind), True)
    return out
