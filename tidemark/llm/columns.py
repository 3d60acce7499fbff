"""Callers' columns under names that no operator uses, and the types that operators ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def covered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with every column renamed, and the new name of each; helper columns can't clash with them."""
    names = [f"_carried_{k}" for k in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names))


def uncovered(frame: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` out of ``frame``, which holds them covered."""
    return frame.select(*[f"_carried_{k}" for k in range(len(docs.columns))]).toDF(*docs.columns)


def whole_numbers(docs: DataFrame, *names: str) -> None:
    """Refuse columns that do not hold whole numbers of at most 64 bits."""
    for name in names:
        kind = docs.select(F.col(name)).schema[0].dataType
        if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.NullType)):
            raise TypeError(f"{name} must hold whole numbers, not {kind.simpleString()}")
