"""Checks on column names; they read only the schema."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Return ``df`` if it has every named column, else raise naming all that are absent."""
    present = set(df.columns)
    absent = [name for name in names if name not in present]
    if absent:
        raise ValueError(f"required columns not found: {absent}")
    return df


def quoted(name: str) -> str:
    """A column's name for the places where a dot would mean a field."""
    return "`" + name.replace("`", "``") + "`"


def by_name(df: DataFrame, name: str) -> Column:
    """A column of a frame by its plain name, whatever characters that has."""
    return df[quoted(name)]


def quoted_all(names: Iterable[str]) -> list[str]:
    return [quoted(name) for name in names]


def own_columns(df: DataFrame) -> Sequence[str]:
    """All columns of a frame, to select them by their plain names."""
    return quoted_all(df.columns)
