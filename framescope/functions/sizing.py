"""Size-checked small frames and null-safe joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..sources.scratch import new_path
from .guards import by_name

# A frame is treated as small only after a probe has seen that it has no more rows than this.
MAX_SMALL_ROWS = 10_000

# A table of short keys is broadcast up to this number.
MAX_KEYED_ROWS = 500_000


def settle(frame: DataFrame, max_rows: int | None = None) -> tuple[DataFrame, list[Row] | None]:
    """Probe whether ``frame`` is small, reading at most one row more than the limit.

    A small frame comes back as a local one (its plan is not run a second time) together
    with its rows: it may be broadcast. A larger frame is written to the shared folder, so
    that it is computed once however often it is used, and comes back with ``None``: it has
    to be joined by a shuffle.
    """
    limit = MAX_SMALL_ROWS if max_rows is None else max_rows
    spark = frame.sparkSession
    rows = frame.limit(limit + 1).collect()
    if len(rows) > limit:
        path = new_path(spark, "settled")
        frame.write.parquet(path)
        return spark.read.parquet(path), None
    return spark.createDataFrame(rows, frame.schema), rows


def keyed_table(frame: DataFrame, max_rows: int | None = None) -> tuple[DataFrame, bool]:
    """``frame`` written to the shared folder, and whether it has few enough rows to be broadcast.

    For a table of short keys that is joined more than once, or is too long to be a local frame.
    """
    path = new_path(frame.sparkSession, "keyed")
    frame.write.parquet(path)
    written = frame.sparkSession.read.schema(frame.schema).parquet(path)
    return written, written.count() <= (MAX_KEYED_ROWS if max_rows is None else max_rows)


def total_of(grouped: DataFrame, column: str) -> Column:
    """Sum of a column over a grouped frame, as a scalar.

    The other columns are asked for too: with the same columns, this branch is the same
    aggregation as that of the caller, and Spark runs its scan and shuffle once for both.
    """
    others = [F.max(by_name(grouped, name)).alias(name) for name in grouped.columns if name != column]
    return grouped.agg(F.struct(F.sum(column).alias("_total"), *others)).scalar()["_total"]


def null_safe_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str,
    broadcast_right: bool = False,
) -> DataFrame:
    """Equi-join in which a NULL key matches a NULL key; the left key columns are kept.

    Set ``broadcast_right`` only when the size of ``right`` has a proven bound. Spark would
    have to join without a key when ``keys`` is empty, so one-row frames are not joined
    here: their values are read as scalar subqueries.
    """
    if not keys:
        raise ValueError("a join needs at least one key")
    renamed = right.withColumnsRenamed({key: f"__right_{key}" for key in keys})
    if broadcast_right:
        renamed = F.broadcast(renamed)
    condition = None
    for key in keys:
        same = by_name(left, key).eqNullSafe(by_name(renamed, f"__right_{key}"))
        condition = same if condition is None else condition & same
    return left.join(renamed, condition, how).drop(*[f"__right_{key}" for key in keys])
