"""Exact quantiles in two scans, without holding the values of a group in one task.

Spark's ``percentile`` keeps a value-to-count map per group in one reducer, which grows
with the number of distinct values. Here every number falls into a *cell*: a narrow range,
monotone in the number. The first scan only counts per cell (combined before the shuffle),
which tells in which cells the wanted ranks lie. The second scan looks at the values of
those few cells alone. Equal values are counted, never listed, so a value shared by a third
of the rows costs one row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sizing import null_safe_join, settle, total_of

# Cells per doubling of the number. A cell spans under 0.01 % of its value, and whole
# numbers below this have a cell of their own.
CELLS_PER_OCTAVE = 8192

# |log2| of every finite double stays below this; infinities are clamped to it.
MAX_OCTAVE = 1100


def cell_of(value: Column) -> Column:
    """Cell number of a double: never decreasing in ``value``."""

    def size(magnitude: Column) -> Column:
        octave = F.least(F.log2(magnitude), F.lit(MAX_OCTAVE - 1.0))
        return F.floor(octave * CELLS_PER_OCTAVE) + F.lit(MAX_OCTAVE * CELLS_PER_OCTAVE)

    return (
        F.when(value > 0, size(value))
        .when(value < 0, -size(-value))
        .when(value == 0, F.lit(0).cast("bigint"))
    )


def _between(below: Column, above: Column, share: Column) -> Column:
    return below + (above - below) * share


def summarise(
    df: DataFrame,
    value: Column,
    by: Sequence[str] = (),
    probs: Sequence[float] = (0.25, 0.5, 0.75),
    tallies: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per group: ``rows, all_rows, n, mean, lowest, highest, quantiles``, tallies.

    ``value`` is a double expression; its NULLs do not count in ``n`` or the statistics, but
    their rows count in ``rows``, so a group without any number is kept. ``all_rows`` counts
    the rows of all groups. ``quantiles`` is an
    array parallel to ``probs`` with linear interpolation. ``tallies`` are boolean
    expressions counted per group in the same scan.

    The first scan runs when this is called: its result (one row per group) decides, by a
    checked size, between a broadcast and a shuffled join in the second.
    """
    by = list(by)
    tallies = dict(tallies or {})
    base = df.select(
        *by, value.alias("_x"), *[flag.alias(name) for name, flag in tallies.items()]
    ).withColumn("_cell", cell_of(F.col("_x")))

    cells = base.groupBy(*by, "_cell").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count("_x").alias("_n"),
        F.sum("_x").alias("_sum"),
        F.min("_x").alias("_lo"),
        F.max("_x").alias("_hi"),
        *[F.count_if(F.col(name)).alias(name) for name in tallies],
    )
    group = Window.partitionBy(*by)
    upto = group.orderBy(F.col("_cell").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    # The number of cells of a group is bounded by the range of doubles, not by its rows.
    placed = cells.withColumn("_total", F.sum("_n").over(group)).withColumn(
        "_before", F.sum("_n").over(upto) - F.col("_n")
    )
    wanted = [
        bound((F.col("_total") - 1) * F.lit(float(p))).cast("bigint")
        for p in probs
        for bound in (F.floor, F.ceil)
    ]
    end = F.col("_before") + F.col("_n")
    is_hot = reduce(or_, [(rank >= F.col("_before")) & (rank < end) for rank in wanted])
    ranks = F.filter(
        F.array_distinct(F.array(*wanted)), lambda rank: (rank >= F.col("_before")) & (rank < end)
    )
    # At most two cells per quantile hold a wanted rank, so the list stays short.
    heads = placed.groupBy(*by).agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"),
        F.try_divide(F.sum("_sum"), F.sum("_n")).alias("mean"),
        F.min("_lo").alias("lowest"),
        F.max("_hi").alias("highest"),
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in tallies],
        F.collect_list(
            F.when(is_hot, F.struct("_cell", "_before", "_lo", "_hi", ranks.alias("_ranks")))
        ).alias("_hot"),
    )
    heads, rows = settle(heads)
    small = rows is not None
    all_rows = F.lit(sum(row["rows"] for row in rows)).cast("bigint") if small else total_of(heads, "rows")

    hot = heads.select(*by, F.inline("_hot"))
    closed = hot.where("_lo = _hi").select(*by, F.explode("_ranks").alias("_rank"), F.col("_lo").alias("_x"))
    opened = hot.where("_lo < _hi").select(*by, "_cell", "_before", "_ranks")
    found = closed
    if rows is None or any(cell["_lo"] < cell["_hi"] for row in rows for cell in row["_hot"]):
        inside = base.where(F.col("_cell").isNotNull()).select(*by, "_cell", "_x")
        if small:
            inside = null_safe_join(
                inside, opened.select(*by, "_cell"), [*by, "_cell"], "left_semi", broadcast_right=True
            )
        # Equal values are merged before any shuffled join, so a hot value is one row.
        counted = inside.groupBy(*by, "_cell", "_x").agg(F.count(F.lit(1)).alias("_c"))
        running = (
            Window.partitionBy(*by, "_cell")
            .orderBy("_x")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        located = null_safe_join(
            counted, opened, [*by, "_cell"], "inner", broadcast_right=small
        ).withColumn("_upto", F.sum("_c").over(running))
        last = F.col("_before") + F.col("_upto")
        exact = located.select(
            *by,
            F.explode(
                F.filter("_ranks", lambda r: (r >= last - F.col("_c")) & (r < last))
            ).alias("_rank"),
            "_x",
        )
        found = closed.unionByName(exact)

    # At most two ranks per quantile, so this map has a fixed size.
    by_rank = found.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("_rank", "_x"))).alias("_at")
    )
    flat = heads.drop("_hot")
    if by:
        joined = null_safe_join(flat, by_rank, by, "left", broadcast_right=small)
    else:
        joined = flat.withColumn("_at", by_rank.select("_at").scalar())

    def quantile(p: float) -> Column:
        place = (F.col("n") - 1) * F.lit(float(p))
        at = lambda rank: F.try_element_at("_at", rank.cast("bigint"))
        return _between(at(F.floor(place)), at(F.ceil(place)), place - F.floor(place))

    return joined.select(
        *by,
        "rows",
        all_rows.alias("all_rows"),
        "n",
        "mean",
        "lowest",
        "highest",
        F.array(*[quantile(p) for p in probs]).alias("quantiles"),
        *tallies,
    )
