"""Ways to deal with missing values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from ..functions.cleaning import is_missing
from ..functions.guards import by_name, own_columns, quoted, quoted_all, require_columns
from ..functions.quantiles import summarise
from ..functions.sizing import null_safe_join, settle
from ..sources.scratch import new_path
from .profile import missing_report

# Rows of one key that one task should sort, about.
MAX_CHUNK_ROWS = 5_000_000

# Most ranges that large keys are dealt to; beyond it the ranges grow.
MAX_RANGES = 100_000


def _filled(df: DataFrame, column: str, value: Column) -> Column:
    """The column with its missing values replaced, in its own type."""
    dtype = df.schema[column].dataType
    return F.when(is_missing(by_name(df, column), dtype), value.cast(dtype)).otherwise(by_name(df, column))


def drop_incomplete_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Listwise deletion: keep only rows that are complete in the columns."""
    names = list(columns or df.columns)
    require_columns(df, names)
    whole = ~is_missing(by_name(df, names[0]), df.schema[names[0]].dataType)
    for name in names[1:]:
        whole &= ~is_missing(by_name(df, name), df.schema[name].dataType)
    return df.where(whole)


def drop_sparse_columns(df: DataFrame, limit_pct: float, keep: Sequence[str] = ()) -> DataFrame:
    """Delete the columns whose missing share exceeds the limit.

    One job measures the shares first (one row per column), as the result's columns depend on it.
    """
    report = missing_report(df)
    sparse = [r["column"] for r in report.where(F.col("pct") > limit_pct).select("column").collect()]
    return df.drop(*[name for name in sparse if name not in keep])


def fill_fixed(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Replace missing values by a fixed value per column."""
    require_columns(df, values)
    return df.withColumns({name: _filled(df, name, F.lit(value)) for name, value in values.items()})


def _modes(df: DataFrame, present: Mapping[str, Column]) -> DataFrame:
    """One row with the most frequent value per column as text, the smallest of a tie.

    All columns are counted in one scan. The second step sees one row per distinct value
    and combines before its shuffle.
    """
    long = df.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(name).alias("column"), value.cast("string").alias("value"))
                    for name, value in present.items()
                ]
            )
        )
    )
    counts = long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy().agg(
        *[
            F.min_by("value", F.when(F.col("column") == name, F.struct(-F.col("n"), _typed(df, name))))
            .alias(name)
            for name in present
        ]
    )


def _typed(df: DataFrame, name: str) -> Column:
    return F.col("value").try_cast(df.schema[name].dataType)


def fill_statistic(df: DataFrame, strategies: Mapping[str, str]) -> DataFrame:
    """Replace missing values by ``mean``, ``median`` or ``mode`` of the column.

    The median is exact. The mode is the most frequent value, the smallest one of a tie. A
    column of whole numbers becomes double by a mean or median. One scan serves
    all means, one all modes, and at most two all medians.
    """
    require_columns(df, strategies)
    unknown = set(strategies.values()) - {"mean", "median", "mode"}
    if unknown:
        raise ValueError(f"unknown strategies: {sorted(unknown)}")

    def having(strategy: str) -> dict[str, Column]:
        return {
            name: F.when(~is_missing(by_name(df, name), df.schema[name].dataType), by_name(df, name))
            for name, wanted in strategies.items()
            if wanted == strategy
        }

    values: dict[str, Column] = {}
    means, medians, modes = having("mean"), having("median"), having("mode")
    if means:
        row = df.agg(F.struct(*[F.avg(value).alias(name) for name, value in means.items()])).scalar()
        values |= {name: row[name] for name in means}
    if medians:
        long = df.select(
            F.inline(
                F.array(
                    *[
                        F.struct(F.lit(name).alias("column"), value.cast("double").alias("v"))
                        for name, value in medians.items()
                    ]
                )
            )
        )
        halves = summarise(long, F.col("v"), ["column"], (0.5,))
        row = halves.agg(
            F.struct(
                *[
                    F.max(F.when(F.col("column") == name, F.col("quantiles")[0])).alias(name)
                    for name in medians
                ]
            )
        ).scalar()
        values |= {name: row[name] for name in medians}
    if modes:
        row = _modes(df, modes).select(F.struct(*modes)).scalar()
        values |= {name: row[name] for name in modes}
    exact = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)

    def filled(name: str, value: Column) -> Column:
        if strategies[name] != "mode" and isinstance(df.schema[name].dataType, exact):
            return F.coalesce(by_name(df, name).cast("double"), value)
        return _filled(df, name, value)

    return df.withColumns({name: filled(name, value) for name, value in values.items()})


# What `_around` looks for: the last value up to a row, or the first one from it on.
BEFORE, AFTER = "before", "after"


def _around(
    df: DataFrame,
    value: Column,
    keys: Sequence[str],
    order: Sequence[str],
    wanted: Mapping[str, str],
    chunk: Column | None = None,
    most: int | None = None,
    peers: bool = False,
) -> DataFrame:
    """``df`` with a column for each name in ``wanted``: the nearest value before or after the row.

    ``value`` is NULL where there is none to give; a row's own value counts as both. A key with
    at most ``most`` rows is sorted in one task. The rows of larger keys are dealt by ranges
    of the key and its order, so that each range is sorted in a task of its own, and the outermost values of the
    ranges are carried over those between. Rows that agree in key and order have no order and
    are never cut apart; with ``peers`` each of them sees the values of all of them.
    """
    base = df.withColumn("_v", value)
    if chunk is not None:
        return _over_chunks(base, keys, order, chunk, wanted, peers)
    limit = MAX_CHUNK_ROWS if most is None else most
    sizes = df.groupBy(*quoted_all(keys)).agg(F.count(F.lit(1)).alias("_n"))
    hot, few = settle(sizes.where(F.col("_n") > limit))
    if few is not None and not few:
        return _over_keys(base, keys, order, wanted, peers)
    names = hot.drop("_n")
    cold = null_safe_join(base, names, keys, "left_anti", broadcast_right=few is not None)
    large = null_safe_join(base, names, keys, "left_semi", broadcast_right=few is not None)
    ranges = hot.agg(F.sum("_n").alias("n")).first()["n"] // max(1, limit) + 1
    # The number of the range is written with the rows: drawing the ranges again could cut elsewhere.
    path = new_path(df.sparkSession, "ranges")
    dealt = large.repartitionByRange(int(min(ranges, MAX_RANGES)), *quoted_all([*keys, *order]))
    dealt.withColumn("_range", F.spark_partition_id()).write.parquet(path)
    schema = T.StructType([*large.schema.fields, T.StructField("_range", T.IntegerType())])
    placed = df.sparkSession.read.schema(schema).parquet(path)
    spread = _over_chunks(placed, keys, order, F.col("_range"), wanted, peers)
    whole = _over_keys(cold, keys, order, wanted, peers)
    return whole.unionByName(spread.select(*own_columns(whole)))


def _sequence(order: Sequence[str], side: str) -> list[Column]:
    return [F.col(quoted(c)).asc_nulls_first() if side == BEFORE else F.col(quoted(c)).desc_nulls_last() for c in order]


def _up_to(window: WindowSpec, peers: bool) -> WindowSpec:
    frame = window.rangeBetween if peers else window.rowsBetween
    return frame(Window.unboundedPreceding, Window.currentRow)


def _over_keys(
    base: DataFrame, keys: Sequence[str], order: Sequence[str], wanted: Mapping[str, str], peers: bool
) -> DataFrame:
    """Each key in one task; the windows of both sides share one shuffle."""
    found = base
    for name, side in wanted.items():
        window = Window.partitionBy(*quoted_all(keys)).orderBy(*_sequence(order, side))
        found = found.withColumn(name, F.last("_v", ignorenulls=True).over(_up_to(window, peers)))
    return found


def _over_chunks(
    base: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, wanted: Mapping[str, str], peers: bool
) -> DataFrame:
    """Each chunk of a key in one task, and one row per chunk to carry values from chunk to chunk."""
    # Structs of the key and of the chunk equal one another even where they hold a NULL, so
    # the windows and the join below can use one partitioning.
    marked = base.withColumns({"_k": F.struct(*quoted_all(keys)), "_c": F.struct(chunk.alias("chunk"))})
    place = F.struct(*quoted_all(order))
    held = F.when(F.col("_v").isNotNull(), place)
    edges = {BEFORE: F.max_by("_v", held), AFTER: F.min_by("_v", held)}
    ends = marked.groupBy("_k", "_c").agg(*[edges[side].alias(f"_end_{side}") for side in dict.fromkeys(wanted.values())])
    near, far = marked, []
    for i, (name, side) in enumerate(wanted.items()):
        within = Window.partitionBy("_k", "_c").orderBy(*_sequence(order, side))
        near = near.withColumn(f"_near_{i}", F.last("_v", ignorenulls=True).over(_up_to(within, peers)))
        over = Window.partitionBy("_k").orderBy(F.col("_c").asc() if side == BEFORE else F.col("_c").desc())
        over = over.rowsBetween(Window.unboundedPreceding, -1)
        far.append(F.last(f"_end_{side}", ignorenulls=True).over(over).alias(f"_far_{i}"))
    joined = near.join(ends.select("_k", "_c", *far), ["_k", "_c"], "left")
    return joined.select(
        *own_columns(base), *[F.coalesce(f"_near_{i}", f"_far_{i}").alias(name) for i, name in enumerate(wanted)]
    )


def _carry(
    df: DataFrame,
    column: str,
    keys: Sequence[str],
    order: str,
    ties: Sequence[str],
    chunk: Column | None,
    most: int | None,
    side: str,
) -> DataFrame:
    require_columns(df, [column, *keys, order, *ties])
    if not keys:
        raise ValueError("a fill in order needs a key")
    value = F.when(~is_missing(by_name(df, column), df.schema[column].dataType), by_name(df, column))
    found = _around(df, value, keys, [order, *ties], {"_found": side}, chunk, most)
    return found.withColumn(column, F.col("_found")).select(*own_columns(df))


def fill_forward(
    df: DataFrame,
    column: str,
    keys: Sequence[str],
    order: str,
    ties: Sequence[str] = (),
    chunk: Column | None = None,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Replace a missing value by the last one before it within the key.

    Keys with more than ``chunk_rows`` rows (5 million unless given) are dealt by ranges of about
    that many rows, filled inside each range, and the last value of each range is carried on. So a
    key that holds a third of the table is spread over many tasks, in time that grows as its rows, for any type of
    ``order``. ``chunk`` gives an expression for all keys instead, which must not decrease in
    ``order``. ``ties`` order rows of equal ``order``; rows that agree in both have no order.
    """
    return _carry(df, column, keys, order, ties, chunk, chunk_rows, BEFORE)


def fill_backward(
    df: DataFrame,
    column: str,
    keys: Sequence[str],
    order: str,
    ties: Sequence[str] = (),
    chunk: Column | None = None,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Replace a missing value by the first one after it within the key."""
    return _carry(df, column, keys, order, ties, chunk, chunk_rows, AFTER)


def fill_from_donors(
    df: DataFrame, column: str, match: Sequence[str], donors: DataFrame, order: str
) -> DataFrame:
    """Cold deck: take the value of the first donor (by ``order``, then value) that agrees on ``match``.

    One donor per match key is chosen by an aggregation that combines before the shuffle.
    Whether the donors are broadcast depends on their checked number; a shuffled join with
    a hot match key is split by the adaptive skew join.
    """
    require_columns(df, [column, *match])
    require_columns(donors, [column, *match, order])
    given = donors.where(~is_missing(by_name(donors, column), donors.schema[column].dataType))
    chosen, rows = settle(given.groupBy(*quoted_all(match)).agg(F.min(F.struct(F.col(quoted(order)).alias("o"), F.col(quoted(column)).alias("v")))["v"].alias("_donor")))
    joined = null_safe_join(df, chosen, match, "left", broadcast_right=rows is not None)
    return joined.withColumn(column, _filled(df, column, F.col("_donor"))).select(*own_columns(df))


def fill_from_similar(df: DataFrame, column: str, match: Sequence[str], order: str) -> DataFrame:
    """Hot deck: the donors are the complete rows of the same table."""
    return fill_from_donors(df, column, match, df, order)


def _as_number(df: DataFrame, name: str) -> Column:
    """A number or a time as a double (times in seconds); NaN becomes NULL."""
    dtype = df.schema[name].dataType
    value = by_name(df, name).cast("timestamp") if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)) else by_name(df, name)
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def fill_from_nearest_donor(
    df: DataFrame,
    column: str,
    match: Sequence[str],
    near: str,
    donors: DataFrame,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Cold deck by likeness: the value of the donor that agrees on ``match`` and is nearest in ``near``.

    ``near`` is a number or a time, in both tables. Of donors at one place the smallest value
    counts, and of two places equally far the smaller value. A NULL in ``match`` agrees with a NULL;
    a row without a place, or without a donor for its key, stays missing.

    Donors are first reduced to one per place, in the task and then by a shuffle. They and the
    rows to fill are put in one order, in which the nearest donor is the last one before a row or the first
    one after it: no pair of a row and a donor is ever built, and large keys are cut by ranges
    (see :func:`fill_forward`).
    """
    require_columns(df, [column, *match, near])
    require_columns(donors, [column, *match, near])
    if not match:
        raise ValueError("a deck imputation needs a match key")
    keys = [f"_m{i}" for i in range(len(match))]
    present = ~is_missing(by_name(donors, column), donors.schema[column].dataType)
    given = donors.where(present).select(*[by_name(donors, m).alias(k) for m, k in zip(match, keys)], _as_number(donors, near).alias("_at"), by_name(donors, column).alias("_value"))
    places = given.where(F.col("_at").isNotNull()).groupBy(*keys, "_at").agg(F.min("_value").alias("_value"))

    missing = is_missing(by_name(df, column), df.schema[column].dataType)
    place = _as_number(df, near)
    asks = missing & place.isNotNull()
    row = F.struct(*[by_name(df, c) for c in df.columns])
    asking = df.where(asks).select(*[by_name(df, m).alias(k) for m, k in zip(match, keys)], place.alias("_at"), row.alias("_row"))
    donor = F.struct(F.col("_at").alias("at"), F.col("_value").alias("value"))
    both = asking.withColumn("_donor", F.lit(None).cast(places.select(donor.alias("d")).schema["d"].dataType)).unionByName(
        places.select(*keys, "_at", donor.alias("_donor")), allowMissingColumns=True
    )
    found = _around(both, F.col("_donor"), keys, ["_at"], {"_below": BEFORE, "_above": AFTER}, most=chunk_rows, peers=True)
    below, above = F.col("_at") - F.col("_below.at"), F.col("_above.at") - F.col("_at")
    nearest = (
        F.when(F.col("_above").isNull() | (below < above), F.col("_below.value"))
        .when(F.col("_below").isNull() | (above < below), F.col("_above.value"))
        .otherwise(F.least("_below.value", "_above.value"))
    )
    dtype = df.schema[column].dataType
    filled = found.where(F.col("_row").isNotNull()).select(
        *[(F.coalesce(nearest.cast(dtype), F.col("_row")[c]) if c == column else F.col("_row")[c]).alias(c) for c in df.columns]
    )
    return filled.unionByName(df.where(~asks | asks.isNull()))


def fill_from_nearest(df: DataFrame, column: str, match: Sequence[str], near: str, chunk_rows: int | None = None) -> DataFrame:
    """Hot deck by likeness: the donors are the rows of the same table that have a value."""
    return fill_from_nearest_donor(df, column, match, near, df, chunk_rows)


def fill_by_model(df: DataFrame, column: str, features: Sequence[str], kind: str = "regression") -> DataFrame:
    """Fit a model on the complete rows and predict the missing values.

    ``kind`` is ``regression`` (a linear model; the column becomes double) or
    ``classification`` (a logistic model; classes of any type, their number bounded by what a
    driver can list). A row with a missing feature is not filled.
    """
    require_columns(df, [column, *features])
    if kind not in ("regression", "classification"):
        raise ValueError(f"unknown kind: {kind}")
    numbers = [f"_f{i}" for i in range(len(features))]
    known = F.when(~is_missing(by_name(df, column), df.schema[column].dataType), by_name(df, column))
    ready = df.withColumns({n: by_name(df, f).cast("double") for n, f in zip(numbers, features)})
    labels: list[str] = []
    if kind == "regression":
        ready = ready.withColumn("_label", known.cast("double"))
    else:
        ready = ready.withColumn("_class", known.cast("string"))
        indexer = StringIndexer(inputCol="_class", outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="skip")
        indexed = indexer.fit(ready.where(F.col("_class").isNotNull()))
        labels = list(indexed.labels)
        entries = [F.lit(x) for i, label in enumerate(labels) for x in (label, float(i))]
        ready = ready.withColumn("_label", F.try_element_at(F.create_map(*entries), F.col("_class")))
    assembler = VectorAssembler(inputCols=numbers, outputCol="_features", handleInvalid="skip")
    complete = assembler.transform(ready.where(F.col("_label").isNotNull()))
    estimator = LinearRegression if kind == "regression" else LogisticRegression
    model = estimator(featuresCol="_features", labelCol="_label", predictionCol="_prediction").fit(
        complete.select("_features", "_label")
    )
    # The linear forms are written as expressions, so rows with a missing feature stay.
    def linear(weights: Sequence[float], intercept: float) -> Column:
        form = F.lit(float(intercept))
        for weight, name in zip(weights, numbers):
            form = form + F.lit(float(weight)) * F.col(name)
        return form

    if kind == "regression":
        predicted = linear(model.coefficients, model.intercept)
        return ready.withColumn(column, F.coalesce("_label", predicted)).select(*own_columns(df))
    if model.numClasses <= 2:
        index = (linear(model.coefficients, model.intercept) > 0).cast("int")
    else:
        scores = F.array(*[linear(w, b) for w, b in zip(model.coefficientMatrix.toArray(), model.interceptVector)])
        index = (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
    usable = reduce(and_, [F.col(name).isNotNull() & ~F.isnan(name) for name in numbers])
    named = F.get(F.array(*[F.lit(label) for label in labels]), index)
    filled = F.coalesce("_class", F.when(usable, named))
    return ready.withColumn(column, filled.cast(df.schema[column].dataType)).select(*own_columns(df))
