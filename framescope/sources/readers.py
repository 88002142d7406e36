"""One way to name an input: a DataFrame, or a path whose suffix tells the format."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.guards import by_name
from ..functions.wordlists import NA_TOKENS

FORMATS = {"csv": "csv", "parquet": "parquet", "json": "json", "jsonl": "json", "orc": "orc"}
COMPRESSIONS = ("gz", "bz2", "zst", "xz")


# The column that keeps the text of a malformed row.
CORRUPT = "_corrupt_record"


def mark_missing(df: DataFrame, tokens: Sequence[str] = tuple(NA_TOKENS)) -> DataFrame:
    """Turn the texts that stand for a missing value into NULL, in every text column."""
    columns = []
    for field in df.schema.fields:
        value = by_name(df, field.name)
        if isinstance(field.dataType, T.StringType) and field.name != CORRUPT:
            value = F.when(~value.isin(*tokens), value)
        columns.append(value.alias(field.name))
    return df.select(*columns)


def split_malformed(df: DataFrame, corrupt: str = CORRUPT) -> tuple[DataFrame, DataFrame]:
    """The rows that could be read, without the column of malformed ones; and those, as ``record``."""
    value = by_name(df, corrupt)
    rows = df.where(value.isNull()).select(*[by_name(df, c) for c in df.columns if c != corrupt])
    return rows, df.where(value.isNotNull()).select(value.alias("record"))


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    infer: bool = False,
    tokens: Sequence[str] = tuple(NA_TOKENS),
    multi_line: bool = True,
    corrupt: str | None = None,
) -> DataFrame:
    """CSV with a header and quoted fields that may span lines.

    Such a file cannot be split, so large inputs should be ingested once (see ``ingest``), or
    read without ``multi_line`` where no field spans lines.
    Without a schema every column is text, unless ``infer`` asks for a scan that guesses.
    ``corrupt`` names a column that takes the text of rows with too few or too many fields, or
    with values that are not of the schema's types; it needs a schema, as only that says what is wrong.
    """
    reader = spark.read.options(
        header=True, multiLine=multi_line, quote='"', escape='"', mode="PERMISSIVE"
    )
    if corrupt is not None:
        if schema is None:
            raise ValueError("malformed rows can only be told by a schema")
        fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        schema = T.StructType([*fields.fields, T.StructField(corrupt, T.StringType())])
        # An unused field would not be parsed, so its faults would go unseen.
        reader = reader.options(columnNameOfCorruptRecord=corrupt, enforceSchema=True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", infer)
    return mark_missing(reader.csv(path), tokens)


def format_of(path: str) -> str:
    """Format by suffix; a folder without a suffix is Parquet."""
    parts = path.rstrip("/").rsplit("/", 1)[-1].lower().split(".")
    if len(parts) > 1 and parts[-1] in COMPRESSIONS:
        parts = parts[:-1]
    if len(parts) == 1:
        return "parquet"
    if parts[-1] not in FORMATS:
        raise ValueError(f"unknown file suffix: {path}")
    return FORMATS[parts[-1]]


def as_frame(
    spark: SparkSession,
    source: str | DataFrame,
    schema: T.StructType | str | None = None,
    infer: bool = False,
    multi_line: bool = True,
    corrupt: str | None = None,
) -> DataFrame:
    """A DataFrame as it is, or the table at a path; the last three are for CSV (``read_csv``)."""
    if isinstance(source, DataFrame):
        return source
    kind = format_of(source)
    if kind == "csv":
        return read_csv(spark, source, schema, infer, multi_line=multi_line, corrupt=corrupt)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.format(kind).load(source)


def spread(df: DataFrame, to_cores: bool = False) -> DataFrame:
    """Rows dealt to ``framescope.spread.partitions`` tasks, at any size, where that is set.

    Else, only if ``to_cores`` asks for it, rows of a scan with fewer splits than the session has cores are dealt
    to all cores. For a caller whose rows need much work (text): it shuffles whole rows, but only of
    inputs of a few splits; a table with a split for every core stays as it is.
    """
    partitions = df.sparkSession.conf.get("framescope.spread.partitions", None)
    if partitions:
        return df.repartition(int(partitions))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if to_cores and df.rdd.getNumPartitions() < cores else df
