"""Words of Arrow text columns, and blocks of documents that fit a task's memory."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from ..sources.scratch import new_path

# Rows a task hands to Python at once; a batch is cut further by bytes (``blocks``).
ARROW_ROWS = "1000"
# Text bytes worked on at once.
BLOCK_BYTES = 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the operators here: the library's, and small Arrow batches.

    The tasks' Python imports this package, so it is handed to Spark as a Python file once.
    """
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    context = spark.sparkContext
    if getattr(context, "_framescope_shipped", None) is None:
        package = Path(__file__).resolve().parent.parent
        folder = tempfile.mkdtemp(prefix="framescope-py-")
        with zipfile.ZipFile(f"{folder}/framescope.zip", "w", zipfile.ZIP_DEFLATED) as archive:
            for file in sorted(package.rglob("*.py")):
                archive.write(file, file.relative_to(package.parent))
        context.addPyFile(f"{folder}/framescope.zip")
        context._framescope_shipped = folder
    return spark


def stored(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written to the shared folder and read again, so that it is computed once."""
    path = new_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def stored_for_now(frame: DataFrame, name: str, before: str | None = None) -> tuple[DataFrame, str]:
    """As :func:`stored`, with the path; the table at ``before``, which nothing reads any more, is deleted."""
    spark = frame.sparkSession
    path = new_path(spark, name)
    frame.write.parquet(path)
    if before is not None:
        old = spark._jvm.org.apache.hadoop.fs.Path(before)
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return spark.read.schema(frame.schema).parquet(path), path


def bucket_of(part: Column, modulus: int) -> Column:
    """The remainder of the CRC-32 of an id written as text."""
    return F.crc32(part.cast("string").cast("binary")) % modulus


def blocks(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES, fill: bool = False
) -> Iterator[pa.Table]:
    """Whole rows in their order, cut where the bytes of ``column`` reach ``limit``.

    With ``fill`` batches are also joined up to the limit. A row longer than the limit is a
    block of its own. NULL texts become empty.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = 0
        for row, n in enumerate(sizes.tolist()):
            if size and size + n > limit:
                if row > start:
                    held.append(batch.slice(start, row - start))
                yield filled(held, column)
                held, size, start = [], 0, row
            size += n
        if len(sizes) > start:
            held.append(batch.slice(start))
        if not fill and held:
            yield filled(held, column)
            held, size = [], 0
    if held:
        yield filled(held, column)


def filled(held: list[pa.RecordBatch], column: str) -> pa.Table:
    table = pa.Table.from_batches(held).combine_chunks()
    at = table.schema.get_field_index(column)
    return table.set_column(at, column, pc.fill_null(table.column(column), ""))


def one_array(column) -> pa.Array:
    """A table's column as one array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    return column


def words_of(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text, with A-Z lower-cased if asked.

    Returns the words as codes, the first code of each text (one entry more than texts),
    and the distinct words.
    """
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    offsets -= offsets[0]
    empty = pc.equal(pc.binary_length(flat), 0)
    if pc.any(empty).as_py():  # white space at either end of a text
        keep = ~empty.to_numpy(zero_copy_only=False)
        before = np.concatenate([[0], np.cumsum(keep)])
        offsets, flat = before[offsets], flat.filter(pa.array(keep))
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), offsets, coded.dictionary


def byte_rows(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary array, end to end, and the start of each (one more)."""
    if pa.types.is_string(array.type) or pa.types.is_binary(array.type):
        kind = np.int32
    else:
        kind = np.int64
    raw = array.buffers()
    offsets = np.frombuffer(raw[1], dtype=kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each row; rows may be empty."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices ``values[start : start + length]``, end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers (finaliser with two multiplications)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


def shingles(hashed: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; fewer words give none."""
    n = len(hashed) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = mix(total + hashed[i : i + n] + np.uint64(i + 1)) if i else mix(hashed[:n])
    return total


def packed_numbers(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, byte plane by byte plane, compressed."""
    parts = []
    for array in arrays:
        array = np.ascontiguousarray(array, np.uint64)
        raw = array.view(np.uint8).reshape(-1, 8).T.tobytes()
        small = pa.compress(raw, codec="zstd", asbytes=True)
        parts.append(np.array([len(array), len(small)], np.int64).tobytes() + small)
    return b"".join(parts)


def unpacked_numbers(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n, size = np.frombuffer(data, np.int64, 2, at).tolist()
        raw = pa.decompress(data[at + 16 : at + 16 + size], decompressed_size=8 * n, codec="zstd", asbytes=True)
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(np.uint64).reshape(-1))
        at += 16 + size
    return out
