"""Benchmark passages in documents: fingerprints of item-sized windows, then exact similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import blocks, mix, one_array, prepare, shingles, word_hashes, words_of

# Words of a shingle and the least weighted Jaccard similarity of a window and an item.
SHINGLE, SIMILARITY = 5, 0.8
# Fingerprints of 64 bits. At the least similarity a bit differs with probability 0.15, which
# makes 9.7 bits on average with a deviation of 2.9; the radius leaves 3.6 deviations.
RADIUS = 20
# Benchmark bytes that are broadcast at once; a larger benchmark takes several passes.
PART_BYTES = 16 << 20


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words as runs of letters and digits, in lower case."""
    return words_of(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}]+", " "), lower=False)


def fingerprints(windows: np.ndarray) -> np.ndarray:
    """SimHash of each row of shingle hashes; a shingle that occurs twice votes twice."""
    out = np.zeros(len(windows), np.uint64)
    if not windows.shape[1]:
        return out
    chunk = max(1, (4 << 20) // (64 * windows.shape[1]))
    for at in range(0, len(windows), chunk):
        part = np.ascontiguousarray(mix(windows[at : at + chunk]))
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), -1, 8), axis=2)
        votes = bits.sum(axis=1, dtype=np.int32) * 2 > windows.shape[1]
        out[at : at + chunk] = np.packbits(votes, axis=1).view(np.uint64).reshape(-1)
    return out


class Blocks:
    """Fingerprints by the values of ``RADIUS + 1`` blocks of bits.

    Two fingerprints that differ in at most ``RADIUS`` bits agree on one block at least, so
    that the blocks find all of them.
    """

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        edges = np.linspace(0, 64, RADIUS + 2).astype(int)
        self.blocks = [(np.uint64(a), np.uint64((1 << int(b - a)) - 1)) for a, b in zip(edges[:-1], edges[1:])]
        self.orders, self.values = [], []
        for shift, mask in self.blocks:
            value = (prints >> shift) & mask
            order = np.argsort(value, kind="stable")
            self.orders.append(order)
            self.values.append(value[order])

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of ``prints``, row of the index) within the radius."""
        found = []
        for (shift, mask), order, values in zip(self.blocks, self.orders, self.values):
            value = (prints >> shift) & mask
            low, high = np.searchsorted(values, value, "left"), np.searchsorted(values, value, "right")
            n = high - low
            rows = np.repeat(np.arange(len(prints)), n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            other = order[place]
            near = np.bitwise_count(prints[rows] ^ self.prints[other]) <= RADIUS
            found.append(rows[near] * len(self.prints) + other[near])
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pairs // max(1, len(self.prints)), pairs % max(1, len(self.prints))


class Index:
    """Items of a benchmark by their number of words."""

    def __init__(self, ids: list, texts: pa.Array):
        codes, offsets, words = plain_words(pc.fill_null(texts, ""))
        hashed = word_hashes(words)[codes]
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i in range(len(ids)):
            own = hashed[offsets[i] : offsets[i + 1]]
            if len(own):
                by_size.setdefault(len(own), []).append((i, shingles(own, min(SHINGLE, len(own)))))
        self.ids = ids
        self.sizes = []
        marks: dict[int, list[np.ndarray]] = {}
        for size, members in sorted(by_size.items()):
            prints = fingerprints(np.stack([s for _, s in members]))
            counted = [np.unique(s, return_counts=True) for _, s in members]
            self.sizes.append((size, [i for i, _ in members], Blocks(prints), counted, np.unique(np.concatenate([s for _, s in members]))))
            marks.setdefault(min(SHINGLE, size), []).append(self.sizes[-1][4])
        self.marks = {k: np.unique(np.concatenate(m)) for k, m in marks.items()}

    def hits(self, hashed: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, float, int, int]]:
        """Row, item, similarity, first word and words of the best window of each pair found.

        A window without a shingle of any item cannot be similar to one, so only windows
        around such shingles are fingerprinted. A text shorter than an item is one window.
        """
        row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        lasts = offsets[1:]
        marked = {}
        for k, marks in self.marks.items():
            all_shingles = shingles(hashed, k)
            if not len(all_shingles):
                continue
            at = np.searchsorted(marks, all_shingles)
            at[at == len(marks)] = 0
            place = np.flatnonzero(marks[at] == all_shingles)
            place = place[place + k <= lasts[row_of[place]]]
            marked[k] = (all_shingles, place)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for size, members, index, counted, own in self.sizes:
            k = min(SHINGLE, size)
            if k not in marked:
                continue
            all_shingles, place = marked[k]
            at = np.searchsorted(own, all_shingles[place])
            at[at == len(own)] = 0
            place = place[own[at] == all_shingles[place]]
            if not len(place):
                continue
            rows = row_of[place]
            room = np.minimum(size, lasts[rows] - offsets[rows])  # words of a window of that row
            low = np.maximum(place - room + k, offsets[rows])
            high = np.minimum(place, lasts[rows] - room)
            n = high - low + 1
            starts = np.unique(np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum()))
            rows = row_of[starts]
            room = np.minimum(size, lasts[rows] - offsets[rows])
            for width in np.unique(room).tolist():
                chosen = starts[room == width]
                count = width - k + 1
                windows = all_shingles[chosen[:, None] + np.arange(count)]
                for window, member in zip(*index.within(fingerprints(windows))):
                    values, times = counted[member]
                    keys, seen = np.unique(windows[window], return_counts=True)
                    at = np.searchsorted(values, keys)
                    at[at == len(values)] = 0
                    common = np.minimum(seen, times[at])[values[at] == keys].sum()
                    similarity = common / (count + times.sum() - common)
                    if similarity >= SIMILARITY:
                        start = int(chosen[window])
                        row = int(row_of[start])
                        pair = (row, members[member])
                        entry = (float(similarity), -(start - int(offsets[row])), width)
                        if pair not in best or entry > best[pair]:
                            best[pair] = entry
        return [(row, item, s, -start, width) for (row, item), (s, start, width) in sorted(best.items())]


def parts_of(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark in parts of about ``PART_BYTES`` bytes."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + F.count("*") * 16).first()[0]
    parts = -(-size // PART_BYTES) or 1
    if parts == 1:
        return [benchmark]
    return [benchmark.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part) for part in range(parts)]


def indexes(benchmark: DataFrame, item_column: str, text_column: str) -> Iterator:
    """A broadcast index of each part, which has a bounded size."""
    items = benchmark.select(benchmark[item_column].alias("id"), benchmark[text_column].alias("text"))
    items = items.where(items["text"].isNotNull()).dropDuplicates()
    for part in parts_of(items):
        table = part.orderBy("id", "text").toArrow()
        yield benchmark.sparkSession.sparkContext.broadcast(Index(table.column("id").to_pylist(), one_array(table.column("text"))))


def contaminations(
    documents: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """Every document and item with a similar window: the best similarity and where it is.

    Columns: both ids, ``similarity`` (weighted Jaccard of five-word shingles, at least 0.8),
    ``first_word`` and ``n_words`` of the window, the earliest of equally similar ones. Items of
    fewer words are one shingle. NULL or wordless texts match nothing; repeated rows and NULL
    ids of documents give rows of their own, repeated items are one. Other columns are not read.
    """
    prepare(documents.sparkSession)
    rows = documents.select(documents[id_column].alias("id"), documents[text_column].alias("text"))
    kind, item_kind = documents.schema[id_column].dataType, benchmark.schema[item_column].dataType
    schema = T.StructType([T.StructField(id_column, kind), T.StructField(item_column, item_kind)])
    schema.add("similarity", "double").add("first_word", "long").add("n_words", "long")
    result = None
    for shared in indexes(benchmark, item_column, item_text_column):

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for table in blocks(batches):
                codes, offsets, words = plain_words(one_array(table.column("text")))
                found = index.hits(word_hashes(words)[codes], offsets)
                ids = one_array(table.column("id")).take(pa.array([f[0] for f in found], pa.int64()))
                items = pa.array([index.ids[f[1]] for f in found], T_ARROW(item_kind))
                yield pa.RecordBatch.from_arrays(
                    [ids, items, pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.int64()), pa.array([f[4] for f in found], pa.int64())],
                    schema.names,
                )

        part = rows.mapInArrow(find, schema)
        result = part if result is None else result.unionAll(part)
    return result


def T_ARROW(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def decontaminate(documents: DataFrame, benchmark: DataFrame, text_column: str = "text") -> DataFrame:
    """The documents without a window similar to a benchmark item, all columns as they are.

    Rows are judged one by one, so repeated rows and NULL ids are no special case.
    """
    prepare(documents.sparkSession)
    result = documents
    for shared in indexes(benchmark, "item_id", "text"):
        rows = result.select(F.struct(*result.columns).alias("row"), result[text_column].alias("text"))

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for table in blocks(batches):
                codes, offsets, words = plain_words(one_array(table.column("text")))
                clean = np.ones(table.num_rows, bool)
                clean[[f[0] for f in shared.value.hits(word_hashes(words)[codes], offsets)]] = False
                yield pa.RecordBatch.from_arrays([one_array(table.column("row")).filter(pa.array(clean))], ["row"])

        result = rows.mapInArrow(keep, T.StructType([rows.schema["row"]])).select("row.*")
    return result
