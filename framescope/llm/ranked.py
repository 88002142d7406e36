"""Ranked lexical search that scores each distinct bag of words once."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import words_of_bytes
from .decontam import T_ARROW, parts_of
from .text import blocks, one_array, prepare, ragged, stored

# Share of the length in the normalisation, in percent, and saturation (20 is a k1 of 2).
LENGTH_PERCENT = 50
SATURATION = 20
# Cells of the score table of a block of bags, and postings added up at once.
CELLS = 1 << 20
ADDED = 1 << 22
# Keys of winning bags that are broadcast; more are joined by a shuffle.
MAX_KEYS = 200_000


class Items:
    """The terms of all items and, for each term, the items that hold it.

    Texts of one item id are one item. ``ids`` are the items in the order of their numbers.
    """

    def __init__(self, ids: list, texts: list):
        self.ids = list(dict.fromkeys(ids))
        number = {item: i for i, item in enumerate(self.ids)}
        held: dict[bytes, set[int]] = {}
        for item, text in zip(ids, texts):
            for words in words_of_bytes((text or "").encode()):
                for word in words:
                    held.setdefault(word, set()).add(number[item])
        terms = sorted(held)
        self.terms = {term: i for i, term in enumerate(terms)}
        lengths = np.array([len(held[t]) for t in terms], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        self.items = np.array([i for t in terms for i in sorted(held[t])], np.int64)
        self.weights = np.zeros(len(terms), np.int64)

    def bag(self, data: bytes) -> tuple[int, bytes]:
        """Terms of a text with repeats, and its known terms with their counts by number."""
        n, counted = 0, Counter()
        for words in words_of_bytes(data):
            n += len(words)
            counted.update(words)
            if len(counted) > 1 << 20:
                counted = Counter({w: c for w, c in counted.items() if w in self.terms})
        known = sorted((self.terms[w], c) for w, c in counted.items() if w in self.terms)
        return n, np.array(known, np.uint32).tobytes()


def bags_of(documents: DataFrame, shared) -> DataFrame:
    """``id, n, bag, h``: the length and the bag over the items' terms of each row, with its hash."""

    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for table in blocks(batches):
            found = [items.bag(data.as_py()) for data in one_array(table.column("text")).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [one_array(table.column("id")), pa.array([n for n, _ in found], pa.int64()), pa.array([b for _, b in found], pa.binary())],
                ["id", "n", "bag"],
            )

    schema = T.StructType([documents.schema["id"]]).add("n", "long").add("bag", "binary")
    return documents.mapInArrow(restrict, schema).withColumn("h", F.xxhash64("bag"))


def totals(bags: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents of each known term.

    A task sends one row per term it has met.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(n_terms + 2, np.int64)
        for batch in batches:
            n = batch.column("n").to_numpy()
            found[-2] += int((n > 0).sum())
            found[-1] += int(n.sum())
            terms = np.frombuffer(b"".join(batch.column("bag").to_pylist()), np.uint32)[::2]
            found[:n_terms] += np.bincount(terms, minlength=n_terms)
        met = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(found[met])], ["term", "n"])

    counts = bags.select("n", "bag").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = np.zeros(n_terms + 2, np.int64)
    for row in counts.collect():  # bounded by the terms of a part of the items
        found[row["term"]] = row["n"]
    return int(found[-2]), int(found[-1]), found[:n_terms]


class Best:
    """The best bags of each item: highest score, then smallest first id (NULL last)."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.floor = np.zeros(n_items, np.int64)  # a score below cannot be among the best
        self.kept: list[list[tuple]] = [[] for _ in range(n_items)]

    def add(self, scores: np.ndarray, firsts: list, keys: list) -> None:
        """``scores`` has a row per bag and a column per item."""
        if len(scores) > self.k:
            edge = np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k]
            floor = np.maximum(self.floor, edge)
        else:
            floor = self.floor
        rows, items = np.nonzero((scores > 0) & (scores >= floor))
        order = np.argsort(items, kind="stable")
        rows, items = rows[order], items[order]
        bounds = np.flatnonzero(np.diff(items, prepend=-1, append=-1))
        for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            item = int(items[start])
            held = self.kept[item]
            for row in rows[start:end].tolist():
                first = firsts[row]
                held.append((-int(scores[row, item]), first is None, 0 if first is None else first, keys[row]))
            held.sort(key=lambda x: x[:3])
            del held[self.k :]
            if len(held) == self.k:
                self.floor[item] = -held[-1][0]


def best_bags(classes: DataFrame, shared, k: int, item_field: T.StructField) -> DataFrame:
    """The ``k`` best bags of each item in each task: ``item, score, first, h, m, bag``.

    A bag that ``k`` others of its task precede, by score and smallest id, has no document
    among the ``k`` best, so no more need to be sent on.
    """
    first_type, item_type = T_ARROW(classes.schema["first"].dataType), T_ARROW(item_field.dataType)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        width = max(1, len(items.ids))
        best = Best(len(items.ids), k)
        for batch in batches:
            bags = batch.column("bag").to_pylist()
            m = batch.column("m").to_numpy()
            firsts, hashes = batch.column("first").to_pylist(), batch.column("h").to_pylist()
            lengths = np.array([len(b) // 8 for b in bags], np.int64)
            pairs = np.frombuffer(b"".join(bags), np.uint32).reshape(-1, 2).astype(np.int64)
            ends = np.cumsum(lengths)
            spread = items.starts[pairs[:, 0] + 1] - items.starts[pairs[:, 0]]
            reach = np.concatenate([[0], np.cumsum(spread)])[ends]  # postings up to the end of each bag
            start = 0
            while start < len(bags):
                done = int(reach[start - 1]) if start else 0
                end = int(np.searchsorted(reach, done + ADDED, side="right"))
                end = min(max(end, start + 1), start + max(1, CELLS // width), len(bags))
                low = int(ends[start - 1]) if start else 0
                term, tf = pairs[low : ends[end - 1]].T
                row = np.repeat(np.arange(end - start), lengths[start:end])
                value = items.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + SATURATION * m[start:end][row]))
                times = spread[low : ends[end - 1]]
                cells = np.repeat(row * width, times) + ragged(items.items, items.starts[term], times)
                scores = np.zeros((end - start) * width, np.int64)
                np.add.at(scores, cells, np.repeat(value, times))
                keys = list(zip(hashes[start:end], m[start:end].tolist(), bags[start:end]))
                best.add(scores.reshape(-1, width), firsts[start:end], keys)
                start = end
        for item, held in enumerate(best.kept):
            if held:
                columns = [
                    pa.array([items.ids[item]] * len(held), item_type),
                    pa.array([-s for s, *_ in held], pa.int64()),
                    pa.array([None if missing else first for _, missing, first, _ in held], first_type),
                    *[pa.array([key[i] for *_, key in held], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))],
                ]
                yield pa.RecordBatch.from_arrays(columns, ["item", "score", "first", "h", "m", "bag"])

    schema = T.StructType([T.StructField("item", item_field.dataType)]).add("score", "long")
    schema.add("first", classes.schema["first"].dataType).add("h", "long").add("m", "long").add("bag", "binary")
    return classes.select("h", "m", "bag", "first").mapInArrow(score, schema)


def search(
    documents: DataFrame,
    items: DataFrame,
    k: int = 50,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """The ``k`` best documents of each item: ``item_column, rank, id_column, score``.

    Documents are restricted to the terms of the items. Those with an equal bag and an equal
    length factor ``m`` have equal scores, so each such class (grouped by hash, ``m`` and the
    bag itself) is scored once; the members of the winning classes are listed by ascending
    id. All counts are over all documents, all sums are whole numbers, and the ranking is
    exact: a class beyond the best ``k`` classes of an item, by score and smallest id, has no
    document among the best ``k``. Large item tables are worked on in parts.

    NULL or empty texts have no terms and are never found, nor is a score of 0. Equal scores
    are ordered by id, NULL ids last; repeated rows are ranked one by one. Texts of equal
    item ids (NULL too) are one item; items without a term give no row. Empty tables give no
    rows. Other columns are not read.
    """
    prepare(documents.sparkSession)
    rows = documents.select(documents[id_column].alias("id"), documents[text_column].alias("text"))
    wanted = items.select(items[item_column].alias("id"), items[item_text_column].alias("text"))
    wanted = wanted.where(wanted["text"].isNotNull()).dropDuplicates()
    result = None
    for part in parts_of(wanted):
        found = part_of_search(rows, part, k)
        result = found if result is None else result.unionAll(found)
    return result.select(
        F.col("item").alias(item_column), "rank", F.col("id").alias(id_column), "score"
    )


def part_of_search(rows: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    spark = rows.sparkSession
    listed = wanted.orderBy("id", "text").toArrow()  # a part has a bounded size
    items = Items(listed.column("id").to_pylist(), listed.column("text").to_pylist())
    bags = stored(bags_of(rows, spark.sparkContext.broadcast(items)), "bags")
    n_docs, length, holding = totals(bags, len(items.terms))
    items.weights = np.array([math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * d + 1))) for d in holding.tolist()], np.int64)
    shared = spark.sparkContext.broadcast(items)

    m = F.lit(100 - LENGTH_PERCENT) + F.expr(f"({LENGTH_PERCENT} * n * {n_docs}L) div {max(1, length)}L")
    known = bags.where(F.octet_length("bag") > 0).select("id", "h", m.cast("long").alias("m"), "bag")
    classes = known.groupBy("h", "m", "bag").agg(F.min("id").alias("first"))
    sent = best_bags(classes, shared, k, wanted.schema["id"])
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("first"), "h", "m", "bag")
    best = stored(sent.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r", "first"), "best_bags")

    # Members by hash and factor first, on a checked number of keys; the bag is compared after.
    keys = best.select("h", "m").distinct()
    few = len(keys.limit(MAX_KEYS + 1).collect()) <= MAX_KEYS if k * len(items.ids) > MAX_KEYS else True
    near = known.join(F.broadcast(keys) if few else keys, ["h", "m"], "left_semi")
    place = Window.partitionBy("h", "m", "bag").orderBy(F.asc_nulls_last("id"))
    members = near.withColumn("r", F.row_number().over(place)).where(F.col("r") <= k).drop("r")
    last = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    expanded = best.join(members, ["h", "m", "bag"]).withColumn("rank", F.row_number().over(last))
    return expanded.where(F.col("rank") <= k).select("item", "rank", "id", "score")
