"""Drawing documents that look like a target, by importance weights of hashed n-grams."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import words_of_bytes
from .text import blocks, one_array, prepare, stored

# Buckets of the hashed features; counts of all buckets are held by the driver and each task.
BUCKETS = 10_000
# Words that a task remembers with their checksum.
KNOWN = 1 << 18


class Seeds(dict):
    """The CRC-32 of each word, computed once."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = crc32(word)
        return value


def features(data: bytes, n: int, seeds: Seeds) -> Iterator[list[int]]:
    """CRC-32 of every run of 1 to ``n`` words joined by a blank, slice by slice.

    The checksum of a run is the seed of the run that is one word longer, so no run is built.
    """
    if len(seeds) > KNOWN:
        seeds.clear()
    tails: list[list[int]] = [[] for _ in range(n)]  # checksums of the last runs, by length
    for words in words_of_bytes(data):
        longer = [b" " + word for word in words] if n > 1 else []
        level = [seeds[word] for word in words]
        yield level
        for size in range(1, n):
            # The run that a word extends ends just before it, perhaps in the slice before.
            before = tails[size - 1] + level
            tails[size - 1] = before[-1:]
            skip = len(longer) - (len(before) - 1)
            level = [crc32(word, seed) for word, seed in zip(longer[max(skip, 0) :], before)]
            yield level


def bucket_counts(texts: DataFrame, n: int = 1, buckets: int = BUCKETS) -> list[int]:
    """How often the features of all texts fall into each bucket.

    A task sends one row per bucket it has met, whatever it has read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seeds = np.zeros(buckets, np.int64), Seeds()
        for table in blocks(batches, fill=True):
            counted: Counter[int] = Counter()
            for data in one_array(table.column("text")).cast(pa.binary()):
                for level in features(data.as_py(), n, seeds):
                    counted.update(level)
                if len(counted) > KNOWN:
                    add(total, counted)
            add(total, counted)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    def add(total: np.ndarray, counted: Counter[int]) -> None:
        hashed = np.fromiter(counted.keys(), np.int64, len(counted)) % buckets
        np.add.at(total, hashed, np.fromiter(counted.values(), np.int64, len(counted)))
        counted.clear()

    met = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = [0] * buckets
    for row in met.collect():  # at most `buckets` rows
        counts[row["bucket"]] = row["n"]
    return counts


def gains_of(source: list[int], target: list[int]) -> list[int]:
    """Thousandths of the log ratio of the smoothed shares of each bucket."""
    s_all, t_all, size = float(sum(source)), float(sum(target)), float(len(source))
    return [
        math.floor(1000 * math.log(((t + 1.0) * (s_all + size)) / ((s + 1.0) * (t_all + size))))
        for s, t in zip(source, target)
    ]


def noise(seed: int, name: str) -> int:
    """Thousandths of a Gumbel deviate fixed by the seed and a document's name."""
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(
    documents: DataFrame, gains: list[int], n: int, seed: int, id_column: str, text_column: str
) -> DataFrame:
    """``id, n_words, n_features, weight, score`` of every row."""
    kind = documents.schema[id_column].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(np.array(gains, np.int64))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, seeds = shared.value, Seeds()
        for table in blocks(batches):
            n_words, n_features, weight, score = [], [], [], []
            names = one_array(table.column("name")).to_pylist()
            for name, data in zip(names, one_array(table.column("text")).cast(pa.binary())):
                words = count = total = 0
                for i, level in enumerate(features(data.as_py(), n, seeds)):
                    if level:
                        total += int(gain[np.array(level, np.int64) % len(gain)].sum())
                    count += len(level)
                    words += len(level) if i % n == 0 else 0
                n_words.append(words)
                n_features.append(count)
                weight.append(total // count if count else 0)
                score.append(weight[-1] + noise(seed, name or ""))
            yield pa.RecordBatch.from_arrays(
                [one_array(table.column("id")), *[pa.array(x, pa.int64()) for x in (n_words, n_features, weight, score)]],
                ["id", "n_words", "n_features", "weight", "score"],
            )

    rows = documents.select(
        documents[id_column].alias("id"),
        documents[id_column].cast("string").alias("name"),
        documents[text_column].alias("text"),
    )
    return rows.mapInArrow(weigh, f"id {kind}, n_words long, n_features long, weight long, score long")


def ranked(scored: DataFrame, least_words: int, percent: int) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, ... for the drawn rows, best score first, else NULL.

    Scores are whole numbers of a bounded range, so a histogram of them fits the driver and
    gives the score of the last drawn row; only rows that reach it are sorted, by ranges.
    """
    eligible = F.col("n_words") >= least_words
    steps = scored.where(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()
    wanted = percent * sum(step["n"] for step in steps) // 100
    cut, held = None, 0
    for step in sorted(steps, key=lambda step: -step["score"]):
        if held >= wanted:
            break
        cut, held = step["score"], held + step["n"]
    no_rank = F.lit(None).cast("long")
    if cut is None:
        return scored.withColumn("rank", no_rank)
    near = eligible & (F.col("score") >= cut)
    # The hash cuts rows of equal score and id, which have no order among themselves.
    order = [F.desc("score"), F.asc_nulls_last("id"), F.xxhash64(F.monotonically_increasing_id())]
    parts = scored.where(near).withColumn("_salt", order[2])
    order[2] = F.col("_salt")
    sorted_rows = parts.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    before, first = [], 0
    for row in sizes:  # one row per partition of the sort
        before.append((row["part"], first))
        first += row["n"]
    offsets = F.broadcast(scored.sparkSession.createDataFrame(before, "part long, before long"))
    at = placed.withColumn("part", part).join(offsets, "part").withColumn("rank", place + F.col("before") + 1)
    drawn = at.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = scored.where(~near).withColumn("rank", no_rank)
    return drawn.select(*rest.columns).unionAll(rest)


def resample(
    documents: DataFrame,
    target: DataFrame,
    n: int = 1,
    buckets: int = BUCKETS,
    seed: int = 2024,
    least_words: int = 20,
    percent: int = 10,
    id_column: str = "doc_id",
    text_column: str = "text",
    target_column: str = "text",
) -> DataFrame:
    """Importance weights of all documents for a target distribution, and a draw by them.

    Features are the runs of 1 to ``n`` words, counted in hashed buckets over all documents
    and over all target texts. A document's weight is the floored mean of the buckets' log
    ratios over its features; its score adds noise fixed by ``seed`` and its id, so that the
    highest scores are a draw without replacement. ``percent`` of the documents with
    ``least_words`` words are drawn. Columns: the id, ``n_features``, ``weight``, ``score``,
    ``rank`` (NULL if not drawn), ``n_words``.

    NULL and empty texts have no features and weight 0. A NULL id takes the noise of an empty
    name and loses ties. Every row gives a row: repeated rows tie, and their ranks are dealt
    among them. Empty tables give no rows; an empty target leaves all shares equal. Other
    columns are not read.
    """
    prepare(documents.sparkSession)
    source = bucket_counts(documents.select(documents[text_column].alias("text")), n, buckets)
    wanted = bucket_counts(target.select(target[target_column].alias("text")), n, buckets)
    scored = weights(documents, gains_of(source, wanted), n, seed, id_column, text_column)
    found = ranked(stored(scored, "weighed"), least_words, percent)
    return found.select(F.col("id").alias(id_column), "n_features", "weight", "score", "rank", "n_words")
