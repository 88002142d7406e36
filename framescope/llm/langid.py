"""Language by prediction with partial matching over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import blocks, byte_rows, one_array, prepare, sums

# Bytes before the one to be coded that a context holds at most.
ORDER = 3
# The sample a model is fitted on: texts per language, bytes per text, texts in all.
PER_LANGUAGE, TEXT_BYTES, SAMPLE_TEXTS = 400, 16_384, 4_000
UNKNOWN = "und"


@dataclass
class Model:
    """Frozen context trees of all languages in one trie, with code lengths in bits.

    Node 0 of a level stands for "not seen". ``child[k][node * width + symbol]`` leads from a
    window of ``k`` bytes to the one of ``k + 1``; ``code[k]`` has the length of coding the
    last byte of a window after the others in each language, escapes included, and
    ``escape[k]`` the length of the escape from a context of ``k`` bytes.
    """

    languages: list[str]
    symbol: np.ndarray
    width: int
    child: list[np.ndarray]
    code: list[np.ndarray]
    escape: list[np.ndarray]

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Exact code length of each row of bytes in each language."""
        total = np.zeros((len(offsets) - 1, len(self.languages)))
        piece = 1 << 20
        for first in range(0, len(data), piece):
            low, last = max(0, first - ORDER), min(len(data), first + piece)
            symbols = self.symbol[data[low:last]].astype(np.int64)
            # Contexts end where a row begins: bytes of that row before each byte, at most ORDER.
            place = np.arange(low, last)
            row = np.searchsorted(offsets, place, side="right") - 1
            depth = place - offsets[row]
            nodes = [np.zeros(len(symbols), np.int64)]
            for k in range(ORDER + 1):
                before = np.zeros(len(symbols), np.int64)
                if k:
                    before[1:] = nodes[k][:-1]
                    reached = self.child[k][before * self.width + symbols]
                    reached[depth < k] = 0
                else:
                    reached = self.child[0][symbols]
                nodes.append(reached.astype(np.int64))
            keep = slice(first - low, None)
            for language in range(len(self.languages)):
                bits = self.code[ORDER + 1][nodes[ORDER + 1], language]
                open_ = np.flatnonzero(nodes[ORDER + 1] == 0)
                for k in range(ORDER, -1, -1):
                    if not len(open_):
                        break
                    if k:
                        context = np.where((open_ > 0) & (depth[open_] >= k), nodes[k][open_ - 1], 0)
                        bits[open_] += self.escape[k][context, language]
                        seen = nodes[k][open_]
                        bits[open_] += self.code[k][seen, language]
                        open_ = open_[seen == 0]
                    else:
                        bits[open_] += self.escape[0][0, language] + 8.0
                inside = bits[keep]
                begin, end = np.clip(offsets[:-1] - first, 0, len(inside)), np.clip(offsets[1:] - first, 0, len(inside))
                running = np.concatenate([[0.0], np.cumsum(inside)])
                total[:, language] += running[end] - running[begin]
        return total


def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count each text's windows of 1 to ORDER + 1 bytes, as numbers, per language."""
    for table in blocks(batches):
        languages = table.column("lang").to_pylist()
        data, offsets = byte_rows(one_array(table.column("text")))
        for i, language in enumerate(languages):
            text = data[offsets[i] : offsets[i + 1]].astype(np.int64)
            window = np.zeros(len(text) + 1, np.int64)
            for size in range(1, ORDER + 2):
                if len(text) < size:
                    break
                window = window[: len(text) - size + 1] << 8 | text[size - 1 :]
                keys, n = np.unique(window, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language] * len(keys), pa.string()), pa.array([size] * len(keys), pa.int32()), pa.array(keys), pa.array(n.astype(np.int64))],
                    ["lang", "size", "window", "n"],
                )


def fit(
    labelled: DataFrame,
    per_language: int = PER_LANGUAGE,
    text_bytes: int = TEXT_BYTES,
    sample_texts: int = SAMPLE_TEXTS,
) -> Model:
    """Fit on a bounded sample of the rows ``doc_id, text, lang``.

    The sample has at most ``per_language`` texts of each language and ``sample_texts`` in
    all, picked by a hash: whole texts of at most ``text_bytes`` bytes, and where a language has
    too few of them, the beginnings of longer ones. Its windows are
    counted by Spark; their number, and so the model, is bounded by the sample's bytes.
    """
    usable = labelled.where(labelled["lang"].isNotNull() & labelled["text"].rlike(r"\p{L}"))
    long = F.octet_length("text") > text_bytes
    # A character has at most four bytes.
    usable = usable.select("doc_id", "lang", long.alias("long"), F.when(long, F.substring("text", 1, text_bytes // 4)).otherwise(F.col("text")).alias("text"))
    order = Window.partitionBy("lang").orderBy("long", F.xxhash64("doc_id"), F.xxhash64("text"))
    sample = usable.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language)
    sample = sample.orderBy("place", "lang").limit(sample_texts).select("lang", "text")
    counted = sample.mapInArrow(windows_of, "lang string, size int, window long, n long")
    counted = counted.groupBy("lang", "size", "window").agg(F.sum("n").alias("n"))
    return trees(counted.toArrow())


def trees(counted: pa.Table) -> Model:
    """The model of counted windows."""
    names = np.array(counted.column("lang").to_pylist(), dtype=object)
    languages = sorted(set(names.tolist()))
    size, window, n = (counted.column(c).to_numpy() for c in ("size", "window", "n"))
    owner = np.searchsorted(np.array(languages, dtype=object), names) if len(names) else np.zeros(0, np.int64)
    used = np.unique(window[size == 1])
    symbol = np.zeros(256, np.int32)
    symbol[used] = np.arange(1, len(used) + 1)
    width = len(used) + 1
    child, code, escape = [], [np.zeros((1, len(languages)))], []
    levels = [np.zeros(1, np.int64)]
    for k in range(ORDER + 1):
        chosen = size == k + 1
        keys, at = np.unique(window[chosen], return_inverse=True)
        levels.append(keys)
        count = np.zeros((len(keys), len(languages)))
        count[at, owner[chosen]] = n[chosen]
        # A level-0 context is node 0; deeper ones are numbered from 1.
        context = np.searchsorted(levels[k], keys >> 8) + 1 if k else np.zeros(len(keys), np.int64)
        nodes = len(levels[k]) + 1 if k else 1
        total, kinds = np.zeros((nodes, len(languages))), np.zeros((nodes, len(languages)))
        np.add.at(total, context, count)
        np.add.at(kinds, context, count > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escaped = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
            direct = np.log2((total + kinds)[context] / count)
        shorter = np.full((len(keys), len(languages)), 8.0)
        if k:
            # The same window without its first byte: its code is already known, or escapes again.
            tail = keys & ((1 << 8 * k) - 1)
            shorter = code[k][np.searchsorted(levels[k], tail) + 1]
        lengths = np.where(count > 0, direct, escaped[context] + shorter)
        code.append(np.vstack([np.zeros((1, len(languages))), lengths]))
        escape.append(escaped)
        table = np.zeros(nodes * width, np.int32)
        table[context * width + symbol[keys & 255]] = np.arange(1, len(keys) + 1)
        child.append(table)
    return Model(languages, symbol, width, child, [c.astype(np.float32) for c in code], [e.astype(np.float32) for e in escape])


def predict(documents: DataFrame, model: Model, keep: list[Column | str] | None = None) -> DataFrame:
    """``lang_pred`` and ``score`` for every row of ``documents`` (column ``text``).

    The language is that with the shortest code of the whole text, ties by name; the score is
    its posterior probability among the languages. A text that is NULL or has no letter, or
    any text where no language was learned, is ``und`` with score 0. ``keep`` names the
    columns of the result beside these two, all of them by default; their values are not
    looked at, so NULLs, repeated ids and clashing names (except ``lang_pred``, ``score``,
    which are replaced) pass through.
    """
    spark = prepare(documents.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    lettered = F.coalesce(documents["text"].rlike(r"\p{L}"), F.lit(False))
    kept = documents.select(*(keep if keep is not None else [c for c in documents.columns if c not in ("lang_pred", "score")]))
    names = kept.columns

    rows = documents.select(
        F.struct(*(keep if keep is not None else names)).alias("kept"), documents["text"].alias("text"), lettered.alias("lettered")
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained = shared.value
        for table in blocks(batches):
            lettered = table.column("lettered").to_numpy()
            if not trained.languages:
                best, scores = [UNKNOWN] * len(lettered), np.zeros(len(lettered))
            else:
                bits = trained.bits(*byte_rows(one_array(table.column("text"))))
                least = bits.argmin(axis=1)
                weight = np.exp2(bits.min(axis=1, keepdims=True) - bits)
                scores = np.where(lettered, 1.0 / weight.sum(axis=1), 0.0)
                best = [trained.languages[i] if ok else UNKNOWN for i, ok in zip(least, lettered)]
            yield pa.RecordBatch.from_arrays(
                [one_array(table.column("kept")), pa.array(best, pa.string()), pa.array(scores)], ["kept", "lang_pred", "score"]
            )

    schema = T.StructType([rows.schema["kept"]]).add("lang_pred", "string").add("score", "double")
    scored = rows.mapInArrow(score, schema)
    return scored.select("kept.*", "lang_pred", "score")
