"""Token sequences of a fixed length, filled by hierarchical best-fit packing."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import blocks, one_array, prepare, ragged, stored, words_of

CAPACITY = 4096
END_ID = 1
# Partitions whose bins one merge task takes.
FAN_IN = 8
# Share of a sequence from which a bin counts as nearly full and is not carried on, by round.
NEARLY_FULL = (0.995, 0.98, 0.95)
# Bins a task carries on at most; fuller ones beyond are final as they are.
CARRIED = 4096
# Words whose ids a task remembers.
REMEMBERED = 600_000
# Text bytes that are turned into ids at once.
TEXT_BYTES = 4 << 20
# Items that one task of round 0 packs, about.
RUN_ITEMS = 100_000
# A letter before ASCII marks is always a token border, whatever stands before the letter.
TAIL = re.compile(r"(?s)(.*[a-zA-Zß-öø-ÿ])([!-&(-/:-@\[-`{-~]+)")


class WordIds:
    """Token ids word by word: the tokenizer drops white space and never joins words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}

    def ids(self, words: list[str]) -> list[bytes]:
        """The ids of each word as unsigned 32-bit numbers, end to end."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        out = [known.get(word) for word in words]
        new = {}
        for i, ids in enumerate(out):
            if ids is None:
                word = words[i]
                # A special token in the text is one only as a whole.
                found = None if "<|" in word else TAIL.fullmatch(word)
                new[i] = found.groups() if found else (word,)
        missing = list({p for split in new.values() for p in split if p not in known})
        for part, encoded in zip(missing, self.tokenizer.encode_batch_fast(missing, add_special_tokens=False)):
            known[part] = array("I", encoded.ids).tobytes()
        for i, split in new.items():
            out[i] = known[split[0]] if len(split) == 1 else known[split[0]] + known[split[1]]
        return out


def pieces(
    documents: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    keep_ids: bool = False,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Each whole text as token ids and ``end_id``, cut into pieces of ``capacity`` tokens.

    Columns: the id, ``piece``, ``start`` (ids of the document before it), ``length``,
    ``ids_crc32`` and, if asked for, ``ids``. ``tokenizer`` is a file that every machine has.
    A NULL or empty text is the end id alone. Repeated and NULL ids give rows of their own.
    """
    prepare(documents.sparkSession)
    kind = documents.schema[id_column].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        encoder = WordIds(tokenizer)
        for table in blocks(batches, limit=TEXT_BYTES, fill=True):
            texts = one_array(table.column("text"))
            # The tokenizer lower-cases; doing it first for A-Z leaves fewer distinct words.
            texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
            codes, offsets, words = words_of(texts, lower=False)
            ids = encoder.ids(words.to_pylist())
            lengths = np.array([len(i) for i in ids], np.int64) // 4
            flat = np.frombuffer(b"".join(ids), np.uint32)
            starts = np.cumsum(lengths) - lengths
            stream = ragged(flat, starts[codes], lengths[codes])
            before = np.concatenate([[0], np.cumsum(lengths[codes])])
            bounds = before[offsets]
            rows: list[tuple] = []
            names = one_array(table.column("id"))
            for row in range(len(names)):
                own = np.append(stream[bounds[row] : bounds[row + 1]], np.uint32(end_id)).astype("<u4")
                for number, start in enumerate(range(0, len(own), capacity)):
                    part = own[start : start + capacity]
                    rows.append((row, number, start, len(part), zlib.crc32(part.tobytes()), part if keep_ids else None))
            columns = [names.take(pa.array([r[0] for r in rows])), pa.array([r[1] for r in rows], pa.int32())]
            columns += [pa.array([r[i] for r in rows], pa.int64()) for i in (2, 3, 4)]
            if keep_ids:
                columns.append(pa.array([r[5].astype(np.int32) for r in rows], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    schema = T.StructType([T.StructField("id", kind)]).add("piece", "integer")
    for name in ("start", "length", "ids_crc32"):
        schema.add(name, "long")
    if keep_ids:
        schema.add("ids", T.ArrayType(T.IntegerType()))
    rows = documents.select(documents[id_column].alias("id"), documents[text_column].alias("text"))
    return rows.mapInArrow(cut, schema).withColumnRenamed("id", id_column)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin and offset of each item, and the fill of each bin.

    Bins with the same room are one stack; a bit mask of the rooms finds the tightest fit.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    stacks: dict[int, list[int]] = {}
    fills: list[int] = []
    rooms = 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[item])
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            stack = stacks[room]
            chosen = stack.pop()
            if not stack:
                rooms ^= 1 << room
        else:
            room, chosen = capacity, len(fills)
            fills.append(0)
        bins[item], offsets[item] = chosen, fills[chosen]
        fills[chosen] += length
        room -= length
        if room:
            stack = stacks.setdefault(room, [])
            stack.append(chosen)
            rooms |= 1 << room
    return bins, offsets, np.array(fills, np.int64)


def pack(items: DataFrame, capacity: int = CAPACITY, length_column: str = "length") -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``: each is placed whole in one sequence.

    The items are dealt evenly, so that each run of round 0 meets all lengths and not those of
    one file. Round 0 packs every run by itself, best fit in order of falling length. Bins that
    are nearly full are final; the others become items of their fill, and a tree of merge tasks,
    each over the bins of ``FAN_IN`` tasks before it, packs them again, until one task is left. A
    task hands on at most ``CARRIED`` bins, the emptiest; what it does not hand on is final as
    it is, so that no task grows with the table and every item has its place. That loses no
    merge: best fit opens a bin only for an item that fits in none, so any two bins of a run hold
    more than ``capacity`` together, and two bins can only be joined if one of them is at most half
    full. There is at most one such bin in a run, and it is the emptiest; a merge task gets one from each
    run before it, ``FAN_IN`` in all, and hands on at most one itself.

    Lengths are from 1 to ``capacity``; others, and NULL, raise an error. An empty table gives
    no row. Repeated rows are items of their own. Columns named as the two results are replaced.
    """
    spark = prepare(items.sparkSession)
    items = stored(items.drop("sequence_id", "offset"), "pieces")
    names = items.columns
    whole = items.select(F.struct(*names).alias("item"), items[length_column].cast("long").alias("size"))
    whole = whole.repartition(items.count() // RUN_ITEMS + 1)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        made, held, size = 0, [], 0

        def placed():
            table = pa.Table.from_batches(held)
            if table.column("size").null_count:
                raise ValueError("an item has no length")
            sizes = table.column("size").to_numpy()
            if len(sizes) and (sizes.min() < 1 or sizes.max() > capacity):
                raise ValueError(f"item lengths must be from 1 to {capacity}")
            bins, offsets, fills = best_fit(sizes, capacity)
            table = table.append_column("task", pa.array(np.full(len(sizes), task, np.int64)))
            table = table.append_column("bin", pa.array(bins + (task << 32) + made))
            table = table.append_column("offset", pa.array(offsets)).append_column("fill", pa.array(fills[bins]))
            return table, len(fills)

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > 64 << 20:
                table, count = placed()
                yield from table.to_batches(max_chunksize=10_000)
                made, held, size = made + count, [], 0
        if held:
            yield from placed()[0].to_batches(max_chunksize=10_000)

    schema = T.StructType([*whole.schema.fields])
    for name in ("task", "bin", "offset", "fill"):
        schema.add(name, "long")
    first = stored(whole.mapInArrow(local, schema), "packed")

    def merge(final: bool, limit: int):
        def run(table: pa.Table) -> pa.Table:
            fills = table.column("fill").to_numpy()
            order = np.lexsort((table.column("bin").to_numpy(), -fills))
            table, fills = table.take(pa.array(order)), fills[order]
            bins, offsets, sums = best_fit(fills, capacity)
            members: list[list[dict]] = [[] for _ in sums]
            for place, (own, base) in zip(table.column("members").to_pylist(), zip(bins.tolist(), offsets.tolist())):
                members[own].extend({"bin": m["bin"], "base": m["base"] + base} for m in place)
            carried = np.zeros(len(sums), bool)
            if not final:
                emptiest = np.argsort(sums, kind="stable")[:CARRIED]
                carried[emptiest] = sums[emptiest] < limit
            return pa.table(
                {
                    "task": pa.array(np.full(len(sums), table.column("task")[0].as_py() // FAN_IN), pa.int64()),
                    "bin": pa.array([m[0]["bin"] for m in members], pa.int64()),
                    "fill": pa.array(sums),
                    "members": pa.array(members, pa.list_(pa.struct([("bin", pa.int64()), ("base", pa.int64())]))),
                    "carried": pa.array(carried),
                }
            )

        return run

    shape = "task long, bin long, fill long, members array<struct<bin:long,base:long>>, carried boolean"
    bins = first.where((F.col("offset") == 0) & (F.col("fill") < int(NEARLY_FULL[0] * capacity))).select("task", "bin", "fill")
    bins = bins.withColumn("members", F.array(F.struct(F.col("bin").alias("bin"), F.lit(0).cast("long").alias("base"))))
    tasks = first.agg(F.max("task")).first()[0] or 0
    final_bins, level = [], 0
    while True:
        last = tasks < FAN_IN
        level += 1
        limit = int(NEARLY_FULL[min(level, len(NEARLY_FULL) - 1)] * capacity)
        grouped = bins.groupBy((F.col("task") / FAN_IN).cast("long").alias("group"))
        merged = stored(grouped.applyInArrow(merge(last, limit), shape), "merged")
        final_bins.append(merged.where(~F.col("carried")).select("bin", "members"))
        if last:
            break
        bins = merged.where("carried").drop("carried")
        tasks //= FAN_IN
    places = final_bins[0]
    for more in final_bins[1:]:
        places = places.unionAll(more)
    places = places.select(F.col("bin").alias("sequence"), F.explode("members").alias("m")).select("sequence", F.col("m.bin").alias("bin"), F.col("m.base").alias("base"))
    joined = first.join(places, "bin", "left")
    return joined.select(
        "item.*",
        F.coalesce("sequence", "bin").alias("sequence_id"),
        (F.coalesce("base", F.lit(0)) + F.col("offset")).alias("offset"),
    )
