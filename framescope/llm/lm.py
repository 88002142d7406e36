"""Hierarchical Pitman-Yor language model: fit by sampling, score every document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import blocks, mix, one_array, packed_numbers, prepare, stored, stored_for_now, sums, unpacked_numbers, word_hashes, words_of

# Discount and strength of the context restaurants; the root has discount 0 and strength V + 1.
DISCOUNT, STRENGTH = 0.75, 1.0
# Sweeps that are thrown away, and samples whose predictions are averaged.
BURN_IN, SAMPLES = 3, 2
# Customers that are seated one by one before seating jumps from new table to new table.
STEPS = 12
# Text bytes of a block of documents (a task holds one at a time, in some 60 MB), and of a bucket of contexts.
BLOCK, BUCKET = 4 << 20, 12 << 20
# Bits of a word's hash in pairs.
WORD_BITS = 40
START, END = 1, 2  # hashes of the beginning and the end of a text


def steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=np.uint64(0))


# Blocks


class Block:
    """The tokens of some documents: their words' hashes, and the distinct words and pairs.

    Every text is its words and one end; the first token has the start as its context.
    """

    def __init__(self, texts: pa.Array, train: np.ndarray):
        codes, offsets, words = words_of(texts)
        known = np.concatenate([np.array([START, END], np.uint64), word_hashes(words) | np.uint64(4)])
        order = np.argsort(known, kind="stable")
        self.hashes = known[order]  # sorted
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        count = np.diff(offsets)
        self.offsets = offsets + np.arange(len(offsets))  # with an end after each text
        self.tokens = np.full(int(self.offsets[-1]), rank[1], np.int64)
        place = np.ones(len(self.tokens), bool)
        place[self.offsets[1:] - 1] = False
        self.tokens[place] = rank[codes + 2]
        self.contexts = np.empty_like(self.tokens)
        self.contexts[1:] = self.tokens[:-1]
        self.contexts[self.offsets[:-1]] = rank[0]
        self.train = np.repeat(train, count + 1)
        self.check = int(mix(np.array([len(self.tokens)], np.uint64) + self.hashes.sum())[0] >> np.uint64(1))

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.train], minlength=len(self.hashes))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs in order of context and word, their training counts, and each token's pair."""
        key = self.contexts * len(self.hashes) + self.tokens
        pairs, own = np.unique(key, return_inverse=True)
        counts = np.bincount(own[self.train], minlength=len(pairs))
        return pairs // len(self.hashes), pairs % len(self.hashes), counts, own


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table, Block]]:
    """The blocks of a task. The same scan makes the same blocks each time; ``check`` proves it."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    for number, table in enumerate(blocks(batches, limit=BLOCK, fill=True)):
        yield task << 32 | number, table, Block(one_array(table.column("text")), table.column("train").to_numpy())


def spread(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the leading bits of a hash, so that sorted hashes have sorted buckets."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def pair_buckets(block: Block, left: np.ndarray, right: np.ndarray, buckets: int, hot: dict[int, int]) -> np.ndarray:
    """Bucket of each pair: that of its context, or for hot contexts one of several, by the word."""
    own = spread(mix(block.hashes), buckets)[left].astype(np.int64)
    for context, parts in hot.items():
        at = np.searchsorted(block.hashes, np.uint64(context))
        if at < len(block.hashes) and block.hashes[at] == np.uint64(context):
            rows = np.flatnonzero(left == at)
            own[rows] = (own[rows] + (mix(block.hashes[right[rows]]) % np.uint64(parts)).astype(np.int64)) % buckets
    return own


# Seating


def seated(rng, counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Tables after ``counts`` customers of one dish sat down one after another.

    With ``n`` customers at ``t`` tables the next one opens a table with probability
    ``weight / (n - DISCOUNT t + weight)``. Beyond the first ones, the number of customers
    up to the next new table is drawn at once: the chance that none opens one is a quotient of gamma
    functions, close to a power of ``n``.
    """
    tables = np.minimum(counts, 1)
    for n in range(1, min(int(counts.max(initial=0)), STEPS)):
        rows = np.flatnonzero(counts > n)
        chance = weight[rows] / (n - DISCOUNT * tables[rows] + weight[rows])
        tables[rows] += rng.random(len(rows)) < chance
    rows = np.flatnonzero(counts > STEPS)
    at = np.full(len(rows), float(STEPS))
    while len(rows):
        w = weight[rows]
        shift = (w - 1) / 2 - DISCOUNT * tables[rows]
        with np.errstate(over="ignore", divide="ignore"):
            jump = np.exp(-np.log(rng.random(len(rows))) / w)
            following = np.ceil((np.maximum(at + shift, 0.5)) * jump - shift)
        following = np.maximum(following, at + 1)
        sits = following <= counts[rows]
        rows, at = rows[sits], following[sits]
        tables[rows] += 1
    return tables


def reseated(rng, counts: np.ndarray, opened: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Tables of each dish after its customers sat down again, given the seating of all others.

    A new table is as likely as the parent's predictive probability ``parent`` of the word; ``opened``
    counts the tables of the dish's whole restaurant.
    """
    return seated(rng, counts, (STRENGTH + DISCOUNT * opened) * parent)


def sampled(seed: int, context: np.ndarray, word: np.ndarray, counts: np.ndarray, parts: np.ndarray, share: float) -> np.ndarray:
    """Tables of each pair in each kept sample, for restaurants that are all in one task.

    A sweep empties the tables of each dish of each restaurant and seats its customers again. The operator
    makes the same sweeps over many tasks.
    """
    rng = np.random.default_rng(seed)
    tables = np.minimum(counts, 1)
    moving = np.flatnonzero(counts > 1)
    kept = []
    words, contexts = int(word.max(initial=-1)) + 1, int(context.max(initial=-1)) + 1
    for sweep in range(BURN_IN + SAMPLES):
        below = np.bincount(word, weights=tables, minlength=words)
        own = np.bincount(context, weights=tables, minlength=contexts) * parts
        parent = (below + share) / (below.sum() + share * (words + 1))
        tables = tables.copy()
        tables[moving] = reseated(rng, counts[moving], own[context[moving]], parent[word[moving]])
        if sweep >= BURN_IN:
            kept.append(tables)
    return np.stack(kept)


# Operator


def scores(documents: DataFrame, train: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Score every whole text with a model that learns from the rows where ``train`` is true.

    Per row: the id, ``train``, ``n_tokens`` (words and one end), ``n_known`` (tokens that
    training has), ``train_tokens``, ``base_score`` (add-one unigram) and ``score``, both log10
    probabilities of the text, ``perplexity`` (of ``score`` per token).

    The model is a hierarchy of Pitman-Yor restaurants: one for each preceding word (or the
    start), and one parent of all. Restaurants are dealt to tasks by their context. Before each
    sweep the tables that a word has in all restaurants are added up and told to the tasks, which
    then seat all customers again (distributed Gibbs sampling with the parent of the sweep before).
    A context with more than a task's share of the tokens is split by words, and its tables are the sum
    over its parts. Predictive probabilities are averaged over the samples.

    ``documents`` must give the same rows in the same order each time it is read, as a scan of
    files does; it is checked, and an error raised otherwise. NULL and empty texts are one end. Repeated rows
    and NULL ids are rows of their own; a NULL ``train`` is false. Other columns are not read.
    An empty training set gives every token the probability 1.
    """
    prepare(documents.sparkSession)
    rows = documents.select(
        documents[id_column].alias("id"), documents[text_column].alias("text"), F.coalesce(train, F.lit(False)).alias("train")
    )
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = int(8 + size // BUCKET)

    # Contexts that would fill a bucket alone.
    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, block in numbered(batches):
            n = np.bincount(block.contexts, minlength=len(block.hashes))
            often = np.flatnonzero(n * 4 * buckets >= len(block.tokens))
            hashes = np.append(block.hashes[often], np.uint64(0)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(np.append(n[often], len(block.tokens)))], ["hash", "n"])

    often = rows.mapInArrow(frequent, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    tokens = often.where("hash = 0").first()
    tokens = tokens["n"] if tokens else 0
    # No more than ``buckets`` contexts can have a bucket's share each.
    found = often.where((F.col("hash") != 0) & (F.col("n") * buckets > tokens)).collect()
    hot = {r["hash"] % (1 << 64): int(-(-r["n"] * buckets // tokens)) for r in found}

    def ask_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, block in numbered(batches):
            left, right, counts, _ = block.pairs()
            own = pair_buckets(block, left, right, buckets, hot)
            order = np.argsort(own, kind="stable")
            bounds = np.searchsorted(own[order], np.arange(buckets + 1))
            for bucket in np.flatnonzero(np.diff(bounds)).tolist():
                chosen = order[bounds[bucket] : bounds[bucket + 1]]
                contexts, n = np.unique(left[chosen], return_counts=True)
                words = block.hashes[right[chosen]] >> np.uint64(64 - WORD_BITS)
                payload = packed_numbers(steps(block.hashes[contexts]), n, words, counts[chosen])
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([number]), pa.array([block.check]), pa.array([payload], pa.binary())], ["bucket", "block", "check", "payload"])

    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
    shape = "kind int, to long, part int, check long, payload binary"

    def made(out: list[tuple]) -> pa.Table:
        names = ("kind", "to", "part", "check", "payload")
        return pa.table({name: pa.array([o[i] for o in out], kind) for i, (name, kind) in enumerate(zip(names, kinds))})

    def told(bucket: int, sample: int, names: np.ndarray, known: np.ndarray, opened: np.ndarray, below: np.ndarray) -> list[tuple]:
        """Tables per word for the buckets of words (kind 1), and of the parts of split contexts (kind 4)."""
        dealt = spread(known << np.uint64(64 - WORD_BITS), buckets)
        bounds = np.searchsorted(dealt, np.arange(buckets + 1, dtype=np.uint64))
        out = []
        for to in np.flatnonzero(np.diff(bounds)).tolist():
            piece = slice(bounds[to], bounds[to + 1])
            out.append((1, to, bucket, sample, packed_numbers(steps(known[piece]), below[piece])))
        often = [i for i, n in enumerate(names.tolist()) if n in hot]
        out.append((4, 0, bucket, sample, packed_numbers(names[often], opened[often])))
        return out

    def begin(table):
        """The restaurants of a bucket with one table for each dish.

        Kind 5: contexts, words, and the dishes with several customers, which alone move. Kind 6: their tables.
        Kinds 8 and 9: the pairs of each block, and the customers of all pairs.
        """
        bucket = table.column("bucket")[0].as_py()
        asked = [unpacked_numbers(p.as_py()) for p in table.column("payload")]
        contexts = [np.cumsum(a[0], dtype=np.uint64) for a in asked]
        left = np.concatenate([np.repeat(c, a[1].astype(np.int64)) for c, a in zip(contexts, asked)])
        right = np.concatenate([a[2] for a in asked])
        counts = np.concatenate([a[3] for a in asked]).astype(np.int64)
        names, context = np.unique(left, return_inverse=True)
        known, word = np.unique(right, return_inverse=True)
        pair, own = np.unique(context.astype(np.int64) * len(known) + word, return_inverse=True)
        total = np.bincount(own, weights=counts, minlength=len(pair)).astype(np.int64)
        context, word = pair // len(known), pair % len(known)
        moving = total > 1
        single = total == 1
        opened, below = (np.bincount(i[single], minlength=n) for i, n in ((context, len(names)), (word, len(known))))
        state = packed_numbers(names, known, opened, below, context[moving], word[moving], total[moving])
        ones = np.ones(int(moving.sum()), np.int64)
        out = [(5, bucket, 0, 0, state), (6, bucket, 0, 0, packed_numbers(ones)), (9, bucket, 0, 0, packed_numbers(total))]
        at = 0
        for number, check, own_contexts, a in zip(table.column("block").to_pylist(), table.column("check").to_pylist(), contexts, asked):
            mine = own[at : at + len(a[2])]
            at += len(a[2])
            out.append((8, bucket, 0, check, packed_numbers([number], mine, np.searchsorted(names, own_contexts))))
        every = (np.bincount(i, weights=total > 0, minlength=n) for i, n in ((context, len(names)), (word, len(known))))
        return made(out + told(bucket, 0, names, known, *every))

    def parents(table):
        """Tables of each word in all restaurants, for each bucket that has the word, and their sum (kind 3)."""
        bucket = table.column("to")[0].as_py()
        asked = [unpacked_numbers(p.as_py()) for p in table.column("payload")]
        words_ = [np.cumsum(a[0], dtype=np.uint64) for a in asked]
        known, own = np.unique(np.concatenate(words_), return_inverse=True)
        below = np.bincount(own, weights=np.concatenate([a[1] for a in asked]), minlength=len(known)).astype(np.int64)
        out = [(3, 0, bucket, 0, packed_numbers([int(below.sum()), int((below > 0).sum())]))]
        at = 0
        for to, names in zip(table.column("part").to_pylist(), words_):
            out.append((7, to, bucket, 0, packed_numbers(below[own[at : at + len(names)]])))
            at += len(names)
        return made(out)

    def split_tables(frame: DataFrame) -> dict[int, int]:
        """Tables of each split context, summed over its parts: at most twice ``buckets`` numbers."""
        out: dict[int, int] = {}
        for row in frame.where("kind = 4").select("payload").collect():
            for name, n in zip(*(v.tolist() for v in unpacked_numbers(bytes(row["payload"])))):
                out[name] = out.get(name, 0) + n
        return out

    def sweep_of(number: int, opened_hot: dict[int, int], customers: int, words_: int):
        def sweep(table):
            bucket = table.column("to")[0].as_py()
            payloads = {}
            for kind, part, payload in zip(*(table.column(c).to_pylist() for c in ("kind", "part", "payload"))):
                payloads[kind, part] = unpacked_numbers(payload)
            names, known, opened, below, context, word, counts = payloads[5, 0]
            opened, below, context, word, counts = (v.astype(np.int64) for v in (opened, below, context, word, counts))
            tables = payloads[6, 0][0].astype(np.int64)
            replies = [payloads[k][0] for k in sorted(k for k in payloads if k[0] == 7)]
            parent = (np.concatenate(replies).astype(float) + 1) / (customers + words_ + 1)
            everywhere = opened + np.bincount(context, weights=tables, minlength=len(names))
            for i, name in enumerate(names.tolist()):
                if name in opened_hot:
                    everywhere[i] = opened_hot[name]
            rng = np.random.default_rng([bucket + 1, number])
            tables = reseated(rng, counts, everywhere[context], parent[word])
            opened = opened + np.bincount(context, weights=tables, minlength=len(names)).astype(np.int64)
            below = below + np.bincount(word, weights=tables, minlength=len(known)).astype(np.int64)
            sample = max(0, number - BURN_IN)
            return made([(6, bucket, 0, sample, packed_numbers(tables)), *told(bucket, sample, names, known, opened, below)])

        return sweep

    asked = rows.mapInArrow(ask_pairs, "bucket int, block long, check long, payload binary")
    start = stored(asked.groupBy("bucket").applyInArrow(begin, shape), "start")
    # Replies and burnt-in sweeps that no later step reads are deleted once the next ones are stored.
    current, samples, current_path, replies_path = start, [], None, None
    for number in range(BURN_IN + SAMPLES):
        replies, replies_path = stored_for_now(current.where("kind = 1").groupBy("to").applyInArrow(parents, shape), "parents", replies_path)
        told_all = np.zeros(2, np.int64)
        for row in replies.where("kind = 3").select("payload").collect():  # one short row per bucket
            told_all += unpacked_numbers(bytes(row["payload"]))[0].astype(np.int64)
        given = start.where("kind = 5").unionAll(current.where("kind = 6")).unionAll(replies.where("kind = 7"))
        sweep = sweep_of(number, split_tables(current), *told_all.tolist())
        done = current_path if 0 < number <= BURN_IN else None
        current, current_path = stored_for_now(given.groupBy("to").applyInArrow(sweep, shape), "sweep", done)
        if number >= BURN_IN:
            samples.append(current)
    opened_hot = [split_tables(sample) for sample in samples]

    def answer(table):
        """The customers and tables of each block's pairs, and the tables of its contexts in the bucket."""
        bucket = table.column("to")[0].as_py()
        tables, blocks_ = {}, []
        for kind, check, payload in zip(*(table.column(c).to_pylist() for c in ("kind", "check", "payload"))):
            values = unpacked_numbers(payload)
            if kind == 5:
                names, _, opened, _, context, *_ = values
            elif kind == 6:
                tables[check] = values[0].astype(np.int64)
            elif kind == 9:
                total = values[0].astype(np.int64)
            else:
                blocks_.append((int(values[0][0]), check, values[1].astype(np.int64), values[2].astype(np.int64)))
        whole, per_context = [], []
        for s in range(SAMPLES):
            every = np.minimum(total, 1)
            every[total > 1] = tables[s]
            whole.append(every)
            per_context.append(opened.astype(np.int64) + np.bincount(context.astype(np.int64), weights=tables[s], minlength=len(names)).astype(np.int64))
        return made([
            (0, number, bucket, check, packed_numbers(total[mine], *[t[mine] for t in whole], *[p[rows_] for p in per_context]))
            for number, check, mine, rows_ in blocks_
        ])

    sampled_tables = samples[0]
    for sample in samples[1:]:
        sampled_tables = sampled_tables.unionAll(sample)
    given = start.where("kind in (5, 8, 9)").unionAll(sampled_tables.where("kind = 6"))
    seats = given.groupBy("to").applyInArrow(answer, shape)

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, block in numbered(batches):
            counts = block.word_counts()
            bounds = np.searchsorted(spread(block.hashes, buckets), np.arange(buckets + 1, dtype=np.uint64))
            for bucket in np.flatnonzero(np.diff(bounds)).tolist():
                piece = slice(bounds[bucket], bounds[bucket + 1])
                payload = packed_numbers(steps(block.hashes[piece]), counts[piece])
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([number]), pa.array([block.check]), pa.array([payload], pa.binary())], ["to", "block", "check", "payload"])

    def count(key, asked_, tables_):
        bucket = key[0].as_py()
        asked = [unpacked_numbers(p.as_py()) for p in asked_.column("payload")]
        hashes = [np.cumsum(a[0], dtype=np.uint64) for a in asked]
        known, own = np.unique(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), return_inverse=True)
        total = np.bincount(own, weights=np.concatenate([a[1] for a in asked]) if asked else None, minlength=len(known)).astype(np.int64)
        short = known >> np.uint64(64 - WORD_BITS)
        customers = np.zeros((SAMPLES, len(known)), np.int64)
        for s, payload in zip(tables_.column("check").to_pylist(), tables_.column("payload")):
            names, tables = unpacked_numbers(payload.as_py())
            # The start, which is never a word, and the end have the same short hash; the end is the later one.
            customers[s, np.searchsorted(short, np.cumsum(names, dtype=np.uint64), side="right") - 1] += tables.astype(np.int64)
        out = {"kind": [3], "to": [0], "part": [bucket], "check": [0], "payload": [packed_numbers([total.sum(), (total > 0).sum(), *customers.sum(axis=1)])]}
        at = 0
        for number, check, names in zip(asked_.column("block").to_pylist(), asked_.column("check").to_pylist(), hashes):
            mine = own[at : at + len(names)]
            at += len(names)
            for name, value in zip(out, (2, number, bucket, check, packed_numbers(total[mine], *[c[mine] for c in customers]))):
                out[name].append(value)
        return pa.table({name: pa.array(values, kind) for (name, values), kind in zip(out.items(), kinds)})

    words = rows.mapInArrow(ask_words, "to long, block long, check long, payload binary")
    words = stored(words.groupBy("to").cogroup(sampled_tables.where("kind = 1").groupBy("to")).applyInArrow(count, shape), "words")
    whole = np.zeros(2 + SAMPLES)
    for row in words.where("kind = 3").select("payload").collect():  # one short row per bucket
        whole += unpacked_numbers(bytes(row["payload"]))[0].astype(float)
    n_train, n_words, customers_all = int(whole[0]), int(whole[1]), whole[2:]
    kind = documents.schema[id_column].dataType
    schema = T.StructType([T.StructField("id", kind)]).add("train", "boolean")
    for name in ("n_tokens", "n_known", "train_tokens"):
        schema.add(name, "long")
    for name in ("base_score", "score", "perplexity"):
        schema.add(name, "double")

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table, block in numbered(batches):
            buffer = pa.BufferOutputStream()
            with pa.ipc.new_stream(buffer, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table)
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([block.check]), pa.array([buffer.getvalue().to_pybytes()], pa.binary())], ["to", "check", "payload"])

    def score(key, carried, answers):
        out = []
        for payload, check in zip(carried.column("payload"), carried.column("check").to_pylist()):
            table = pa.ipc.open_stream(pa.py_buffer(payload.as_py())).read_all().combine_chunks()
            block = Block(one_array(table.column("text")), table.column("train").to_numpy())
            if any(c != check for c in answers.column("check").to_pylist()):
                raise ValueError("the documents were not read in the same order twice; store them first")
            found = {(k, p): i for i, (k, p) in enumerate(zip(answers.column("kind").to_pylist(), answers.column("part").to_pylist()))}
            get = lambda k, p: unpacked_numbers(answers.column("payload")[found[k, p]].as_py())  # noqa: B023,E731
            seen = np.zeros(len(block.hashes), np.int64)
            customers = np.zeros((SAMPLES, len(block.hashes)))
            bounds = np.searchsorted(spread(block.hashes, buckets), np.arange(buckets + 1, dtype=np.uint64))
            for part in np.flatnonzero(np.diff(bounds)).tolist():
                piece = slice(bounds[part], bounds[part + 1])
                seen[piece], *rest = get(2, part)
                customers[:, piece] = rest
            starts = int(np.searchsorted(block.hashes, np.uint64(START)))
            ends = int(np.searchsorted(block.hashes, np.uint64(END)))
            visits = seen.astype(float)
            visits[starts] = seen[ends]  # every text has one start and one end
            left, right, _, own = block.pairs()
            dealt = pair_buckets(block, left, right, buckets, hot)
            order = np.argsort(dealt, kind="stable")
            bounds = np.searchsorted(dealt[order], np.arange(buckets + 1))
            total, tables = np.zeros(len(left)), np.zeros((SAMPLES, len(left)))
            opened = np.zeros((SAMPLES, len(left)))
            for part in np.flatnonzero(np.diff(bounds)).tolist():
                chosen = order[bounds[part] : bounds[part + 1]]
                values = get(0, part)
                total[chosen] = values[0]
                _, at = np.unique(left[chosen], return_inverse=True)
                for s in range(SAMPLES):
                    tables[s, chosen] = values[1 + s]
                    opened[s, chosen] = values[1 + SAMPLES + s][at]
            for context in hot:
                at = np.searchsorted(block.hashes, np.uint64(context))
                if at < len(block.hashes) and block.hashes[at] == np.uint64(context):
                    for s in range(SAMPLES):
                        opened[s, left == at] = opened_hot[s][context]
            chance = np.zeros(len(left))
            for s in range(SAMPLES):
                parent = (customers[s][right] + 1) / (customers_all[s] + n_words + 1)
                first = np.maximum(total - DISCOUNT * tables[s], 0)
                chance += (first + (STRENGTH + DISCOUNT * opened[s]) * parent) / (STRENGTH + visits[left])
            log = np.log10(chance / SAMPLES)
            base = np.log10((seen + 1.0) / (n_train + n_words + 1.0))
            count = np.diff(block.offsets)
            score_ = sums(log[own], block.offsets)
            columns = [one_array(table.column("id")), one_array(table.column("train")), pa.array(count)]
            columns += [pa.array(sums((seen > 0)[block.tokens].astype(np.int64), block.offsets)), pa.array(np.full(len(count), n_train))]
            columns += [pa.array(sums(base[block.tokens], block.offsets)), pa.array(score_), pa.array(10 ** np.minimum(-score_ / count, 300.0))]
            out.append(pa.Table.from_arrays(columns, names=schema.names))
        if not out:
            raise ValueError("the documents were not read in the same order twice; store them first")
        return pa.concat_tables(out)

    answers = seats.unionAll(words.where("kind = 2"))
    carried = rows.mapInArrow(carry, "to long, check long, payload binary")
    scored = carried.groupBy("to").cogroup(answers.groupBy("to")).applyInArrow(score, schema)
    return scored.withColumnRenamed("id", id_column)
