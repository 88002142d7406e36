"""Nearest neighbours by a block matrix join of quantised vectors."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import prepare

# Vectors of a query block and of a candidate block; a tile of the join holds one of each.
QUERY_ROWS, BASE_ROWS = 1024, 8192
# Candidates of a tile that are multiplied at once.
STRIP = 2048


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as int8 steps: the steps, the size of a step, and the norm of the rest."""
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    unit = vectors / norms[:, None]
    step = np.abs(unit).max(axis=1) / 127.0
    steps = np.rint(unit / step[:, None]).astype(np.int8)
    rest = unit - steps * step[:, None]
    return steps, step, np.sqrt(np.einsum("ij,ij->i", rest, rest))


def cosines(query: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Cosine of one vector with each row, in double precision."""
    dots = np.einsum("ij,j->i", base, query)
    return dots / (np.sqrt(np.einsum("ij,ij->i", base, base)) * np.sqrt(np.einsum("j,j->", query, query)))


def tile(query_ids, queries, base_ids, base, k: int) -> list[tuple[int, float, int]]:
    """The ``k`` nearest of ``base`` to each query: rows of query id, score and id.

    With ``x = x' + e`` (``x'`` the quantised unit vector) the dot product differs from that
    of the quantised vectors by at most ``|e_x| |y'| + |x| |e_y|``. A candidate survives if its upper
    bound reaches the k-th largest lower bound; survivors are computed again exactly.
    """
    qs, qstep, qrest = quantised(queries)
    heaps: list[list[tuple[float, int]]] = [[] for _ in query_ids]
    slack = 1e-6  # of rounding in single precision, beyond the bound of the quantisation
    for at in range(0, len(base_ids), STRIP):
        ids, rows = base_ids[at : at + STRIP], base[at : at + STRIP]
        bs, bstep, brest = quantised(rows)
        # Products of int8 steps are whole numbers; float32 holds their sums exactly up to 2 ** 24.
        exact = np.float32 if queries.shape[1] * 127 * 127 < 1 << 24 else np.float64
        about = (qs.astype(exact) @ bs.astype(exact).T).astype(np.float64) * qstep[:, None] * bstep[None, :]
        bound = qrest[:, None] * (1.0 + brest[None, :]) + brest[None, :] + slack
        low = about - bound
        for i, query_id in enumerate(query_ids):
            own = ids == query_id
            floor = np.where(own, -np.inf, low[i])
            others = len(ids) - int(own.sum())
            least = -np.inf
            if others >= k:
                least = np.partition(floor, len(floor) - k)[len(floor) - k]
            heap = heaps[i]
            if len(heap) == k:
                least = max(least, heap[0][0] - slack)
            alive = np.flatnonzero((about[i] + bound[i] >= least) & ~own)
            for score, j in zip(cosines(queries[i], rows[alive]).tolist(), ids[alive].tolist()):
                entry = (score, -j)
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
    return [(int(query_ids[i]), score, -j) for i, heap in enumerate(heaps) for score, j in heap]


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    query_rows: int = QUERY_ROWS,
    base_rows: int = BASE_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows nearest to each query by cosine, exactly.

    Queries and candidates are dealt into blocks by a hash of the id; every pair of a query
    block and a candidate block is one tile, so a tile's memory does not grow with the table.
    A tile sends ``k`` rows per query on; those of a query are merged by heaps.

    Vectors that are NULL, zero, or hold a NULL or non-finite component, and rows without an
    id, take no part. Vectors of another length than a query's are no candidates of it. A
    query's own id is never its neighbour. Repeated rows (same id and vector) count once.
    Ties go to the smaller id. An empty table gives no row. Other columns are not read.
    """
    spark = prepare(vectors.sparkSession)
    vector = F.transform(vectors[vector_column], lambda x: x.cast("double"))
    rows = vectors.select(vectors[id_column].cast("long").alias("id"), is_query.alias("asked"), vector.alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & sound & F.exists("v", lambda x: x != 0)).withColumn("d", F.size("v"))
    # Equal rows would be two candidates; the shuffle carries each vector once.
    rows = rows.dropDuplicates(["id", "v"])
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("asked").alias("q")).first()
    base_blocks, query_blocks = -(-sizes["n"] // base_rows) or 1, -(-sizes["q"] // query_rows) or 1
    dealt = F.xxhash64("id", F.lit(7))
    row_block = F.pmod(dealt, F.lit(query_blocks)).cast("int")
    column_block = F.pmod(dealt, F.lit(base_blocks)).cast("int")
    asked = rows.where("asked").select(
        "d", row_block.alias("r"), F.explode(F.sequence(F.lit(0), F.lit(base_blocks - 1))).alias("c"), F.lit(True).alias("asked"), "id", "v"
    )
    base = rows.select(
        "d", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("r"), column_block.alias("c"), F.lit(False).alias("asked"), "id", "v"
    )

    def join(key, left, right):
        d = key[0].as_py()

        def matrix(table):
            flat = table.column("v").combine_chunks()
            flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
            return table.column("id").to_numpy(), flat.flatten().to_numpy().reshape(-1, d)

        found = []
        if left.num_rows and right.num_rows:
            found = tile(*matrix(left), *matrix(right), k)
        return pa.table(
            {"query_id": pa.array([f[0] for f in found], pa.int64()), "score": pa.array([f[1] for f in found], pa.float64()), "vec_id": pa.array([f[2] for f in found], pa.int64())}
        )

    best = asked.groupBy("d", "r", "c").cogroup(base.groupBy("d", "r", "c")).applyInArrow(join, "query_id long, score double, vec_id long")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            for query, score, j in zip(*(batch.column(c).to_pylist() for c in ("query_id", "score", "vec_id"))):
                heap = heaps.setdefault(query, [])
                if (score, -j) not in heap:
                    (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (score, -j))
        out = [(q, i + 1, -j, s) for q, heap in heaps.items() for i, (s, j) in enumerate(sorted(heap, reverse=True))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int64()), pa.array([o[3] for o in out], pa.float64())],
            ["query_id", "rank", "vec_id", "score"],
        )

    return best.repartition("query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")
