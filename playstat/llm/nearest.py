"""Exact nearest neighbours by a block matrix join over int8 tiles.

Vectors are packed into blocks of ``BLOCK`` rows, quantised to int8 with a scale of
their own, and the grid of query blocks by candidate blocks is the join: one row
for each pair of blocks, so no task sees more than two blocks at a time. For a
tile, the int8 product (integers below 2**24, so a float32 product is exact) gives
each inner product up to the error bound

    |<q, c> - <q', c'>| <= |q - q'| |c| + |q'| |c - c'|

A pair survives unless its upper bound is below the k-th largest lower bound of its
query. Survivors are computed again in double precision, adding components in
order, and kept in a heap of k per query; heaps of a query's tiles are merged by
rank. Nothing is approximate in the result.

Cases: vectors that are null, empty, zero, or have null or non-finite components
take no part, neither do rows without vec_id; vectors are compared with those of
their own dimension; rows of a repeated vec_id are candidates of their own, except
for the queries of that id, of which one (the largest vector by component order)
is asked; equal scores go to the smaller vec_id; fewer candidates than k are all
returned; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playstat.llm.storage import materialise, table

BLOCK = 4096                   # vectors of a block
SPLIT = 1024                   # candidate columns of a tile that are multiplied at once
MOST_PARTS = 20_000            # partitions of the grid; beyond it a task does several tiles in turn
QUERY_EVERY = 20
NEIGHBOURS = 20
_MAX_DIM = (1 << 24) // 127 ** 2


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.select("vec_id", v.alias("v"))
            .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)))


def blocks(rows: DataFrame, name: str, size: int = BLOCK) -> DataFrame:
    """One row per block: dim, number of the block in its dimension, ids and vectors as bytes.

    Rows are dealt by a hash of id and vector into enough parts for ``size`` rows each."""
    counts = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()
    parts = F.create_map(*[F.lit(x) for r in counts or [{"dim": 0, "n": 1}] for x in (r["dim"], -(-r["n"] // size))])
    dealt = (rows.withColumn("dim", F.size("v"))
             .withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), parts[F.col("dim")]).cast("int"))
             .repartition("dim", "block").sortWithinPartitions("dim", "block", "vec_id"))

    def pack(batches):
        key, ids, vectors = None, [], []

        def flush():
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()),
                 pa.array([np.concatenate(ids).tobytes()], pa.binary()),
                 pa.array([np.concatenate(vectors).tobytes()], pa.binary())], ["dim", "block", "ids", "vectors"])

        for b in batches:
            dim, block = (b.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "block"))
            cuts = np.flatnonzero((np.diff(dim) != 0) | (np.diff(block) != 0)) + 1
            for i, j in zip([0, *cuts], [*cuts, b.num_rows]):
                if i == j:
                    continue
                if key != (int(dim[i]), int(block[i])):
                    if key is not None:
                        yield from flush()
                    key, ids, vectors = (int(dim[i]), int(block[i])), [], []
                ids.append(b.column("vec_id").slice(i, j - i).to_numpy(zero_copy_only=False))
                vectors.append(b.column("v").slice(i, j - i).flatten().to_numpy(zero_copy_only=False))
        if key is not None:
            yield from flush()

    return materialise(dealt.mapInArrow(pack, "dim int, block int, ids binary, vectors binary"), name)


class Quantised:
    """A block's vectors, their int8 forms (held as float32) and error norms."""

    def __init__(self, ids: bytes, vectors: bytes, dim: int):
        self.ids = np.frombuffer(ids, np.int64)
        self.exact = np.frombuffer(vectors, np.float64).reshape(-1, dim)
        top = np.abs(self.exact).max(axis=1)
        self.scale = top / 127
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            unit = np.clip(np.nan_to_num(self.exact / top[:, None] * 127), -127, 127)
        self.int8 = np.rint(unit).astype(np.int8).astype(np.float32)
        with np.errstate(over="ignore"):
            near = self.int8 * self.scale[:, None]
            self.error = _norm(self.exact - near)
            self.norm = _norm(self.exact)
            self.near_norm = _norm(near)


def _norm(x: np.ndarray) -> np.ndarray:
    """Euclidean norms, rounded up a little."""
    top = np.abs(x).max(axis=1)
    safe = np.where(top > 0, top, 1)
    return np.sqrt(((x / safe[:, None]) ** 2).sum(axis=1)) * safe * (1 + 1e-12)


def in_order(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, components added in order."""
    total = np.zeros(len(q))
    for d in range(q.shape[1]):
        total += q[:, d] * c[:, d]
    return total


def tile(q: Quantised, c: Quantised, k: int) -> list[list[tuple[float, int]]]:
    """Per query of the block its k best candidates of the other block, as (score, -vec_id)."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in q.ids]
    for at in range(0, len(c.ids), SPLIT):
        own = slice(at, at + SPLIT)
        product = np.zeros((len(q.ids), len(c.ids[own])))
        for d in range(0, q.int8.shape[1], _MAX_DIM):
            product += q.int8[:, d:d + _MAX_DIM] @ c.int8[own, d:d + _MAX_DIM].T
        with np.errstate(over="ignore", invalid="ignore"):
            product *= q.scale[:, None] * c.scale[own]
            bound = q.error[:, None] * c.norm[own] + q.near_norm[:, None] * c.error[own]
            # products in double precision err too
            bound += (q.norm[:, None] * c.norm[own]) * (1e-15 * (4 + q.int8.shape[1])) + 1e-300
            upper = product + bound
            lower = product - bound
        same = q.ids[:, None] == c.ids[own]
        lower[same] = -np.inf
        floor = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
        if lower.shape[1] >= k:
            floor = np.maximum(floor, np.partition(lower, -k, axis=1)[:, -k])
        alive = ~same & ~(upper < floor[:, None])
        row, column = np.nonzero(alive)
        score = in_order(q.exact[row], c.exact[own][column])
        for i, s, name in zip(row.tolist(), score.tolist(), c.ids[own][column].tolist()):
            entry = (s, -name)
            if len(heaps[i]) < k:
                heapq.heappush(heaps[i], entry)
            elif entry > heaps[i][0]:
                heapq.heapreplace(heaps[i], entry)
    return heaps


def search(queries: DataFrame, candidates: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query.

    Both sides have vec_id and v; a candidate with the query's own id is skipped."""
    one = queries.groupBy("vec_id").agg(F.max("v").alias("v"))
    q = blocks(one, "nn-queries").select(F.col("dim").alias("q_dim"), F.col("block").alias("q_block"),
                                         F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    c = blocks(candidates, "nn-candidates")
    grid_size = q.groupBy(F.col("q_dim").alias("dim")).agg(F.collect_list("q_block").alias("q_blocks"))
    grid = (c.select("dim", "block").join(grid_size, "dim")
            .select("dim", "block", F.explode("q_blocks").alias("q_block")))
    pairs = (grid.join(c, ["dim", "block"])
             .join(q, (F.col("dim") == F.col("q_dim")) & (grid["q_block"] == q["q_block"]))
             .select("dim", "ids", "vectors", "q_ids", "q_vectors")
             .repartition(min(MOST_PARTS, max(1, q.count() * c.count())), F.xxhash64("ids"), F.xxhash64("q_ids")))

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                dim = b.column("dim")[r].as_py()
                left = Quantised(b.column("q_ids")[r].as_py(), b.column("q_vectors")[r].as_py(), dim)
                heaps = tile(left, Quantised(b.column("ids")[r].as_py(), b.column("vectors")[r].as_py(), dim), k)
                rows = [(name, -x, s) for name, heap in zip(left.ids.tolist(), heaps) for s, x in heap]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))],
                    ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op5_nearest(spark, sf_dir: str) -> DataFrame:
    """Contract digest: the 20 nearest of every vector whose id is divisible by 20."""
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return search(vectors.where(F.col("vec_id") % QUERY_EVERY == 0), vectors)


OP5_SQL = f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id query_id, c.vec_id, list_inner_product(q.e, c.e) score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % {QUERY_EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rank FROM s)
SELECT query_id, rank::INTEGER rank, vec_id, score FROM r WHERE rank <= {NEIGHBOURS}
"""
