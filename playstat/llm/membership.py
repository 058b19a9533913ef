"""A Bloom filter of fixed size that saves shuffling rows which a join would drop.

Texts are by far the widest column, so a join of the documents with a short list of
ids first drops the rows whose id is surely not in the list. The filter's size is
fixed (``BITS``), whatever the corpus: it is OR-ed chunk by chunk on the executors
and its chunks are what the driver broadcasts. The more ids, the more rows it lets
through; the exact join that follows makes the result right in any case.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playstat.llm.ragged import mix

BITS = 1 << 25                 # 4 MiB
CHUNK = 1 << 18                # bits of a chunk
HASHES = 2


def _places(ids: np.ndarray) -> list[np.ndarray]:
    base = ids.astype(np.int64).view(np.uint64)
    return [(mix(base + np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))) % np.uint64(BITS)).astype(np.int64)
            for k in range(1, HASHES + 1)]


def marked(ids: DataFrame):
    """Broadcast filter of the first column of ``ids`` (long), for ``known``."""
    name = ids.columns[0]

    def mark(batches):
        bits = np.zeros(BITS, bool)
        for b in batches:
            for at in _places(b.column(0).to_numpy(zero_copy_only=False)):
                bits[at] = True
        for k in range(BITS // CHUNK):
            own = bits[k * CHUNK:(k + 1) * CHUNK]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(own).tobytes()])],
                                                 ["chunk", "bits"])

    def merge(parts: pa.Table) -> pa.Table:
        total = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in parts.column("bits").to_pylist()])
        return pa.table({"chunk": parts.column("chunk").slice(0, 1), "bits": [total.tobytes()]})

    schema = "chunk int, bits binary"
    chunks = (ids.select(F.col(name).cast("long")).where(F.col(name).isNotNull())
              .mapInArrow(mark, schema).groupBy("chunk").applyInArrow(merge, schema).collect())
    packed = np.zeros(BITS // 8, np.uint8)
    for r in chunks:
        packed[r["chunk"] * CHUNK // 8:(r["chunk"] + 1) * CHUNK // 8] = np.frombuffer(r["bits"], np.uint8)
    return ids.sparkSession.sparkContext.broadcast(packed.tobytes())


def known(packed: bytes, x: pa.Array) -> np.ndarray:
    """False for the values that are surely absent."""
    bits = np.frombuffer(packed, np.uint8)
    found = x.is_valid().to_numpy(zero_copy_only=False).copy()
    values = x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for at in _places(values):
        found &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return found


def bloom(ids: DataFrame) -> Column:
    """For the first column of ``ids`` (long): a function of a column that is false
    only for values that are surely absent."""
    shared = marked(ids)

    @F.arrow_udf("boolean")
    def maybe(x: pa.Array) -> pa.Array:
        return pa.array(known(shared.value, x))

    return maybe


def semi_join(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The ``rows`` whose key is in the only column of ``ids``; other rows are not shuffled."""
    ids = ids.toDF(key).distinct()
    return rows.where(bloom(ids)(F.col(key))).join(ids, key, "left_semi")


def anti_join(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The ``rows`` whose key is not in the only column of ``ids``; only suspects are shuffled."""
    ids = ids.toDF(key).distinct()
    maybe = bloom(ids)(F.col(key))
    return rows.where(~maybe).unionByName(rows.where(maybe).join(ids, key, "left_anti"))
