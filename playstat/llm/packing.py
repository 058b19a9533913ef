"""Best-fit packing of token sequences with exact complements.

1. Every task tokenizes its documents (a worker-local memo of pre-tokens, filled
   by the ``tokenizers`` library), ends each with an end id and cuts the ones
   longer than a sequence.
2. How pieces combine depends on their lengths alone, so the plan is made from the
   number of pieces of each length: at most ``capacity`` counts, whatever the
   corpus. From the longest length down, the gap beside a piece is looked up
   among the single, pair and triple sums of the lengths that are still
   available; every combination that fills it exactly is used as often as the
   counts allow. What finds no exact complement goes best-fit into the open
   sequence with the smallest gap that holds it.
3. Each piece gets its rank among the pieces of its length, by counts per (length,
   bucket) and a window inside each, so a length that a third of all pieces has is
   spread over as many buckets as it needs. Rank and plan give the sequence.

Cases: a null text is an empty one (its piece is the end id alone); repeated rows
are pieces of their own; a null doc_id stays null; other columns are ignored; no
documents give no pieces.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from playstat.llm.pretokens import Memo, Runs
from playstat.llm.ragged import kept, slices, text_buffer
from playstat.llm.storage import materialise, table

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
END_ID = 0
BUCKET_ROWS = 50_000           # pieces of one (length, bucket) window, about

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


_TOGETHER = 500                # pre-tokens of one call


class WordTokenizer:
    """Ids of a vocabulary that lower-cases and drops white space, by pre-token."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.memo = Memo(None)

    def ids(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin."""
        runs = Runs(raw, off, fold_ascii_case=True, single_digits=True)
        if not len(runs):
            return np.empty(0, np.int64), np.zeros(len(off), np.int64)

        def make(where):
            made = [None] * len(where)
            texts = [raw[runs.start[i]:runs.end[i]].tobytes().decode() for i in where.tolist()]
            whole = runs.hard[where]
            for i in np.flatnonzero(whole).tolist():
                made[i] = self.library.encode(texts[i], add_special_tokens=False).ids
            # any other run is one pre-token: many of them are encoded as one text
            plain = np.flatnonzero(~whole).tolist()
            for at in range(0, len(plain), _TOGETHER):
                some = plain[at:at + _TOGETHER]
                done = self.library.encode(" ".join([texts[i] for i in some]), add_special_tokens=False)
                sizes = np.bincount(np.array(done.word_ids, np.int64), minlength=len(some))
                for i, ids in zip(some, np.split(np.array(done.ids, np.int64), np.cumsum(sizes)[:-1])):
                    made[i] = ids
            return made

        self.memo.make = make
        slots = self.memo.get(runs.hash, np.arange(len(runs)))
        values, size = self.memo.gather(slots)
        return values, np.concatenate(([0], np.cumsum(size)))[runs.first]


def cut(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID,
        with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids; ``with_ids`` adds the ids themselves."""
    def pieces(batches):
        memo = f"packing {vocabulary}"
        tokenizer = kept(memo, lambda: WordTokenizer(public_tokenizers.path(vocabulary)))
        for b in slices(batches, keeps=memo):
            raw, off = text_buffer(b.column("text"))
            ids, first = tokenizer.ids(raw, off)
            whole = np.insert(ids, first[1:], end_id).astype("<u4")
            first = first + np.arange(len(first))
            rows, parts = [], []
            for d, name in enumerate(b.column("doc_id").to_pylist()):
                own = whole[first[d]:first[d + 1]]
                for k, at in enumerate(range(0, len(own), capacity)):
                    part = own[at:at + capacity]
                    rows.append((name, k, at, len(part), zlib.crc32(part.tobytes())))
                    if with_ids:
                        parts.append(part.astype(np.int32))
            columns = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), *[pa.int64()] * 3))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(parts, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(pieces, _PIECE + (", ids array<int>" if with_ids else ""))


def _complement(gap: int, left: np.ndarray, most_parts: int) -> tuple[int, ...] | None:
    """At most ``most_parts`` (up to three) available lengths that sum to ``gap``, long ones first."""
    if most_parts > 0 and left[gap] > 0:
        return (gap,)

    def pair(total: int, most: int):
        a = np.arange(min(most, total - 1), (total - 1) // 2, -1)
        b = total - a
        fits = np.flatnonzero((left[a] > 0) & (left[b] > (a == b)))
        return (int(a[fits[0]]), int(b[fits[0]])) if len(fits) else None

    if most_parts < 2 or gap < 2:
        return None
    if two := pair(gap, gap):
        return two
    if most_parts < 3:
        return None
    for a in np.flatnonzero(left[:gap] > 0)[::-1].tolist():
        if 3 * a < gap:
            return None
        left[a] -= 1
        rest = pair(gap - a, a)
        left[a] += 1
        if rest:
            return (a, *rest)
    return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) that use up all counts.

    Exact triples can use up short pieces that best fit would need more, so the
    plans with complements of up to 3, 2, 1 and 0 parts compete; fewest sequences win."""
    made = [_plan(counts, capacity, parts) for parts in (3, 2, 1, 0)]
    return min(made, key=lambda x: sum(times for _, times in x))


def _plan(counts, capacity, most_parts):
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    made: list[tuple[tuple[int, ...], int]] = []
    single: list[tuple[int, int]] = []
    for length in range(capacity, 0, -1):
        while left[length] > 0:
            if length == capacity:
                found: tuple[int, ...] | None = ()
            else:
                left[length] -= 1
                found = _complement(capacity - length, left, most_parts)
                left[length] += 1
            if found is None:
                single.append((length, int(left[length])))
                left[length] = 0
                break
            use = Counter((length, *found))
            times = min(int(left[x]) // k for x, k in use.items())
            made.append(((length, *found), times))
            for x, k in use.items():
                left[x] -= k * times
    # best fit of the rest, longest first: open sequences by gap
    open_by_gap: dict[int, list[list]] = {}
    gaps = np.zeros(capacity + 1, np.int64)
    for length, n in single:
        while n:
            fit = np.flatnonzero(gaps[length:])
            gap = length + int(fit[0]) if len(fit) else capacity
            lengths, free = open_by_gap[gap].pop() if len(fit) else ((), n)
            # the gap that a piece leaves is the smallest for the next one of its length
            side = min(gap // length, n)
            times = min(n // side, free)
            if len(fit):
                gaps[gap] -= times
                if free > times:
                    open_by_gap[gap].append([lengths, free - times])
            n -= times * side
            rest = gap - side * length
            open_by_gap.setdefault(rest, []).append([(*lengths, *[length] * side), times])
            gaps[rest] += times
    return made + [(tuple(lengths), times) for group in open_by_gap.values() for lengths, times in group]


def _slots(made, capacity):
    """Per length: first rank of each slot, its first sequence and its offset."""
    used, by_length, sequence = Counter(), {}, 0
    for lengths, times in made:
        offset = 0
        for length in lengths:
            by_length.setdefault(length, []).append((used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return {length: np.array(rows, np.int64).T for length, rows in by_length.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32, ...) with sequence_id and offset."""
    pieces = materialise(pieces, "pieces")
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(_slots(plan(counts, capacity), capacity))
    buckets = max(1, -(-max(counts.values(), default=0) // BUCKET_ROWS))
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(buckets)))
    before = (bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
              .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n"))
              .drop("n"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (bucketed.withColumn("rank", F.row_number().over(order) - 1)
              .join(before, ["length", "bucket"])
              .withColumn("rank", F.col("rank") + F.col("before")).drop("before", "bucket"))
    columns = [c for c in ranked.columns if c != "rank"]

    def place(batches):
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False)
            rank = b.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length).tolist():
                mine = np.flatnonzero(length == x)
                first, base, at = slots.value[x]
                slot = np.searchsorted(first, rank[mine], "right") - 1
                sequence[mine] = base[slot] + rank[mine] - first[slot]
                offset[mine] = at[slot]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(sequence), pa.array(offset)],
                                             [*columns, "sequence_id", "offset"])

    schema = ranked.drop("rank").withColumn("sequence_id", F.lit(0).cast("long")) \
        .withColumn("offset", F.lit(0).cast("long")).schema
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY,
                   with_ids: bool = False) -> DataFrame:
    """Cut and pack ``docs``; ``with_ids`` keeps the ids of each piece."""
    return pack(cut(docs, vocabulary, capacity, with_ids=with_ids), capacity)


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Contract digest of all documents' pieces and their places."""
    return pack_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
