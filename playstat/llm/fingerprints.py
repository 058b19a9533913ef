"""Document fingerprints: improbable features in chained Bloom filters.

Every window of ``WIDTH`` bytes has an entropy. A histogram of all windows of the corpus
ranks the entropies by how improbable they are; near-constant windows rank last. In every
run of ``RUN`` neighbouring windows the most improbable one (the first, among equals) is
marked, and the windows that ``VOTES`` runs or more mark are the text's features: distinct
ones, in text order. Each sets five bits of a 2,048-bit Bloom filter, and after
``PER_FILTER`` features the next filter of the chain begins.

Likeness of two chains: each filter of the shorter chain (both ways, if equally long) takes
its best partner of the other one, by the bits that they share beyond what chance would
share, normalised by what the smaller of them could share; the mean of these is weighted by
features. Equal chains give 1; a chain without features is like nothing but its equal.

Texts are range-partitioned by doc_id once, so a document meets the next one in its own
task; the last text of each partition and the first of each are set aside and joined. All
work inside a task goes over slices of numpy bytes.

Cases: a null text is empty; a text shorter than a window is one feature; an empty text
has none; a text whose run is cut short by its length marks one window; a text without any
feature by votes takes its best window. Documents follow each other by doc_id (null first),
equal ids by md5 of the text; the last is followed by the first, a single one by itself;
repeated rows give a row each; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playstat.llm.ragged import _MUL, _POWERS, mix, slices, text_buffer
from playstat.llm.storage import materialise, table

WIDTH = 32                     # bytes of a window
RUN = 32                       # neighbouring windows of which one is marked
VOTES = 8                      # runs that have to mark a feature
LEVELS = 1000                  # entropy levels that are ranked
WEAK = 0.15                    # share of the largest entropy below which a window ranks last
BITS, PER_FILTER, HASHES = 2048, 160, 5
CUTOFF = 0.3                   # share of the possible overlap that counts as chance
SLICE = 1 << 18                # text bytes held in numpy form at a time
_PAIRS = 1 << 13               # filter pairs compared at a time
_SCALE = 1 << 20
_U = np.uint64
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _MUL)
# c log2 c in whole units, so that a sliding sum is exact
_TERM = np.array([0] + [round(c * np.log2(c) * _SCALE) for c in range(1, WIDTH + 1)], np.int64)
_MOST = int(_TERM[WIDTH])


def levels(data: np.ndarray) -> np.ndarray:
    """Entropy level of every window of the bytes, from 0 (one byte only) to LEVELS - 1."""
    n = len(data) - WIDTH + 1
    if n <= 0:
        return np.empty(0, np.int64)
    before = np.zeros(len(data), np.uint8)          # equal bytes among the WIDTH - 1 before
    after = np.zeros(len(data), np.uint8)
    for d in range(1, WIDTH):
        same = (data[:-d] == data[d:]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    step = _TERM[1:] - _TERM[:-1]
    head = np.bincount(data[:WIDTH], minlength=256)
    total = np.empty(n, np.int64)
    total[0] = _TERM[head].sum()
    # leaving byte: its equals among the rest of the window; entering byte likewise
    total[1:] = step[before[WIDTH:]] - step[after[:n - 1]]
    np.cumsum(total, out=total)
    return (_MOST - total) * (LEVELS - 1) // _MOST


def _inside(off: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which starts of ``width`` bytes lie in one text (n of them)."""
    ok = np.zeros(n + 1, np.int32)
    first, stop = off[:-1], np.maximum(off[:-1], off[1:] - width + 1)
    np.add.at(ok, first[first < stop], 1)
    np.add.at(ok, stop[first < stop], -1)
    return np.cumsum(ok[:n]) > 0


def ranks(docs: DataFrame):
    """Broadcast rank of each entropy level: 0 for the most improbable one."""
    def count(batches):
        total = np.zeros(LEVELS, np.int64)
        for b in slices(batches, limit=SLICE):
            raw, off = text_buffer(b.column("text"))
            at = levels(raw)
            total += np.bincount(at[_inside(off, len(at), WIDTH)], minlength=LEVELS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["level", "n"])

    rows = docs.select("text").mapInArrow(count, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(LEVELS, np.int64)
    for r in rows:
        counts[r["level"]] = r["n"]
    weak = np.arange(LEVELS) < WEAK * LEVELS
    order = np.lexsort((np.arange(LEVELS), counts, weak))       # ties to the lower level
    rank = np.empty(LEVELS, np.int64)
    rank[order] = np.arange(LEVELS)
    return docs.sparkSession.sparkContext.broadcast(rank)


def _features(data: np.ndarray, off: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the features of all texts, in text order."""
    size = np.diff(off)
    text, at = [], []
    whole = np.flatnonzero((size > 0) & (size < WIDTH))
    width = np.full(len(data) + 1, WIDTH, np.int64)
    width[off[whole]] = size[whole]
    text.append(whole)
    at.append(off[whole])
    level = levels(data)
    n = len(level)
    long = np.flatnonzero(size >= WIDTH)
    if len(long):
        key = (rank[level] << 40) | np.arange(n)
        low, w = key, 1                              # smallest key of RUN windows
        while 2 * w <= RUN:
            low, w = np.minimum(low[:-w], low[w:]) if len(low) > w else low[:0], 2 * w
        runs = low[_inside(off, len(low), RUN + WIDTH - 1)] & ((1 << 40) - 1)
        votes = np.bincount(runs, minlength=n)
        of = np.repeat(np.arange(len(size)), size)[:n]
        chosen = np.flatnonzero(votes >= VOTES)
        some = np.zeros(len(size), bool)
        some[of[chosen]] = True
        # texts without a run or without a feature: their best window
        rest = long[~some[long]]
        if len(rest):
            best = [int(key[off[i]:off[i + 1] - WIDTH + 1].min()) & ((1 << 40) - 1) for i in rest]
            chosen = np.sort(np.concatenate((chosen, best)))
        text.append(of[chosen])
        at.append(chosen)
    text, at = np.concatenate(text), np.concatenate(at)
    order = np.argsort(at, kind="stable")
    text, at = text[order], at[order]
    up, down = _POWERS.upto(max(1, len(data)))
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_VALUE[data] * up[:len(data)], out=total[1:])
    h = mix((total[at + width[at]] - total[at]) * down[at] + width[at].astype(_U) * _MUL)
    first = np.sort(np.unique(np.stack((text.astype(_U), h)), axis=1, return_index=True)[1])
    return text[first], h[first]


class Chains:
    """Bloom filters of several texts: ``bits`` (rows of 32 words of 64 bits), how many
    features and bits each has, and the first filter of each text."""

    def __init__(self, data: np.ndarray, off: np.ndarray, rank: np.ndarray):
        n = len(off) - 1
        text, h = _features(data, off, rank)
        size = np.bincount(text, minlength=n)
        filters = -(-size // PER_FILTER)
        self.first = np.concatenate(([0], np.cumsum(filters)))
        place = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
        row = self.first[text] + place // PER_FILTER
        flat = np.zeros((self.first[-1], BITS), bool)
        for k in range(HASHES):
            flat[row, ((h >> _U(11 * k)) & _U(BITS - 1)).astype(np.int64)] = True
        self.features = np.bincount(row, minlength=self.first[-1])
        self.ones = flat.sum(axis=1)
        self.packed = np.packbits(flat, axis=1)
        self.bits = self.packed.view(np.uint64)

    def raw(self, i: int) -> bytes:
        """The chain of a text: per filter a byte with its features, then its bits."""
        own = slice(self.first[i], self.first[i + 1])
        return np.concatenate((self.features[own, None].astype(np.uint8), self.packed[own]), axis=1).tobytes()


def as_text(raw: bytes) -> str:
    size = BITS // 8 + 1
    return ",".join(f"{raw[i]}:{raw[i + 1:i + size].hex()}" for i in range(0, len(raw), size))


def _overlap(a: Chains, i: np.ndarray, b: Chains, j: np.ndarray) -> np.ndarray:
    """Normalised overlap of filters i of ``a`` with filters j of ``b``."""
    shared = np.bitwise_count(a.bits[i] & b.bits[j]).sum(axis=1).astype(np.float64)
    x, y = a.ones[i].astype(np.float64), b.ones[j].astype(np.float64)
    chance, most = x * y / BITS, np.minimum(x, y)
    floor = chance + CUTOFF * (most - chance)
    return np.where(shared > floor, (shared - floor) / np.maximum(most - floor, 1e-9), 0.0)


def likeness(a: Chains, i: np.ndarray, b: Chains, j: np.ndarray) -> np.ndarray:
    """Of texts i of ``a`` to texts j of ``b``, 0 to 1."""
    na, nb = a.first[i + 1] - a.first[i], b.first[j + 1] - b.first[j]
    best = [np.zeros(int(n.sum())) for n in (na, nb)]
    start = [np.concatenate(([0], np.cumsum(n))) for n in (na, nb)]
    rows = np.repeat(np.arange(len(i)), na)                       # a row of filter pairs per filter of a
    mine = np.arange(start[0][-1]) - start[0][rows]
    width = nb[rows]
    stop = np.cumsum(width)
    done = 0
    while done < len(rows):
        upto = max(done + 1, int(np.searchsorted(stop, (stop[done - 1] if done else 0) + _PAIRS, "right")))
        own = np.repeat(np.arange(done, upto), width[done:upto])
        other = np.arange(len(own)) - np.repeat(np.cumsum(width[done:upto]) - width[done:upto], width[done:upto])
        pair = rows[own]
        x = _overlap(a, a.first[i[pair]] + mine[own], b, b.first[j[pair]] + other)
        np.maximum.at(best[0], own, x)
        np.maximum.at(best[1], start[1][pair] + other, x)
        done = upto

    def mean(chains, texts, n, got, begin):
        of = np.repeat(np.arange(len(texts)), n)
        weight = chains.features[chains.first[texts[of]] + np.arange(len(of)) - begin[of]].astype(np.float64)
        return np.bincount(of, weight * got, len(texts)) / np.maximum(np.bincount(of, weight, len(texts)), 1)

    to, back = mean(a, i, na, best[0], start[0]), mean(b, j, nb, best[1], start[1])
    made = np.where(na < nb, to, np.where(nb < na, back, (to + back) / 2))
    made = np.where((na == 0) | (nb == 0), (na == nb).astype(np.float64), made)
    return np.clip(np.where(_equal(a, i, b, j), 1.0, made), 0.0, 1.0)


def _equal(a: Chains, i: np.ndarray, b: Chains, j: np.ndarray) -> np.ndarray:
    same = a.first[i + 1] - a.first[i] == b.first[j + 1] - b.first[j]
    for k in np.flatnonzero(same):
        x, y = slice(a.first[i[k]], a.first[i[k] + 1]), slice(b.first[j[k]], b.first[j[k] + 1])
        same[k] = np.array_equal(a.packed[x], b.packed[y]) and np.array_equal(a.features[x], b.features[y])
    return same


def _buffer(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return text_buffer(pa.array(texts, pa.large_string()))


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the beginning of the following one."""
    quarter = len(text) // 4
    return text[:len(text) - quarter] + following[:quarter]


DIGEST = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")
_PACKED = "doc_id long, n_chars long, edited_sha256 string, chains binary, size int, near_edited double, near_next double"
_NAMES = [c.split()[0] for c in _PACKED.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.float64(), pa.float64()]


def _digests(ids: list, texts: list[str], follow: list[int], rank: np.ndarray) -> list[list]:
    """Columns of _PACKED for texts 0.. of ``ids``; ``follow`` gives each one's next text.

    Both chains of a text are packed together: three quarters of them are alike."""
    made = [edited(texts[i], texts[k]) for i, k in enumerate(follow)]
    own, new = Chains(*_buffer(texts), rank), Chains(*_buffer(made), rank)
    i, k = np.arange(len(follow)), np.array(follow, np.int64)
    pack = zstandard.ZstdCompressor(level=3)
    return [ids, [len(texts[x]) for x in i], [hashlib.sha256(t.encode()).hexdigest() for t in made],
            [pack.compress(own.raw(x) + new.raw(x)) for x in i], [len(own.raw(x)) for x in i],
            likeness(own, i, new, i).tolist(), likeness(own, i, own, k).tolist()]


def _unpacked(batches):
    """Rows of _PACKED as rows of DIGEST."""
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        for piece in (b.slice(i, 1000) for i in range(0, b.num_rows, 1000)):
            of = dict(zip(_NAMES, piece.columns))
            raw = [(unpack.decompress(x), n) for x, n in zip(of["chains"].to_pylist(), of["size"].to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [of["doc_id"], of["n_chars"], of["edited_sha256"], pa.array([as_text(x[:n]) for x, n in raw], pa.string()),
                 pa.array([as_text(x[n:]) for x, n in raw], pa.string()), of["near_edited"], of["near_next"]],
                [c.split()[0] for c in DIGEST.split(", ")])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document the columns of DIGEST, for all documents."""
    shared = ranks(docs.select("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["doc_id", "tie"]
    dealt = rows.withColumn("tie", F.md5("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    schema, limit = f"{_PACKED}, part int, edge string, text string", SLICE

    def run(batches):
        rank, part = shared.value, TaskContext.get().partitionId()

        def record(columns, edge=None, texts=None):
            n = len(columns[0])
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, _TYPES)]
                + [pa.array([part] * n, pa.int32()), pa.array([edge] * n, pa.string()),
                   pa.array(texts or [None] * n, pa.string())], [*_NAMES, "part", "edge", "text"])

        waiting = None
        for b in slices(batches, limit=limit):
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            if waiting is None:
                yield record([[ids[0]], *[[None]] * 6], "first", [texts[0]])
            else:
                ids, texts = [waiting[0], *ids], [waiting[1], *texts]
            waiting = ids[-1], texts[-1]
            if len(ids) > 1:
                yield record(_digests(ids[:-1], texts, list(range(1, len(ids))), rank))
        if waiting is not None:
            yield record([[waiting[0]], *[[None]] * 6], "last", [waiting[1]])

    made = materialise(dealt.mapInArrow(run, schema), "fingerprints")
    # two texts a partition are left: each last one meets the next partition's first
    first = made.where("edge = 'first'").select(F.col("part").alias("at"), F.col("text").alias("following"))
    numbers = first.select("at")
    after = numbers.withColumn("part", F.lag("at").over(Window.orderBy("at")))       # a row per partition
    ends = numbers.agg(F.min("at").alias("at"), F.max("at").alias("part"))           # the first follows the last
    after = after.where("part IS NOT NULL").unionByName(ends.where("at IS NOT NULL"))
    pairs = (made.where("edge = 'last'").select("doc_id", "text", "part")
             .join(after, "part").join(first, "at").select("doc_id", "text", "following"))

    def meet(batches):
        rank = shared.value
        for b in batches:
            for r in b.to_pylist():
                columns = _digests([r["doc_id"]], [r["text"], r["following"]], [1], rank)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)

    return (made.where("edge IS NULL").select(*_NAMES).unionByName(pairs.mapInArrow(meet, _PACKED))
            .mapInArrow(_unpacked, DIGEST))


def op12_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
