"""Benchmark decontamination: an FM-index for each shard of training text.

Every task cuts its documents into shards of bounded text. Words that cannot be
part of a phrase (no benchmark word triple, or shorter phrase, covers them) are
dropped from the shard, an FM-index is built over what is left, and all
benchmark windows are searched backwards through the ranks of its wavelet
matrix. Sampled suffix positions give the occurrences, whose words are merged to
removal spans.

The benchmark's distinct (window, item) pairs are a Spark table, dealt to parts of about
``CHUNK_WORDS`` words by a hash of the pair, so neither a long item nor a window of very
many items makes a large part. The driver holds one part at a time and broadcasts it. A
task runs one Python worker, which takes a shard through all parts, one part after the
other. Documents are never shuffled, so a hot source is no hot spot.

Cases: null or wordless texts have no words and no hits; a null benchmark text is
no item; an item with a null id marks words but is not listed; repeated
documents give a row each, repeated item ids count once; with no items nothing is
hit; other columns of either table are ignored and keep their values and names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playstat.llm.fm_index import FMIndex, ranges
from playstat.llm.ragged import NOT_ALNUM, Alphabet, Words, slices, text_buffer, windows
from playstat.llm.storage import materialise, release, table

WINDOW = 10                    # words of a benchmark window
CHUNK_WORDS = 2_000_000        # words of the windows that are broadcast at once
SHARD_BYTES = 2 << 20          # text of one FM-index
_FILTER_BITS = 20
_ALPHABET = Alphabet(NOT_ALNUM, fold_ascii_case=True)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Written distinct (item_id, words): word hashes of every window of an item, or of the
    whole item if it is shorter."""
    def run(batches):
        for b in slices(batches):
            words = Words(*text_buffer(b.column("text")), _ALPHABET)
            for k in np.flatnonzero(np.diff(words.first)).tolist():
                own = words.hash[words.first[k]:words.first[k + 1]].view(np.int64)
                rows = np.lib.stride_tricks.sliding_window_view(own, min(window, len(own)))
                for i in range(0, len(rows), 10_000):
                    some = rows[i:i + 10_000]
                    off = pa.array(np.arange(len(some) + 1) * some.shape[1], pa.int32())
                    item = pa.array([b.column("item_id")[k].as_py()] * len(some), pa.int64())
                    yield pa.RecordBatch.from_arrays([item, pa.ListArray.from_arrays(off, pa.array(some.ravel()))],
                                                     ["item_id", "words"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    return materialise(rows.mapInArrow(run, "item_id long, words array<long>").distinct(), "leak-windows")


class Phrases:
    """Benchmark windows as rows of word ids, with the items they come from."""

    def __init__(self, pairs: list):
        rows: dict[tuple, set] = {}
        for item, words in pairs:
            rows.setdefault(tuple(words), set()).add(item)
        flat = np.array([h for phrase in rows for h in phrase], np.int64).view(np.uint64)
        self.vocabulary, ids = np.unique(flat, return_inverse=True)
        cut = np.cumsum([len(phrase) for phrase in rows])[:-1]
        rows = dict(zip(map(tuple, np.split(ids.astype(np.int64) + 1, cut)), rows.values())) if rows else {}
        self.by_length = {}
        for phrase, owners in rows.items():
            self.by_length.setdefault(len(phrase), ([], []))
            self.by_length[len(phrase)][0].append(phrase)
            self.by_length[len(phrase)][1].append(sorted(x for x in owners if x is not None))
        self.by_length = {n: (np.array(p, np.int64), o) for n, (p, o) in self.by_length.items()}
        self.grams = {}
        for n, (p, _) in self.by_length.items():
            q = min(n, 3)
            seen = [windows(self.vocabulary[row - 1], q) for row in p]
            self.grams.setdefault(q, []).extend(seen)
        self.grams = {q: np.unique(np.concatenate(x)) for q, x in self.grams.items()}
        self.maybe = {}
        for q, known in self.grams.items():
            bits = np.zeros(1 << _FILTER_BITS, bool)
            bits[(known >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.maybe[q] = bits

    @property
    def n_symbols(self):
        return len(self.vocabulary) + 1

    def candidates(self, words: Words) -> np.ndarray:
        """Indices of words that some benchmark gram covers."""
        n = len(words)
        size = np.diff(words.first)
        last = np.repeat(words.first[1:], size)
        cover = np.zeros(n + 1, np.int32)
        for q, known in self.grams.items():
            h = windows(words.hash, q)
            i = np.flatnonzero(self.maybe[q][(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            i = i[i + q <= last[i]]
            at = np.minimum(np.searchsorted(known, h[i]), len(known) - 1)
            i = i[known[at] == h[i]]
            np.add.at(cover, i, 1)
            np.add.at(cover, i + q, -1)
        return np.flatnonzero(np.cumsum(cover[:n]) > 0)


class _Shard:
    """Slices of a task whose words share one index."""

    def __init__(self):
        self.batches, self.words, self.n_bytes = [], [], 0

    def add(self, batch: pa.RecordBatch):
        raw, off = text_buffer(batch.column("text"))
        self.batches.append(batch)
        self.words.append(Words(raw, off, _ALPHABET))
        self.n_bytes += len(raw)

    def occurrences(self, phrases: Phrases):
        """(first word, phrase length, item ids) of every occurrence of a phrase."""
        ids, places, before = [], [], 0
        for words in self.words:
            kept = phrases.candidates(words)
            document = np.searchsorted(words.first, kept, "right")
            of = np.searchsorted(phrases.vocabulary, words.hash[kept]) + 1
            split = np.flatnonzero((np.diff(kept) != 1) | (np.diff(document) != 0)) + 1
            split = np.concatenate(([0], split)) if len(kept) else split
            ids.append(np.insert(of, split, 0))
            places.append(np.insert(kept, split, 0) + before)
            before += len(words)
        text, at = np.concatenate(ids), np.concatenate(places)
        if not len(text):
            return
        index = FMIndex(text, phrases.n_symbols)
        for n, (rows, items) in phrases.by_length.items():
            found, low, high = index.search(rows)
            suffix, owner = ranges(low, high)
            yield at[index.locate(suffix)], n, found[owner], items

    def leaks(self, parts) -> Iterator[tuple[pa.RecordBatch, list, list, list]]:
        """Per slice: the slice, and for each document its number of words, the hit words as
        merged ranges (start, end, start, end, ...) and the ids of the items found."""
        sizes = np.cumsum([0] + [len(w) for w in self.words])
        firsts = np.concatenate([w.first[:-1] + n for w, n in zip(self.words, sizes)] + [sizes[-1:]])
        n_docs = len(firsts) - 1
        hits, items = [[] for _ in range(n_docs)], [set() for _ in range(n_docs)]
        cover = np.zeros(sizes[-1] + 1, np.int64)
        for phrases in parts:
            for first, n, phrase, names in self.occurrences(phrases):
                np.add.at(cover, first, 1)
                np.add.at(cover, first + n, -1)
                document = np.searchsorted(firsts, first, "right") - 1
                for d, p in np.unique(np.stack((document, phrase)), axis=1).T.tolist():
                    items[d].update(names[p])
        hit = np.cumsum(cover[:-1]) > 0
        total = np.concatenate(([0], np.cumsum(hit)))
        for d in np.flatnonzero(total[firsts[1:]] - total[firsts[:-1]]):
            own = np.concatenate(([0], hit[firsts[d]:firsts[d + 1]].astype(np.int8), [0]))
            hits[d] = np.flatnonzero(np.diff(own)).tolist()
        n_words, at = np.diff(firsts), 0
        for b in self.batches:
            own = slice(at, at + b.num_rows)
            at += b.num_rows
            yield b, n_words[own].tolist(), hits[own], [sorted(x) for x in items[own]]


class _Parts:
    """The broadcast parts of a benchmark, of which a worker holds one at a time."""

    def __init__(self, benchmark: DataFrame, window: int):
        windows = benchmark_windows(benchmark, window)
        n = max(1, -(-(windows.agg(F.sum(F.size("words")).alias("n")).first()["n"] or 0) // CHUNK_WORDS))
        part = F.pmod(F.xxhash64("words", "item_id"), F.lit(n))
        context = benchmark.sparkSession.sparkContext
        self.shared = [context.broadcast(Phrases([tuple(r) for r in windows.where(part == k).collect()]))
                       for k in range(n)]
        release(windows)

    def __iter__(self) -> Iterator[Phrases]:
        for b in self.shared:
            yield b.value
            if len(self.shared) > 1:
                b.__dict__.pop("_value", None)       # the worker's copy; the next use loads it again


def _search(batches, parts: _Parts, shard_bytes: int):
    """``_Shard.leaks`` of all slices of a task."""
    shard = _Shard()
    for piece in slices(batches):
        shard.add(piece)
        if shard.n_bytes >= shard_bytes:
            yield from shard.leaks(parts)
            shard = _Shard()
    if shard.batches:
        yield from shard.leaks(parts)


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: n_words, n_hit, item ids and the hit word ranges."""
    parts, size = _Parts(benchmark, window), SHARD_BYTES

    def run(batches):
        for b, n_words, hits, items in _search(batches, parts, size):
            n_hit = [sum(h[1::2]) - sum(h[::2]) for h in hits]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                 pa.array(items, pa.list_(pa.int64())), pa.array(hits, pa.list_(pa.int64()))],
                ["doc_id", "n_words", "n_hit", "items", "hits"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_hit long, items array<long>, hits array<long>")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without the words of benchmark windows.

    Keeps every column; ``text`` loses the bytes from the first to the last word
    of each merged span, and ``n_chars``, where present, follows it. Documents
    whose every word is hit are dropped."""
    columns, parts, size = docs.columns, _Parts(benchmark, window), SHARD_BYTES

    def clean(batches):
        for b, n_words, hits, _ in _search(batches, parts, size):
            texts, keep = b.column("text").to_pylist(), np.ones(b.num_rows, bool)
            for i in (i for i, x in enumerate(hits) if x):
                data, out, end = texts[i].encode(), [], 0
                words = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), _ALPHABET)
                for a, z in zip(hits[i][::2], hits[i][1::2]):
                    out.append(data[end:words.start[a]])
                    end = words.end[z - 1]
                texts[i] = (b"".join(out) + data[end:]).decode()
                keep[i] = hits[i] != [0, n_words[i]]
            new = {c: b.column(c) for c in columns}
            new["text"] = pa.array(texts, new["text"].type)
            if "n_chars" in new:
                new["n_chars"] = pa.array([None if t is None else len(t) for t in texts], new["n_chars"].type)
            yield pa.RecordBatch.from_arrays([new[c] for c in columns], columns).filter(pa.array(keep))

    return docs.mapInArrow(clean, docs.schema)


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contract digest of ``find_leaks`` over all documents and benchmark items."""
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


_LETTERS = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LETTERS}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w
           FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LETTERS}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
      FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') g, least(len(w), {WINDOW}) n
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) i FROM d, sizes)),
hits AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN bw USING (g, n)),
covered AS (SELECT doc_id, count(DISTINCT p) n_hit
            FROM (SELECT doc_id, unnest(range(i, i + n)) p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item_id) n_items,
                 sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) h
          FROM hits GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items,
       coalesce(items.h, sha256('')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
