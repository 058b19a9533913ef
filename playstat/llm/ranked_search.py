"""Ranked lexical search with range-maximum sparse tables.

The corpus is searched in shards of bounded text. A shard holds, for the terms that some
item asks for, one posting list each: documents in ascending doc_id, with the term's
impact (its share of a score) in each. A sparse table over the lists answers in two
look-ups where the largest impact of a list lies between any two documents.

An item starts with the interval of all documents of the shard. The sum of its terms'
range maxima bounds every score in an interval. The intervals of the largest bounds are
taken first, each is split at the document of its largest single impact, that document is
scored, and the two remaining intervals are bounded anew. It ends when no bound beats the
item's k-th best document so far (equal scores: smaller doc_id first), which a task carries
from shard to shard. Results are exact.

A first scan counts documents, their terms and, for each asked term, the documents that
hold it. Items go to the tasks in parts of about ``PART_TERMS`` distinct terms each (an
item is not divided), so a larger benchmark costs more scans and never lies on the driver
whole. Documents are not shuffled; a task returns at most k rows an item.

Cases: null and termless texts have no terms, are not counted and never found; an item
without terms or without matching documents has no rows; repeated benchmark rows count
once, different texts of one item_id add up, a null item_id is an id like any other;
repeated documents are documents of their own (a rank each); a null doc_id ranks behind
others of its score; empty tables give an empty result; other columns are ignored. Terms
are compared by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playstat.llm.ragged import NOT_ALNUM, Alphabet, Words, slices, text_buffer
from playstat.llm.storage import materialise, release, table

TOP = 10
LENGTH_PERCENT = 75            # how much of a document's length counts
SHARD_BYTES = 8 << 20          # text of one shard
PART_TERMS = 1_000_000         # (item, term) pairs that are broadcast at once
BATCH = 128                     # intervals of an item that are split together
_ALPHABET = Alphabet(NOT_ALNUM, fold_ascii_case=True)
_FILTER_BITS = 20
_LAST = np.iinfo(np.int64).max


def _words(batch: pa.RecordBatch, text: str = "text") -> Words:
    return Words(*text_buffer(batch.column(text)), _ALPHABET)


def item_terms(items: DataFrame) -> DataFrame:
    """Written (item_id, term, n): occurrences of each term (its hash) in an item."""
    def run(batches):
        for b in slices(batches):
            words = _words(b)
            text = np.repeat(np.arange(b.num_rows), np.diff(words.first))
            pair, n = np.unique(np.stack((text.astype(np.uint64), words.hash)), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [b.column("item_id").take(pa.array(pair[0].astype(np.int64))), pa.array(pair[1].view(np.int64)),
                 pa.array(n)], ["item_id", "term", "n"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    return materialise(rows.mapInArrow(run, "item_id long, term long, n long")
                       .groupBy("item_id", "term").agg(F.sum("n").alias("n")), "search-items")


class Queries:
    """The items of a part: their ids, and per item its terms (numbers in ``vocabulary``)
    with how often it has each."""

    def __init__(self, rows: list):
        self.vocabulary, term = np.unique(np.array([r["term"] for r in rows], np.int64).view(np.uint64),
                                          return_inverse=True)
        ids = [r["item_id"] for r in rows]
        self.items = sorted(set(ids), key=lambda x: (x is None, x or 0))
        place = {x: k for k, x in enumerate(self.items)}
        item = np.array([place[x] for x in ids], np.int64)
        times = np.array([r["n"] for r in rows], np.int64)
        order = np.argsort(item, kind="stable")
        cut = np.searchsorted(item[order], np.arange(len(self.items) + 1))
        self.terms = [term[order[a:b]] for a, b in zip(cut, cut[1:])]
        self.times = [times[order[a:b]] for a, b in zip(cut, cut[1:])]
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[(self.vocabulary >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def postings(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term number, occurrences) of asked terms, by text and term."""
        at = np.flatnonzero(self.maybe[(words.hash >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        term = np.minimum(np.searchsorted(self.vocabulary, words.hash[at]), len(self.vocabulary) - 1)
        known = self.vocabulary[term] == words.hash[at]
        at, term = at[known], term[known]
        text = np.searchsorted(words.first, at, "right") - 1
        key, n = np.unique(text * len(self.vocabulary) + term, return_counts=True)
        return key // len(self.vocabulary), key % len(self.vocabulary), n


class Statistics:
    """Documents with a term, all their terms, and the weight of each asked term."""

    def __init__(self, documents: int, terms: int, holders: np.ndarray):
        self.documents, self.terms = documents, terms
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(h) + 1))) for h in holders],
                               np.int64)

    def impact(self, term: np.ndarray, occurrences: np.ndarray, length: np.ndarray) -> np.ndarray:
        m = 100 - LENGTH_PERCENT + (LENGTH_PERCENT * length * self.documents) // self.terms
        return self.weight[term] * ((1_000_000_000 * occurrences) // (1000 * occurrences + 8 * m))


def statistics(docs: DataFrame, queries) -> Statistics:
    """One scan; a task returns a row per asked term that it holds, and two totals."""
    def run(batches):
        known = queries.value
        holders = np.zeros(len(known.vocabulary) + 2, np.int64)
        for b in slices(batches):
            words = _words(b)
            holders[:-2] += np.bincount(known.postings(words)[1], minlength=len(known.vocabulary))
            holders[-2:] += (int((np.diff(words.first) > 0).sum()), len(words))
        seen = np.flatnonzero(holders)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(holders[seen])], ["term", "n"])

    rows = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    holders = np.zeros(len(queries.value.vocabulary) + 2, np.int64)
    for r in rows:
        holders[r["term"]] = r["n"]
    return Statistics(int(holders[-2]), int(holders[-1]), holders[:-2])


class RangeMaximum:
    """Sparse table over the posting lists of a shard, laid end to end."""

    def __init__(self, impact: np.ndarray, longest: int):
        self.impact = impact
        self.levels = [np.arange(len(impact), dtype=np.int32)]
        width = 1
        while 2 * width <= longest:
            low = self.levels[-1]
            a, b = low[:-width], low[width:]
            own = low.copy()
            own[:len(a)] = np.where(impact[a] >= impact[b], a, b)       # the first of equal ones
            self.levels.append(own)
            width *= 2
        self.table = np.stack(self.levels)
        self.log = np.zeros(longest + 2, np.int64)
        self.log[1:] = np.frexp(np.arange(1, longest + 2))[1] - 1

    def where(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Place of the largest impact of [low, high), which is not empty."""
        level = self.log[high - low]
        a, b = self.table[level, low], self.table[level, high - (1 << level)]
        return np.where(self.impact[a] >= self.impact[b], a, b)


class Best:
    """The k best documents of an item so far."""

    def __init__(self, k: int):
        self.k, self.score, self.doc = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, score: np.ndarray, doc: np.ndarray):
        score, doc = np.concatenate((self.score, score)), np.concatenate((self.doc, doc))
        order = np.lexsort((doc, -score))[:self.k]
        order = order[score[order] > 0]
        self.score, self.doc = score[order], doc[order]

    def beaten_by(self, bound: np.ndarray, first_doc: np.ndarray) -> np.ndarray:
        """Which intervals may hold one of the k best."""
        if len(self.score) < self.k:
            return bound > 0
        return (bound > self.score[-1]) | ((bound == self.score[-1]) & (first_doc < self.doc[-1]))


class Shard:
    """Posting lists of the asked terms over some documents, in the order of their ids."""

    def __init__(self, docs: np.ndarray, text: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        order = np.argsort(docs, kind="stable")
        self.docs, self.n = docs[order], len(docs)
        place = np.empty(self.n, np.int64)
        place[order] = np.arange(self.n)
        key = term * (self.n + 1) + place[text]
        order = np.argsort(key)
        self.key, self.impact = key[order], impact[order]
        self.doc = self.key % (self.n + 1)
        sizes = np.bincount(term, minlength=n_terms)
        self.present = sizes > 0
        self.maximum = RangeMaximum(self.impact, max(1, int(sizes.max()))) if len(key) else None

    def _bounded(self, times, low, high, begin, end):
        """The intervals [low, high) with the part [begin, end) of each posting list in them,
        the sum of the parts' maxima, and the document of the largest one."""
        some = begin < end
        at = self.maximum.where(np.where(some, begin, 0), np.where(some, end, 1))
        part = np.where(some, self.impact[at] * times, 0)
        most = part.argmax(axis=1)
        return [low, high, begin, end, part.sum(axis=1), self.doc[at[np.arange(len(low)), most]]]

    def search(self, terms: np.ndarray, times: np.ndarray, best: Best):
        """Adds the shard's documents that belong to the item's best."""
        known = self.present[terms]
        base, times = terms[known] * (self.n + 1), times[known]
        if not len(base):
            return
        ends = np.searchsorted(self.key, np.stack((base, base + self.n)))
        open_ = self._bounded(times, np.zeros(1, np.int64), np.full(1, self.n), ends[:1], ends[1:])
        while True:
            keep = np.flatnonzero(best.beaten_by(open_[4], self.docs[open_[0]]))
            if not len(keep):
                return
            keep = keep[np.lexsort((open_[0][keep], -open_[4][keep]))]
            low, high, begin, end, _, at = (x[keep[:BATCH]] for x in open_)
            middle = np.searchsorted(self.key, (base[:, None] + at).ravel()).reshape(len(base), -1).T
            held = middle < end
            held[held] = self.doc[middle[held]] == np.broadcast_to(at[:, None], held.shape)[held]
            best.add(np.where(held, self.impact[np.where(held, middle, 0)] * times, 0).sum(axis=1), self.docs[at])
            left, right = low < at, at + 1 < high
            fresh = self._bounded(times, *(np.concatenate((x[left], y[right])) for x, y in (
                (low, at + 1), (at, high), (begin, middle + held), (middle, end))))
            open_ = [np.concatenate((x[keep[BATCH:]], y)) for x, y in zip(open_, fresh)]


def _search_part(docs: DataFrame, known: Queries, top: int) -> DataFrame:
    """(item_id, doc_id, score): the best of every task."""
    spark = docs.sparkSession
    queries = spark.sparkContext.broadcast(known)
    numbers = spark.sparkContext.broadcast(statistics(docs, queries))

    def run(batches):
        asked, stats = queries.value, numbers.value
        best = [Best(top) for _ in asked.items]
        held = []

        def search():
            docs, sizes = np.concatenate([h[0] for h in held]), np.cumsum([0] + [len(h[0]) for h in held])
            text = np.concatenate([h[1] + s for h, s in zip(held, sizes)])
            shard = Shard(docs, text, *(np.concatenate([h[k] for h in held]) for k in (2, 3)), len(asked.vocabulary))
            for own, terms, times in zip(best, asked.terms, asked.times):
                shard.search(terms, times, own)

        size = 0
        for b in slices(batches):
            words = _words(b)
            text, term, n = asked.postings(words)
            impact = stats.impact(term, n, np.diff(words.first)[text]) if len(text) else np.empty(0, np.int64)
            some = impact > 0
            held.append((b.column("doc_id").fill_null(_LAST).to_numpy(zero_copy_only=False), text[some], term[some],
                         impact[some]))
            size += b.column("text").nbytes
            if size >= SHARD_BYTES:
                search()
                held, size = [], 0
        if held:
            search()
        for own, item in zip(best, asked.items):
            if len(own.score):
                doc = pa.array(own.doc, mask=own.doc == _LAST)
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(doc), pa.int64()), doc, pa.array(own.score)],
                                                 ["item_id", "doc_id", "score"])

    return docs.mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` documents of every item: item_id, rank, doc_id, score."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = item_terms(items)
    parts = max(1, -(-asked.count() // PART_TERMS))
    found = []
    for part in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()   # PART_TERMS, about
        if rows:
            found.append(_search_part(docs, Queries(rows), top))
    release(asked)
    if not found:
        return docs.select(F.col("doc_id").alias("item_id"), F.lit(1).alias("rank"), "doc_id",
                           F.lit(0).cast("long").alias("score")).limit(0)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("item_id", "rank", "doc_id", "score"))


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () id, doc_id, regexp_extract_all({_LOWER}, '{_TERM}') w
           FROM documents WHERE text IS NOT NULL),
size AS (SELECT id, doc_id, len(w)::BIGINT n FROM d WHERE len(w) > 0),
total AS (SELECT count(*)::BIGINT docs, sum(n)::BIGINT terms FROM size),
q AS (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) term
      FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
qt AS (SELECT item_id, term, count(*)::BIGINT times FROM q GROUP BY ALL),
tf AS (SELECT id, term, count(*)::BIGINT tf FROM (SELECT id, unnest(w) term FROM d)
       WHERE term IN (SELECT term FROM q) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT w
           FROM tf, total GROUP BY term),
impact AS (SELECT id, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * ({100 - LENGTH_PERCENT}
                  + ({LENGTH_PERCENT} * n * docs) // terms))) i
           FROM tf JOIN weight USING (term) JOIN size USING (id), total),
scores AS (SELECT item_id, id, doc_id, sum(times * i)::BIGINT score FROM impact JOIN qt USING (term) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) <= {TOP}
"""
