"""Substring dedup: suffix automata of reference shards.

A span of ``WINDOW`` words is removed from a document if the same words stand in a
document with a smaller id. The automata would be as large as the corpus if they
held all of it, so what can't matter is ruled out first, by hashes:

1. Texts of the same words are one text; all but the smallest id lose everything
   (if they have a window at all).
2. The anchor of a window is the smallest hash of its ``GRAM``-word runs, so equal
   windows have equal anchors, and neighbouring windows mostly share theirs. Only
   anchors of two or more documents go on.
3. Windows with such an anchor are grouped by their own hash; the smallest document
   that has one is the reference of all others.

The reference passages, in blocks of ``BLOCK`` windows, are dealt to shards of about
``SHARD_WORDS`` words. Each shard's automaton is built from its passages, and the
candidate passages that refer to it are streamed through: matching statistics of at
least ``WINDOW`` give the maximal spans to remove. Words are compared as they are, so
hashes only choose candidates. A shard to which very many passages refer goes to
several places, each with the automaton (its size is bounded) and a share of the
passages. No automaton holds more than its shard, nothing is collected.

Cases: a null text has no words; texts of fewer than ``WINDOW`` words stay whole; of
repeated rows of one doc_id none is smaller than the other; rows without doc_id
neither lose words nor are references; no documents give no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playstat.llm.membership import anti_join, semi_join
from playstat.llm.pretokens import ragged_index
from playstat.llm.ragged import SLICE_BYTES, WHITE, Alphabet, Words, mix, slices, text_buffer, windows
from playstat.llm.storage import materialise, release, table
from playstat.llm.suffix_automaton import SuffixAutomaton

WINDOW = 50
GRAM = 25                      # words of the runs that anchors are chosen from
BLOCK = 64                     # reference windows of a block
BLOCKS = 16                    # neighbouring blocks that stay in one shard
SHARD_WORDS = 50_000           # reference words of an automaton, about
PLACE_WORDS = 500_000          # words that are streamed through it in one place, about
_ALPHABET = Alphabet(WHITE, fold_ascii_case=False)
_U = np.uint64
_TAG = (1 << 31) - 1


def _sequence_hash(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's word sequence."""
    size = np.diff(first)
    place = ragged_index(np.zeros(len(size), np.int64), size).astype(_U)
    made = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        total = np.concatenate((np.zeros(1, _U), np.cumsum(mix(h + place * _U(salt)))))
        made.append(mix(total[first[1:]] - total[first[:-1]] + size.astype(_U)))
    return made[0], made[1]


def anchors(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """Smallest gram hash of the window that begins at each word (none, if shorter)."""
    if len(h) < window:
        return np.empty(0, np.uint64)
    low, width, want = windows(h, gram), 1, window - gram + 1
    while 2 * width <= want:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    more = want - width
    return np.minimum(low[:len(low) - more], low[more:]) if more else low


def _texts(batches):
    """Per slice: ids, tags, words, and per text its word sequence hash."""
    for b in slices(batches):
        raw, off = text_buffer(b.column("text"))
        words = Words(raw, off, _ALPHABET)
        one, two = _sequence_hash(words.hash, words.first)
        yield b, raw, off, words, one, two


def _tag(one) -> np.ndarray:
    """Tells apart the texts of rows that share a doc_id."""
    return (one & _U(_TAG)).astype(np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Written (doc_id, n_words, one, two, tag, sha): of the whole text."""
    def run(batches):
        for b, raw, off, words, one, two in _texts(batches):
            data = raw.tobytes()
            sha = [hashlib.sha256(b" ".join(data[x:y].split())).hexdigest() for x, y in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(words.first)), pa.array(one.view(np.int64)),
                 pa.array(two.view(np.int64)), pa.array(_tag(one)), pa.array(sha)],
                ["doc_id", "n_words", "one", "two", "tag", "sha"])

    return materialise(docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_words long, one long, two long, tag long, sha string"), "dedup-texts")


def _shared_anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, anchors): of each document those that another one has too."""
    def emit(batches):
        for b, raw, off, words, *_ in _texts(batches):
            low = anchors(words.hash)
            size = np.diff(words.first)
            last = np.repeat(words.first[1:], size)[:len(low)]
            doc = np.repeat(np.arange(len(size)), size)[:len(low)]
            i = np.flatnonzero(np.arange(len(low)) + WINDOW <= last)
            if not len(i):
                continue
            new = np.concatenate(([True], (low[i][1:] != low[i][:-1]) | (doc[i][1:] != doc[i][:-1])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc[i][new])),
                                              pa.array(low[i][new].view(np.int64))], ["doc_id", "anchor"])

    rows = materialise(docs.select("doc_id", "text").mapInArrow(_gathered(emit), "doc_id long, anchor long"), "dedup-grams")
    several = rows.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    several = materialise(several.select("anchor"), "dedup-several")
    shared = rows.join(several, "anchor", "left_semi")
    found = materialise(shared.groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors")), "dedup-anchors")
    release(rows, several)
    return found


def _hits(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """Windows whose words begin in a smaller document too: (doc_id, place, ref, ref_place).

    A place is the window's first word, with the tag of its text above bit 32."""
    def emit(batches):
        for b, raw, off, words, one, _ in _texts(batches):
            low, full = anchors(words.hash), windows(words.hash, WINDOW)
            tag, known = _tag(one), b.column("anchors").to_pylist()
            for d in range(b.num_rows):
                x, y = int(words.first[d]), int(words.first[d + 1]) - WINDOW + 1
                if y <= x:
                    continue
                i = np.flatnonzero(np.isin(low[x:y], np.array(known[d], np.int64).view(_U)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full[x:y][i].view(np.int64)), pa.array(np.full(len(i), b.column("doc_id")[d].as_py(), np.int64)),
                     pa.array(i + (int(tag[d]) << 32))], ["window", "doc_id", "place"])

    rows = materialise(
        semi_join(docs.select("doc_id", "text"), shared.select("doc_id")).join(shared, "doc_id")
        .select("doc_id", "text", "anchors").mapInArrow(_gathered(emit), "window long, doc_id long, place long"),
        "dedup-windows")
    # the first place of a window is a partial aggregate, so a window that very many
    # documents have meets its reference in a join that Spark can split
    first = rows.groupBy("window").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.max("doc_id").alias("last")) \
        .where("first.doc_id < last") \
        .select("window", F.col("first.doc_id").alias("ref"), F.col("first.place").alias("ref_place"))
    first = materialise(first, "dedup-first")
    found = materialise(rows.join(first, "window").where("doc_id > ref")
                        .select("doc_id", "place", "ref", "ref_place"), "dedup-hits")
    release(rows, first)
    return found


def _gathered(emit, rows: int = 20_000):
    """``emit`` with its small batches put together."""
    def run(batches):
        held, size = [], 0
        for b in emit(batches):
            held.append(b)
            size += b.num_rows
            if size >= rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
        if size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    return run


def _segments(hits: DataFrame, shard) -> DataFrame:
    """Runs of neighbouring windows that refer to neighbouring windows of one shard:
    (doc_id, place, n windows, shard)."""
    def run(batches):
        held = None                            # doc_id, place, ref, ref_place, n, shard
        for b in batches:
            if not b.num_rows:
                continue
            doc, place, ref, ref_place, home = (b.column(c).to_numpy(zero_copy_only=False)
                                                for c in ("doc_id", "place", "ref", "ref_place", "shard"))
            new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (np.diff(place) != 1) | (ref[1:] != ref[:-1])
                                  | (np.diff(ref_place) != 1) | (home[1:] != home[:-1])))
            start = np.flatnonzero(new)
            size = np.diff(np.concatenate((start, [len(doc)])))
            rows = [list(r) for r in zip(doc[start].tolist(), place[start].tolist(), ref[start].tolist(),
                                         ref_place[start].tolist(), size.tolist(), home[start].tolist())]
            if held is not None:
                d, p, r, q, n, s = held
                if rows[0][:4] == [d, p + n, r, q + n] and rows[0][5] == s:
                    rows[0] = [d, p, r, q, n + rows[0][4], s]
                else:
                    rows.insert(0, held)
            held = rows.pop()
            yield _segment_batch(rows)
        if held is not None:
            yield _segment_batch([held])

    return (hits.withColumn("shard", shard).repartition("doc_id").sortWithinPartitions("doc_id", "place")
            .mapInArrow(run, "doc_id long, place long, n long, shard long"))


def _segment_batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1, 4, 5)],
                                      ["doc_id", "place", "n", "shard"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, spans): word ranges (start, end, ...) that a smaller document has too.

    ``docs`` holds each word sequence once."""
    shared = _shared_anchors(docs)
    hits = _hits(docs, shared)
    release(shared)
    block = F.shiftright(F.col("ref_place"), 32), F.floor((F.col("ref_place") % (1 << 32)) / BLOCK)
    blocks = materialise(hits.select(F.col("ref").alias("doc_id"), block[0].alias("tag"), block[1].alias("block")).distinct(),
                         "dedup-blocks")
    shards = max(1, blocks.count() * (BLOCK + WINDOW) // SHARD_WORDS)

    def shard(doc, tag, block):
        return F.pmod(F.xxhash64(doc, tag, F.floor(block / BLOCKS)), F.lit(shards))

    segments = materialise(_segments(hits, shard(F.col("ref"), *block)), "dedup-segments")
    release(hits)
    places = segments.groupBy("shard").agg((1 + F.floor(F.sum(F.col("n") + WINDOW) / PLACE_WORDS)).cast("int").alias("places"))
    passages = blocks.select("doc_id", "tag", F.lit(0).alias("kind"), (F.col("block") * BLOCK).alias("start"),
                             F.lit(BLOCK + WINDOW - 1).cast("long").alias("size"),
                             shard(F.col("doc_id"), F.col("tag"), F.col("block")).alias("shard")) \
        .unionByName(segments.select("doc_id", F.shiftright("place", 32).alias("tag"), F.lit(1).alias("kind"),
                                     (F.col("place") % (1 << 32)).alias("start"),
                                     (F.col("n") + WINDOW - 1).alias("size"), "shard"))
    wanted = materialise(passages.groupBy("doc_id", "tag").agg(
        F.array_sort(F.collect_list(F.struct("kind", "shard", "start", "size"))).alias("wanted")), "dedup-wanted")

    def cut(batches):
        names = ["doc_id", "tag", "kind", "start", "shard", "words"]
        for b, raw, off, words, one, _ in _texts(batches):
            tag, rows = _tag(one), []
            for d, (doc, mine, wanted_) in enumerate(zip(*(b.column(c).to_pylist() for c in ("doc_id", "tag", "wanted")))):
                if mine != tag[d]:
                    continue                   # another text of a repeated doc_id
                x, y = int(words.first[d]), int(words.first[d + 1])
                merged = []
                for w in wanted_:
                    z = min(w["start"] + w["size"], y - x)
                    if merged and w["kind"] == 0 and merged[-1][:2] == [0, w["shard"]] and w["start"] <= merged[-1][3]:
                        merged[-1][3] = z
                    else:
                        merged.append([w["kind"], w["shard"], w["start"], z])
                for kind, home, a, z in merged:
                    rows.append((doc, mine, kind, a, home, raw[words.start[x + a]:words.end[x + z - 1]].tobytes()))
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    content = semi_join(docs.select("doc_id", "text"), wanted.select("doc_id")).join(wanted, "doc_id") \
        .select("doc_id", "tag", "text", "wanted") \
        .mapInArrow(cut, "doc_id long, tag long, kind int, start long, shard long, words binary")
    dealt = content.join(places, "shard").withColumn(
        "place", F.explode(F.when(F.col("kind") == 0, F.sequence(F.lit(0), F.col("places") - 1))
                           .otherwise(F.array(F.pmod(F.xxhash64("doc_id", "start"), F.col("places")).cast("int")))))

    def stream(batches):
        home, passages_, automaton = None, [], None
        for b in slices(batches, "words", 4 * SLICE_BYTES):
            rows = []
            for doc, tag, kind, start, *key, data in zip(*(b.column(c).to_pylist() for c in (
                    "doc_id", "tag", "kind", "start", "shard", "place", "words"))):
                if key != home:
                    home, passages_, automaton = key, [], None
                if kind == 0:
                    passages_.append(data.split())
                    continue
                if automaton is None:
                    automaton, passages_ = SuffixAutomaton(passages_), []
                rows += [(doc, tag, start + x, start + y) for x, y in automaton.spans(data.split(), WINDOW)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)],
                                             ["doc_id", "tag", "a", "b"])

    spans = (dealt.select("doc_id", "tag", "kind", "start", "shard", "place", "words")
             .repartition("shard", "place").sortWithinPartitions("shard", "place", "kind")
             .mapInArrow(stream, "doc_id long, tag long, a long, b long"))
    found = materialise(spans.groupBy("doc_id", "tag").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans")),
                        "dedup-spans")
    release(blocks, segments, wanted)
    return found


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of ``docs``."""
    texts = fingerprints(docs)
    first = texts.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= WINDOW)) \
        .groupBy("one", "two", "n_words").agg(F.min("doc_id").alias("first"))
    texts = materialise(texts.join(materialise(first, "dedup-originals"), ["one", "two", "n_words"], "left")
                        .select("doc_id", "tag", "n_words", "sha", (F.col("doc_id") > F.col("first")).alias("copy")),
                        "dedup-copies")
    source = docs.select("doc_id", "text").where("doc_id is not null")
    copies = texts.where("doc_id is not null").groupBy("doc_id").agg(F.bool_and(F.coalesce("copy", F.lit(False))).alias("all"))
    spans = repeated_spans(anti_join(source, copies.where("all").select("doc_id")))

    def rest(batches):
        for b, raw, off, words, one, _ in _texts(batches):
            tag, data, rows = _tag(one), raw.tobytes(), []
            for d, (doc, mine, spans_) in enumerate(zip(*(b.column(c).to_pylist() for c in ("doc_id", "tag", "spans")))):
                if mine != tag[d]:
                    continue
                text = data[off[d]:off[d + 1]].split()
                gone = np.zeros(len(text) + 1, np.int64)
                for s in spans_:
                    gone[s["a"]] += 1
                    gone[s["b"]] -= 1
                kept = np.cumsum(gone[:-1]) == 0
                sha = hashlib.sha256(b" ".join([w for w, k in zip(text, kept.tolist()) if k])).hexdigest()
                rows.append((doc, mine, int(len(text) - kept.sum()), sha))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)],
                                             ["doc_id", "tag", "n_removed", "kept"])

    changed = semi_join(source, spans.select("doc_id")).join(spans, "doc_id").select("doc_id", "tag", "text", "spans") \
        .mapInArrow(rest, "doc_id long, tag long, n_removed long, kept string").distinct()
    return texts.join(changed, ["doc_id", "tag"], "left").select(
        "doc_id", "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"))


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract digest over all documents."""
    return dedup(table(spark, sf_dir, "documents"))


OP2_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) i FROM d WHERE len(w) >= {WINDOW})),
f AS (SELECT g, min(doc_id) first FROM g GROUP BY g),
hit AS (SELECT doc_id, i FROM g JOIN f USING (g) WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) p FROM hit),
words AS (SELECT doc_id, unnest(w) w, unnest(range(1, len(w) + 1)) p FROM d),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) s FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT n_words, (SELECT count(*) FROM gone WHERE gone.doc_id = d.doc_id)::BIGINT n_removed,
       sha256(coalesce(s, '')) kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
