"""Token counts: byte-pair merging of whole batches, rank by rank.

Every task cuts its texts to pre-tokens (``pretokens.Runs``) and merges the ones
its memo has not seen together: they lie in one ragged numpy array of symbol ids,
and each round applies, in every sequence at once, all occurrences of that
sequence's lowest-ranked pair, left to right. A sequence without a known pair is
done; its surviving symbols are its tokens. A pair that contains a merged symbol
ranks after the merge that made it, so taking all occurrences in one round gives
what one merge at a time gives. In sequences of more than ``LONG`` bytes a round
takes the lowest rank of all of them, from lists of places by rank, and looks only at
the neighbours of what it merged: such runs would need as many rounds over everything as
they have different pairs.

Texts with Unicode white space or a special token's string are cut by the
tokenizer library's own pre-tokenizer as whole texts; the merging is the same.

Cases: null text counts as empty (0 bytes, 0 tokens); repeated rows give a row
each; a null doc_id stays null; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from playstat.llm.pretokens import Memo, Runs, ragged_index, span_hash
from playstat.llm.ragged import kept, slices, text_buffer
from playstat.llm.storage import table

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
LONG = 512                     # bytes of a sequence that is merged by lists of places
_UNKNOWN = np.iinfo(np.int64).max
#: White space beyond ASCII, where a run of it may reach across chunks.
_WIDE_SPACE = re.compile("[\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
_WIDE_LEADS = (0xC2, 0xE1, 0xE2, 0xE3)


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself
    where it is printable and no space, else the next one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    place = {**{b: b for b in shown}, **{b: 0x100 + i for i, b in enumerate(hidden)}}
    return [chr(place[b]) for b in range(256)]


class RankMerger:
    """Merge table of a byte-level BPE file and the batched merging."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.merged = made
        order = np.argsort(key)
        self.key, self.rank, self.made = key[order], order, made[order]
        characters = byte_characters()
        self.byte_id = np.array([vocab[c] for c in characters], np.int64)
        self.character_id = {c: vocab[c] for c in characters}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.library = Tokenizer.from_file(path).pre_tokenizer

    def counts(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Symbols that survive in each sequence (none is empty)."""
        result = np.zeros(len(sizes), np.int64)
        long = sizes > LONG
        if long.any():
            of_long = np.repeat(long, sizes)
            result[long] = self.counts_of_long(symbols[of_long], sizes[long])
            symbols, sizes = symbols[~of_long], sizes[~long]
        alive, symbols = np.flatnonzero(~long), symbols.copy()
        while len(alive):
            first = np.cumsum(sizes) - sizes
            owner = np.repeat(np.arange(len(sizes)), sizes)
            rank = np.full(len(symbols), _UNKNOWN)
            pair = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
            known = (self.key[at] == pair) & (owner[:-1] == owner[1:])
            rank[:-1][known] = self.rank[at[known]]
            lowest = np.minimum.reduceat(rank, first)
            done = lowest == _UNKNOWN
            result[alive[done]] = sizes[done]
            hit = (rank == lowest[owner]) & ~done[owner]
            hit &= self._every_second(hit)
            where = np.flatnonzero(hit)
            symbols[where] = self.made[at[where]]
            keep = ~done[owner]
            keep[where + 1] = False
            sizes = (sizes - np.bincount(owner[where], minlength=len(sizes)))[~done]
            symbols, alive = symbols[keep], alive[~done]
        return result

    def _ranks(self, pair: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
        return np.where(self.key[at] == pair, self.rank[at], _UNKNOWN)

    def counts_of_long(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """``counts`` with linked symbols: ``waiting`` has the places of each rank's pairs."""
        n = len(symbols)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        first = np.cumsum(sizes) - sizes
        # n stands for no neighbour
        symbols = np.append(symbols, -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[first + sizes - 1] = n
        before[first] = n
        rank = np.append(self._ranks(symbols[:n] << 32 | symbols[after[:n]]), _UNKNOWN)
        waiting: dict[int, list[int]] = defaultdict(list)
        queue: list[int] = []

        def wait(places: np.ndarray):
            places = places[rank[places] != _UNKNOWN]
            for place, r in zip(places.tolist(), rank[places].tolist()):
                if r not in waiting:
                    heapq.heappush(queue, r)
                waiting[r].append(place)

        wait(np.arange(n))
        left = sizes.copy()
        while queue:
            r = heapq.heappop(queue)
            at = np.unique(np.array(waiting.pop(r), np.int64))
            at = at[rank[at] == r]
            if not len(at):
                continue
            overlaps = np.zeros(len(at), bool)
            overlaps[1:] = after[at[:-1]] == at[1:]
            index = np.arange(len(at))
            at = at[(index - np.maximum.accumulate(np.where(overlaps, 0, index))) % 2 == 0]
            gone = after[at]
            symbols[at] = self.merged[r]
            rank[gone] = _UNKNOWN
            after[at] = after[gone]
            before[after[at]] = at
            left -= np.bincount(owner[at], minlength=len(left))
            touched = np.unique(np.concatenate((at, before[at])))
            touched = touched[touched < n]
            rank[touched] = self._ranks(symbols[touched] << 32 | symbols[after[touched]])
            wait(touched)
        return left

    @staticmethod
    def _every_second(hit: np.ndarray) -> np.ndarray:
        """Within runs of overlapping hits (a pair of equal symbols), the 1st, 3rd, ..."""
        start = hit.copy()
        start[1:] &= ~hit[:-1]
        index = np.arange(len(hit))
        begin = np.maximum.accumulate(np.where(start, index, 0))
        return (index - begin) % 2 == 0


class Counter:
    """Token counts of texts, with a memo for each worker."""

    def __init__(self, merger: RankMerger):
        self.merger = merger
        self.memo = Memo(None)

    def _merge(self, groups: list[list[np.ndarray]]) -> np.ndarray:
        """Token count of each group of pre-tokens (arrays of symbol ids)."""
        flat = [p for g in groups for p in g]
        if not flat:
            return np.zeros(len(groups), np.int64)
        counts = self.merger.counts(np.concatenate(flat), np.array([len(p) for p in flat]))
        owner = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
        return np.bincount(owner, counts, len(groups)).astype(np.int64)

    def _library_cut(self, text: str) -> list[np.ndarray]:
        ids = self.merger.character_id
        return [np.array([ids[c] for c in piece], np.int64)
                for piece, _ in self.merger.library.pre_tokenize_str(text)]

    def whole_text(self, text: str) -> int:
        """Count by the library's cut, for texts that the byte classes can't cut."""
        total = 0
        for part in re.split("(" + "|".join(map(re.escape, self.merger.special)) + ")", text):
            if part in self.merger.special:
                total += 1
            elif part:
                total += int(self._merge([self._library_cut(part)])[0])
        return total

    def slice(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        runs = Runs(raw, off, fold_ascii_case=False, single_digits=False)
        n_docs = len(off) - 1
        # the white space before each chunk: its last character joins the chunk if it is a blank
        chunk = np.flatnonzero(runs.opens)
        document = np.searchsorted(off, runs.start[chunk], "right") - 1
        previous = np.zeros(len(chunk), np.int64)
        if len(chunk):
            previous[1:] = runs.end[chunk[1:] - 1]
        gap_start = np.maximum(previous, off[document])
        gap = runs.start[chunk] - gap_start
        blank = np.zeros(len(chunk), bool)
        blank[gap > 0] = raw[runs.start[chunk[gap > 0]] - 1] == 0x20
        joined = np.zeros(len(runs), np.int64)
        joined[chunk] = blank
        begin, end = runs.start - joined, runs.end
        # white space pre-tokens: all but the last character, the last one unless joined, the text's end
        lead = gap > 1
        single = (gap > 0) & ~blank
        tail_start = off[:-1].copy()
        has = runs.first[1:] > runs.first[:-1]
        tail_start[has] = runs.end[runs.first[1:][has] - 1]
        tail = off[1:] > tail_start
        begin = np.concatenate((begin, gap_start[lead], runs.start[chunk[single]] - 1, tail_start[tail]))
        end = np.concatenate((end, runs.start[chunk[lead]] - 1, runs.start[chunk[single]], off[1:][tail]))
        owner = np.concatenate((np.repeat(np.arange(n_docs), np.diff(runs.first)), document[lead],
                                document[single], np.flatnonzero(tail)))
        hard = np.concatenate((runs.hard, np.zeros(len(begin) - len(runs), bool)))
        keys = span_hash(raw, begin, end)

        def make(where):
            counts = np.zeros(len(where), np.int64)
            whole = hard[where]
            plain = where[~whole]
            sizes = end[plain] - begin[plain]
            if len(plain):
                counts[~whole] = self.merger.counts(self.merger.byte_id[raw[ragged_index(begin[plain], sizes)]], sizes)
            counts[whole] = self._merge([self._library_cut(raw[begin[i]:end[i]].tobytes().decode())
                                         for i in where[whole].tolist()])
            return counts[:, None]

        self.memo.make = make
        if not len(keys):
            return np.zeros(n_docs, np.int64)
        slots = self.memo.get(keys, np.arange(len(keys)))
        counts = self.memo.values[self.memo.offsets[slots]]
        return np.bincount(owner, counts, n_docs).astype(np.int64)

    def odd(self, raw: np.ndarray, off: np.ndarray) -> list[int]:
        """Texts with wide white space or the string of a special token."""
        suspects = np.isin(raw, _WIDE_LEADS) | (raw == ord("|"))
        seen = np.concatenate(([0], np.cumsum(suspects)))
        found, data = [], raw.tobytes()
        for d in np.flatnonzero(seen[off[1:]] > seen[off[:-1]]).tolist():
            text = data[off[d]:off[d + 1]].decode()
            if _WIDE_SPACE.search(text) or any(s in text for s in self.merger.special):
                found.append(d)
        return found

    def counts(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        result, data = self.slice(raw, off), None
        for d in self.odd(raw, off):
            data = data or raw.tobytes()
            result[d] = self.whole_text(data[off[d]:off[d + 1]].decode())
        return result


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every text."""
    def count(batches):
        memo = f"token counts {vocabulary}"
        counter = kept(memo, lambda: Counter(RankMerger(public_tokenizers.path(vocabulary))))
        for b in slices(batches, keeps=memo):
            raw, off = text_buffer(b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(off), pa.int64()), pa.array(counter.counts(raw, off), pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """Contract digest: counts of all documents and whether they exceed the limit."""
    counted = count_tokens(table(spark, sf_dir, "documents"))
    return counted.select("*", (counted.n_tokens > LIMIT).alias("over_limit"))
