"""Pre-tokens of Arrow text slices as hashed byte ranges.

Public byte-pair tokenizers cut a text at white space and between letters,
digits and other characters before they merge. Here that cut is made with numpy
over a whole slice, for the characters whose class a byte shows (ASCII and the
Latin-1 letters). A white-space-delimited chunk with anything else (other
scripts, an apostrophe, a bar that may open a special token) stays in one piece
and is left to the tokenizer library's own pre-tokenizer.
"""

from __future__ import annotations

import numpy as np

from playstat.llm.ragged import _MUL, _POWERS, Alphabet, mix

SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
MEMO_ENTRIES = 250_000         # keys that a worker's memo keeps

_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = SPACE
_CLASS[ord("0"):ord("9") + 1] = DIGIT
_CLASS[ord("A"):ord("Z") + 1] = LETTER
_CLASS[ord("a"):ord("z") + 1] = LETTER
_CLASS[0x80:] = LETTER
_HARD = np.zeros(256, bool)
_HARD[[ord("'"), ord("|")]] = True
_HARD[0xC2:] = True
_HARD[0xC3] = False


class Runs:
    """Maximal runs of one class, in text order.

    start, end: byte ranges; hash: of the bytes; hard: whole chunks that need the
    library; opens: the run begins a chunk; first: index of each text's first run.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold_ascii_case: bool, single_digits: bool):
        n = len(data)
        kind = _CLASS[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        edge[n] = True
        change = np.ones(n + 1, bool)
        change[1:n] = kind[1:] != kind[:-1]
        if single_digits:
            change[1:n] |= kind[1:] == DIGIT
        change |= edge
        bounds = np.flatnonzero(change)
        start, end = bounds[:-1], bounds[1:]
        solid = kind[start] != SPACE
        start, end = start[solid], end[solid]
        before = np.zeros(len(start), bool)
        if len(start):
            before[1:] = (start[1:] == end[:-1]) & ~edge[start[1:]]
        self.opens = ~before
        self.hard = np.zeros(len(start), bool)
        marks = _HARD[data]
        lead = np.flatnonzero(data[:-1] == 0xC3) if n else np.empty(0, np.int64)
        marks[lead[(data[lead + 1] == 0x97) | (data[lead + 1] == 0xB7)]] = True
        if marks.any():
            chunk = np.cumsum(self.opens) - 1
            head = np.flatnonzero(self.opens)
            tail = np.concatenate((head[1:], [len(start)])) - 1
            seen = np.concatenate(([0], np.cumsum(marks)))
            bad = seen[end[tail]] > seen[start[head]]
            keep = self.opens | ~bad[chunk]
            whole = np.flatnonzero(self.opens & bad[chunk])
            end = end.copy()
            end[whole] = end[tail[bad]]
            self.hard[whole] = True
            start, end, self.opens, self.hard = start[keep], end[keep], self.opens[keep], self.hard[keep]
        self.start, self.end = start, end
        self.first = np.searchsorted(start, offsets)
        self.hash = span_hash(data, start, end, fold_ascii_case)
        if fold_ascii_case and self.hard.any():       # special tokens keep their case
            self.hash[self.hard] = mix(span_hash(data, start[self.hard], end[self.hard]) + _MUL)

    def __len__(self):
        return len(self.start)


_FOLDED = Alphabet(b"", fold_ascii_case=True)
_EXACT = Alphabet(b"", fold_ascii_case=False)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold_ascii_case: bool = False) -> np.ndarray:
    """64-bit hash of the bytes of each range."""
    up, down = _POWERS.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED if fold_ascii_case else _EXACT).value[data] * up[:len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _MUL)


class Memo:
    """Ragged int arrays by 64-bit key; ``make`` computes the unseen ones in one call.

    It keeps the first ``MEMO_ENTRIES`` keys, among which are the frequent ones;
    what comes later is made again in each call that needs it."""

    def __init__(self, make):
        self.make = make
        self.slot: dict[int, int] = {}
        self.kept = 0
        self.values, self.offsets = np.empty(0, np.int64), np.zeros(1, np.int64)

    def get(self, keys: np.ndarray, where: np.ndarray):
        """Slot of each key, valid until the next call; ``make`` gets the entries of
        ``where`` (one example place for each unseen key)."""
        unique, example, inverse = np.unique(keys, return_index=True, return_inverse=True)
        self.offsets = self.offsets[:self.kept + 1]
        slots = np.array([self.slot.get(k, -1) for k in unique.tolist()], np.int64)
        unseen = np.flatnonzero(slots < 0)
        if len(unseen):
            made = self.make(where[example[unseen]])
            sizes = np.fromiter((len(x) for x in made), np.int64, len(made))
            self.values = _append(self.values, self.offsets[-1], np.concatenate([np.asarray(x, np.int64) for x in made]))
            self.offsets = np.concatenate((self.offsets, self.offsets[-1] + np.cumsum(sizes)))
            slots[unseen] = self.kept + np.arange(len(unseen))
            if self.kept + len(unseen) <= MEMO_ENTRIES:
                self.slot.update(zip(unique[unseen].tolist(), slots[unseen].tolist()))
                self.kept += len(unseen)
        return slots[inverse]

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of all slots one after the other, and how many each has."""
        begin = self.offsets[slots]
        size = self.offsets[slots + 1] - begin
        return self.values[ragged_index(begin, size)], size


def ragged_index(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All positions of the ranges [begin, begin + size), one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + size, size)


def _append(store: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``store`` with ``more`` after its first ``used`` entries, grown by doubling."""
    need = int(used) + len(more)
    if need > len(store):
        grown = np.empty(max(need, 2 * len(store)), np.int64)
        grown[:used] = store[:used]
        store = grown
    store[used:need] = more
    return store
