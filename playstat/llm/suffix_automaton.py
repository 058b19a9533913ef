"""Suffix automaton of word sequences, and matching statistics against it."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence


class SuffixAutomaton:
    """Accepts every run of consecutive symbols of the sequences it was given."""

    def __init__(self, sequences: Iterable[Sequence[Hashable]]):
        self.step: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        last = 0
        for k, sequence in enumerate(sequences):
            for symbol in sequence:
                last = self._extend(last, symbol)
            last = self._extend(last, (k,))    # a symbol of its own: no match runs across sequences

    def _extend(self, last: int, symbol: Hashable) -> int:
        step, link, length = self.step, self.link, self.length
        state = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and symbol not in step[p]:
            step[p][symbol] = state
            p = link[p]
        if p >= 0:
            q = step[p][symbol]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(symbol) == q:
                    step[p][symbol] = copy
                    p = link[p]
                link[q] = link[state] = copy
        return state

    def spans(self, sequence: Sequence[Hashable], least: int) -> list[tuple[int, int]]:
        """Maximal spans [start, end) that are covered by matches of ``least`` symbols.

        The matching statistic of a position is the length of the longest match
        that ends there."""
        step, link, length = self.step, self.link, self.length
        state, matched, found = 0, 0, []
        for i, symbol in enumerate(sequence, 1):
            while state and symbol not in step[state]:
                state = link[state]
                matched = length[state]
            if symbol in step[state]:
                state = step[state][symbol]
                matched += 1
            if matched >= least:
                if found and found[-1][1] >= i - least:
                    found[-1] = (found[-1][0], i)
                else:
                    found.append((i - least, i))
        return found
