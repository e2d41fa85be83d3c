"""A generalised suffix automaton over sequences of numbers, in flat arrays."""

from __future__ import annotations

from array import array

SPREAD = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


class SuffixAutomaton:
    """Of sequences of numbers from 1 on; `ends` has the state of each whole sequence, which is the longest string of that state.

    A transition is an entry of `symbol`, `to` and `after` (the next one of its state) and a slot of an open hash table by
    (state, symbol).
    """

    def __init__(self, listed: list[array]):
        total = sum(map(len, listed))
        self.mask = (1 << max(4, (4 * total).bit_length())) - 1  # there are under three transitions a number
        self.slots = array("i", bytes(4 * (self.mask + 1)))  # a transition's number, from 1
        self.owner, self.symbol, self.to, self.after = (array("i", [0]) for _ in range(4))
        self.head, self.link, self.length = array("i", [0]), array("i", [-1]), array("i", [0])
        self.ends = array("i")
        for ids in listed:
            last = 0
            for c in ids:
                last = self._extend(last, c)
            self.ends.append(last)

    def _slot(self, state: int, c: int) -> int:
        """Where the transition is, or would be."""
        slots, owner, symbol, mask = self.slots, self.owner, self.symbol, self.mask
        k = ((state * 0x2545F491 + c) * SPREAD & _ALL) >> 24 & mask
        while (e := slots[k]) and (owner[e] != state or symbol[e] != c):
            k = k + 1 & mask
        return k

    def _find(self, state: int, c: int) -> int:
        return self.slots[self._slot(state, c)]

    def _add(self, state: int, c: int, to: int) -> None:
        self.slots[self._slot(state, c)] = len(self.to)
        self.owner.append(state)
        self.symbol.append(c)
        self.to.append(to)
        self.after.append(self.head[state])
        self.head[state] = len(self.to) - 1

    def _state(self, length: int, link: int) -> int:
        self.head.append(0)
        self.length.append(length)
        self.link.append(link)
        return len(self.head) - 1

    def _extend(self, last: int, c: int) -> int:
        if e := self._find(last, c):
            into = self.to[e]
            return into if self.length[into] == self.length[last] + 1 else self._split(last, c, into)
        new, p = self._state(self.length[last] + 1, 0), last
        while p >= 0 and not (e := self._find(p, c)):
            self._add(p, c, new)
            p = self.link[p]
        if p >= 0:
            into = self.to[e]
            self.link[new] = into if self.length[into] == self.length[p] + 1 else self._split(p, c, into)
        return new

    def _split(self, p: int, c: int, into: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[into])
        e = self.head[into]
        while e:
            self._add(copy, self.symbol[e], self.to[e])
            e = self.after[e]
        self.link[into] = copy
        while p >= 0 and (e := self._find(p, c)) and self.to[e] == into:
            self.to[e] = copy
            p = self.link[p]
        return copy

    def lengths(self, ids, most: int | None = None):
        """(state, longest match ending here) after each number; a match of over `most` counts as one of `most`, in the state of that suffix."""
        state = n = 0
        link, length = self.link, self.length
        for c in ids:
            while not (e := self._find(state, c)) and state:
                state = link[state]
                n = length[state]
            state, n = (self.to[e], n + 1) if e else (0, 0)
            if most is not None and n > most:
                n = most
                if length[link[state]] >= most:  # one link at most, as the match was `most` long before this step
                    state = link[state]
            yield state, n
