"""The automaton's tables as arrays, by which many words are walked side by side."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from specula.llm.bpe_automaton import BpeAutomaton


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int32 if x.max() < 1 << 30 else np.int64)


def _cut(values: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    all_, ends, size = values.tobytes(), np.cumsum(lengths), values.itemsize
    return [all_[i:j] for i, j in zip(((ends - lengths) * size).tolist(), (ends * size).tolist(), strict=True)]


class PrefixTable:
    """:meth:`BpeAutomaton.prefix_counts` and ``encode`` of many words at once: tokens as a trie, lost arcs as one sorted array.

    All tokens in all words are met first, then the words' prefixes are reached side by side, shorter ones first; of
    each prefix the count and the last arc are kept. Following last arcs back from a word's end gives its ids.
    Words are at most 32,767 bytes long.
    """

    #: Bytes of words that are worked on together.
    MOST = 1 << 17

    def __init__(self, a: BpeAutomaton):
        nodes = sorted({b[:k] for b in a.id_of for k in range(1, len(b) + 1)})
        number = {b"": 0} | {b: k for k, b in enumerate(nodes, 1)}
        arcs = np.array([number[b[:-1]] << 8 | b[-1] for b in nodes], np.int64)
        # arcs by an open hash of at most half full; -1 in empty places
        self.mask = (1 << (2 * len(arcs)).bit_length()) - 1
        self.arcs, self.child = np.full(self.mask + 1, -1, np.int32), np.zeros(self.mask + 1, np.int32)
        left, at = np.arange(len(arcs)), self._place(arcs)
        while len(left):
            free = self.arcs[at] < 0
            self.arcs[at[free]] = arcs[left[free]]  # of several the last one stays
            in_ = self.arcs[at] == arcs[left]
            self.child[at[in_]] = left[in_] + 1
            left, at = left[~in_], (at[~in_] + 1) & self.mask
        self.two = np.zeros(1 << 16, np.int64)  # the node of two bytes
        for b in nodes:
            if len(b) == 2:
                self.two[b[0] << 8 | b[1]] = number[b]
        self.one = np.array([number.get(bytes([b]), 0) for b in range(256)])
        self.token = np.array([-1, *(a.id_of.get(b, -1) for b in nodes)])
        self.size = np.array([len(a.label.get(t, b"")) for t in range(len(a.target))])
        states = sorted({0, *(a.target[t] for t in a.id_of.values())})
        row = {s: k for k, s in enumerate(states)}  # the start's is 0
        self.row, self.place = np.array([row.get(s, 0) for s in a.target]), np.array(a.place)
        self.bits = int(self.place.max()).bit_length()
        lost = [(k << self.bits | lo, k << self.bits | hi) for s, k in row.items() for lo, hi in zip(*a._row(s), strict=True)]
        self.los, self.his = map(_narrow, np.array([(-1, -1), *lost]).T)

    def _place(self, arc: np.ndarray) -> np.ndarray:
        return (arc.astype(np.int64) * 0x9E3779B1 >> 15) & self.mask

    def changes(self, words: list[bytes]) -> list[bytes]:
        """The changes of the token count from byte to byte of each word, as signed bytes."""
        return self._in_parts(words, self._changes)

    def ids(self, words: list[bytes]) -> list[bytes]:
        """What :meth:`BpeAutomaton.encode` gives for each word, as little-endian unsigned 32-bit integers."""
        return self._in_parts(words, self._ids)

    def _in_parts(self, words: list[bytes], of: Callable) -> list[bytes]:
        out, part, size = [], [], 0
        for w in words:
            part.append(w)
            size += len(w)
            if size >= self.MOST:
                out += of(part)
                part, size = [], 0
        return out + of(part) if part else out

    def _walked(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        """Words' lengths; of all words' prefixes, the empty ones included, the count and last arc; of all bytes, the place of the prefix that they end."""
        text, lengths = np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        own, at = np.repeat(np.arange(len(words)), lengths), np.arange(len(text))
        room, begun = ends[own] - at, at - (ends - lengths)[own]
        node, length, begins, tokens, stops = np.zeros(len(text), np.int64), 0, [], [], []
        while len(at):
            if length < 2:
                node = self.two[text[at].astype(np.int64) << 8 | text[at + 1]] if length else self.one[text]
                on = node > 0
                at, node = at[on], node[on]
            else:
                arc = node << 8 | text[at + length]
                k = self._place(arc)
                has = self.arcs[k]
                far = np.flatnonzero((has != arc) & (has >= 0))
                while len(far):
                    k[far] = (k[far] + 1) & self.mask
                    has[far] = self.arcs[k[far]]
                    far = far[(has[far] != arc[far]) & (has[far] >= 0)]
                on = np.flatnonzero(has == arc)
                at, node = at[on], self.child[k[on]]
            length += 1
            hit = self.token[node] >= 0
            begins.append(at[hit])
            tokens.append(self.token[node[hit]])
            stops.append((begun[at[hit]] + length).astype(np.int16))
            on = room[at] > length
            at, node = at[on], node[on]
        begin, token, stop = map(np.concatenate, (begins, tokens, stops))
        order = np.argsort(stop, kind="stable")
        begin, token, stop = begin[order], token[order], stop[order]
        first = begin + own[begin]  # of a word's prefixes, the empty one included
        last = first + stop - begun[begin]
        counts, row, arc = (np.zeros(len(text) + len(words), np.int64) for _ in range(3))
        bounds = np.flatnonzero(np.diff(stop, prepend=-1, append=-1)) if len(stop) else []
        for i, j in zip(bounds, bounds[1:], strict=False):
            f, t = first[i:j], token[i:j]
            key = (row[f] << self.bits | self.place[t]).astype(self.los.dtype)
            on = key > self.his[np.searchsorted(self.los, key, "right") - 1]
            f, t, to = f[on], t[on], last[i:j][on]
            counts[to], row[to], arc[to] = counts[f] + 1, self.row[t], t
        to = np.arange(len(text)) + own + 1
        if not counts[to].all():
            raise ValueError("a byte has no token in this vocabulary")
        return lengths, counts, arc, to

    def _changes(self, words: list[bytes]) -> list[bytes]:
        lengths, counts, _, to = self._walked(words)
        change = counts[to] - counts[to - 1]
        if len(change) and (change.min() < -128 or change.max() > 127):
            raise OverflowError("a change of the count is more than a signed byte holds")
        return _cut(change.astype(np.int8), lengths)

    def _ids(self, words: list[bytes]) -> list[bytes]:
        lengths, counts, arc, _ = self._walked(words)
        at = np.cumsum(lengths) + np.arange(len(words))  # the whole words among the prefixes
        n = counts[at]
        ids, put = np.empty(n.sum(), "<u4"), np.cumsum(n)
        while len(at):
            put -= 1
            ids[put] = found = arc[at]
            at -= self.size[found]
            on = counts[at] > 0
            at, put = at[on], put[on]
        return _cut(ids, n)
