"""A byte-pair vocabulary compiled to a deterministic automaton over its tokens.

The automaton accepts exactly the token sequences that byte-pair merging can produce (Berglund, Martens and
van der Merwe, "Constructing a BPE tokenization DFA", 2024). It starts as one state with an arc for every byte.
Each merge (u, v) then adds a gadget: the state behind u is copied, the copy loses its arc v, u now leads to the
copy, and wherever u may be read the new token uv may be read too, leading to the state behind v.

Two facts keep the tables small. The state behind a token doesn't depend on what came before it, so one array
holds all targets. And an arc uv exists where arc u existed when uv was made, so losing arc v at time t means
losing v and those tokens whose chain of left parts reaches v through a token made after t. Numbered so that
children precede their parent, in the order of their making, these tokens form one interval: a state is its
parent state and one interval of lost arcs.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_right
from functools import lru_cache


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class BpeAutomaton:
    """Tables of the automaton of one vocabulary. State 0 is the start.

    ``target[t]``: the state behind token t. ``parent[s]``, ``lost[s]``: the state that s was copied from and the
    interval of arcs that it lost. ``place[t]``: number of token t in the order of arcs. ``label[t]``: its bytes.
    """

    def __init__(self, vocab: dict[str, int], merges: list, special: dict[str, int] | None = None):
        symbols = byte_symbols()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.special = dict(special or {})
        self.label: dict[int, bytes] = {i: bytes(symbols[c] for c in s) for s, i in vocab.items() if s not in self.special}
        self.id_of: dict[bytes, int] = {b: i for i, b in self.label.items()}
        for text, i in self.special.items():
            self.label[i] = text.encode()
        made = [(vocab[u], vocab[v], vocab[u + v]) for u, v in merges]
        if len({m[2] for m in made}) != len(made):
            raise ValueError("two merges make the same token; its automaton is not defined here")
        size = max(self.label) + 1
        children: list[list[int]] = [[] for _ in range(size)]
        for u, _, t in made:
            children[u].append(t)  # in the order of their making
        composed = {t for _, _, t in made}
        self.place, first, count = [-1] * size, [0] * size, 0
        for root in sorted(t for t in self.label if t not in composed):
            stack = [(root, 0)]
            first[root] = count
            while stack:
                t, k = stack.pop()
                if k < len(children[t]):
                    stack.append((t, k + 1))
                    first[children[t][k]] = count
                    stack.append((children[t][k], 0))
                else:
                    self.place[t] = count
                    count += 1
        # gadgets, one for each merge, in order
        self.target, self.parent, self.lost = [0] * size, [0], [(0, -1)]
        begun = [0] * size  # how many children of a token are made already
        for u, v, t in made:
            later = first[children[v][begun[v]]] if begun[v] < len(children[v]) else self.place[v]
            self.parent.append(self.target[u])
            self.lost.append((later, self.place[v]))
            self.target[t] = self.target[v]
            self.target[u] = len(self.parent) - 1
            begun[u] += 1
        self.longest = max((len(b) for b in self.id_of), default=1)
        ends: dict[bytes, int] = {}
        starts: dict[bytes, int] = {}
        for b in self.id_of:
            starts[b[:2]] = max(starts.get(b[:2], 0), len(b))
            ends[b[-2:]] = max(ends.get(b[-2:], 0), len(b))
        self._starts, self._ends = starts, ends
        self._rows: dict[int, tuple[array, array]] = {}
        self._arcs: dict[int, int] = {}

    def _row(self, state: int) -> tuple[array, array]:
        """Lost arcs of a state as sorted, merged intervals; made when the state is first met."""
        if (row := self._rows.get(state)) is None:
            found, s = [], state
            while s:
                found.append(self.lost[s])
                s = self.parent[s]
            los, his = array("i"), array("i")
            for lo, hi in sorted(found):
                if his and lo <= his[-1] + 1:
                    his[-1] = max(his[-1], hi)
                else:
                    los.append(lo)
                    his.append(hi)
            if len(self._rows) > 20_000:
                self._rows.clear()
            row = self._rows[state] = (los, his)
        return row

    def step(self, state: int, token: int) -> int:
        """The state behind an arc, or -1 where there is no such arc."""
        key = state << 20 | token
        if (to := self._arcs.get(key)) is None:
            los, his = self._row(state)
            k = bisect_right(los, self.place[token]) - 1
            to = -1 if k >= 0 and self.place[token] <= his[k] else self.target[token]
            if len(self._arcs) > 200_000:
                self._arcs.clear()
            self._arcs[key] = to
        return to

    def encode(self, word: bytes) -> list[int]:
        """The one path of the automaton that spells ``word``: longest arcs first, one step back where none goes on."""
        ids, states, ends = [], [0], [0]
        n, arcs, at, id_of, starts = len(word), self._arcs, 0, self.id_of, self._starts
        length = min(n, starts.get(word[:2], 1)) if n else 0
        while at < n:
            state = states[-1]
            while length:
                token = id_of.get(word[at : at + length])
                if token is not None:
                    if (to := arcs.get(state << 20 | token)) is None:
                        to = self.step(state, token)
                    if to >= 0:
                        break
                length -= 1
            if length:
                ids.append(token)
                at += length
                states.append(to)
                ends.append(at)
                length = min(n - at, starts.get(word[at : at + 2], 1))
            else:  # no arc: shorten the arc before
                if not ids:
                    raise ValueError("a byte has no token in this vocabulary")
                ids.pop()
                states.pop()
                length = ends.pop() - ends[-1] - 1
                at = ends[-1]
        return ids

    def prefix_counts(self, word: bytes) -> list[int]:
        """Exact token count of each prefix of ``word``, the empty one first.

        Of the tokens that end at a place exactly one may follow the tokens of what is before it.
        """
        n, arcs, id_of, ends = len(word), self._arcs, self.id_of, self._ends
        counts, states = [0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            for begin in range(max(0, end - ends.get(word[max(0, end - 2) : end], 1)), end):
                token = id_of.get(word[begin:end])
                if token is not None:
                    if (to := arcs.get(states[begin] << 20 | token)) is None:
                        to = self.step(states[begin], token)
                    if to >= 0:
                        counts[end], states[end] = counts[begin] + 1, to
                        break
            else:
                raise ValueError("a byte has no token in this vocabulary")
        return counts


@lru_cache(maxsize=2)
def load(path: str) -> BpeAutomaton:
    """The automaton of a tokenizer file; compiled once in each Python process."""
    with open(path, encoding="utf-8") as f:
        return compile_json(f.read())


def compile_json(content: str) -> BpeAutomaton:
    doc = json.loads(content)
    special = {t["content"]: t["id"] for t in doc.get("added_tokens", [])}
    return BpeAutomaton(doc["model"]["vocab"], doc["model"]["merges"], special)
