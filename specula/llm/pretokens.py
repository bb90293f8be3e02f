"""Byte-level pre-splitting of whole texts, with what each piece maps to kept for the pieces to come."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Fixed value: white space as Unicode defines it.
WHITE = r"\t-\r \x85\xa0  -     　"
#: Fixed value: the splitting pattern of byte-level vocabularies.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"

#: Characters of the longest piece that is remembered: what is kept is bounded in bytes, not only in pieces.
LONGEST = 64


class PieceMap:
    """Maps texts piece by piece: ``of(text)`` joins what ``of_word`` gives for each pre-split word.

    ``of_words``, if given, maps all words of a piece at once where white space is parted into words, for what depends
    on the word before; ``of_special`` a text together with the special string behind it.

    A space between two characters that aren't white space always starts a word, so a text may be cut there and
    each piece be looked up. Pieces that touch other white space are put together again first. At most ``most``
    pieces of at most ``LONGEST`` characters are kept, in two generations, so that memory is bounded and frequent
    pieces stay; longer ones are mapped each time anew.
    """

    def __init__(self, of_word: Callable, join: Callable, special: dict[str, object] | None = None, most: int = 150_000, of_words: Callable | None = None, of_special: Callable | None = None):
        self.of_words, self.of_special = of_words, of_special
        self.of_word, self.join, self.special, self.most = of_word, join, dict(special or {}), most
        self.split = regex.compile(PATTERN).findall
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}
        self.words: dict[str, object] = {}

    def learn(self, texts: list[str], of_many: Callable) -> None:
        """Remember what ``of_many`` gives, all at once, for the words of the texts' new pieces.

        Only a help for :meth:`of`, which maps by itself what isn't remembered.
        """
        met = set()
        for t in texts:
            met.update(t.split(" "))
        self._learned([p for p in met if len(p) <= LONGEST], of_many)

    def of_all(self, texts: pa.Array, of_many: Callable) -> pa.Array:
        """What :meth:`of` gives for each text, null as empty, where that is bytes; texts are cut and put together by Arrow.

        Each different piece is looked up once, words of new pieces go to ``of_many`` all at once.
        """
        texts = pc.fill_null(texts, "")
        parts = pc.split_pattern(texts, " ")
        flat, lengths = parts.flatten(), pc.list_value_length(parts).to_numpy(zero_copy_only=False)
        begins = np.cumsum(lengths) - lengths
        head = np.zeros(len(flat), bool)
        head[begins] = True
        coded = flat.filter(pa.array(~head)).dictionary_encode()
        found = self._learned(coded.dictionary.to_pylist(), of_many)
        at, n = np.empty(len(flat), np.int64), len(found)
        at[~head], at[head] = coded.indices.to_numpy(), n + np.arange(len(texts))
        # texts with special strings, or with a piece that isn't one by itself, are mapped as wholes
        known = np.array([v is not None for v in found] + [True] * len(texts))
        whole = ~np.logical_and.reduceat(known[at], begins) if len(texts) else np.zeros(0, bool)
        for s in self.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        at[np.repeat(whole, lengths) & ~head] = n + len(texts)
        first = [self.of(t.as_py()) if w else self._words(h) for t, w, h in zip(texts, whole.tolist(), flat.take(pa.array(begins)).to_pylist(), strict=True)]
        joined = pa.array([*(v or b"" for v in found), *first, b""], pa.binary()).take(pa.array(at))
        ends = np.frombuffer(joined.buffers()[1], np.int32, len(at) + 1)[np.append(begins, len(at))]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends.tobytes()), joined.buffers()[2]])

    def _learned(self, pieces: list[str], of_many: Callable) -> list:
        """What a space and each of different pieces map to; None as in :meth:`_missed`."""
        values = list(map(self.young.get, pieces))
        new, again = [], {}
        for k in [k for k, v in enumerate(values) if v is None]:
            p = pieces[k]
            if (v := self.old.get(p)) is not None:
                values[k] = again[p] = v
            elif p and not p[0].isspace() and not p[-1].isspace():
                if len(p) <= LONGEST:
                    new.append(k)
                else:
                    values[k] = self._words(" " + p)
        words = self.split(" " + " ".join([pieces[k] for k in new])) if new else []
        unknown = [w for w in set(words) if w not in self.words]
        known = dict(zip(unknown, of_many([w.encode("utf-8", "surrogatepass") for w in unknown]), strict=True))
        found = [v if (v := known.get(w)) is not None else self.words[w] for w in words]
        begins = [k for k, w in enumerate(words) if w[0] == " "] + [len(words)]
        for k, i, j in zip(new, begins, begins[1:], strict=False):
            if j - i == 1:
                v = found[i]
            else:
                v = self.of_words(words[i:j]) if len(pieces[k].split()) > 1 and self._white(words[i:j]) else self.join(found[i:j])
            values[k] = again[pieces[k]] = v
        if len(self.young) + len(again) > self.most:
            self.old, self.young = self.young, {}
        self.young.update(again if len(again) <= self.most else itertools.islice(again.items(), self.most))
        if len(self.words) + len(known) > self.most:
            self.words.clear()
        self.words.update((w, known[w]) for w in unknown[: self.most] if len(w) <= LONGEST)
        return values

    def _keep(self, piece: str, v) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[piece] = v

    def of(self, text: str):
        if self.cut and any(s in text for s in self.special):
            parts = self.cut(text)
            if self.of_special:
                return self.join([*(self.of_special(parts[k], parts[k + 1]) for k in range(0, len(parts) - 1, 2)), self._plain(parts[-1])])
            return self.join([self.special[p] if k % 2 else self._plain(p) for k, p in enumerate(parts)])
        return self._plain(text)

    def _plain(self, text: str):
        head, *rest = text.split(" ")
        get = self.young.get
        found = [get(p) for p in rest]
        if None in found:
            for k, v in enumerate(found):
                if v is None:
                    found[k] = v = self._missed(rest[k])
                    if v is None:  # this piece isn't one by itself
                        return self._merged(text)
        return self.join([self._words(head), *found])

    def _missed(self, piece: str):
        """What a space and the piece map to; None if white space touches the space or the piece's end."""
        if (v := self.young.get(piece)) is None and (v := self.old.get(piece)) is None:
            if not piece or piece[0].isspace() or piece[-1].isspace():
                return None
            v = self._words(" " + piece)
        if len(piece) <= LONGEST:
            self._keep(piece, v)
        return v

    def _merged(self, text: str):
        pieces, rest = [], text.split(" ")
        for piece in rest:
            if pieces and (not piece or piece[0].isspace() or not pieces[-1] or pieces[-1][-1].isspace()):
                pieces[-1] = f"{pieces[-1]} {piece}"
            else:
                pieces.append(piece)
        whole = lambda p: not p or p[0].isspace() or p[-1].isspace() or " " in p
        return self.join([self._words(pieces[0]), *(self._words(" " + p) if whole(p) else self._missed(p) for p in pieces[1:])])

    def _white(self, words: list[str]) -> bool:
        """Whether ``of_words`` is asked for: white space is parted into words."""
        return bool(self.of_words) and any(w.isspace() and after[0].isspace() for w, after in zip(words, words[1:], strict=False))

    def _words(self, text: str):
        out, words = [], self.split(text)
        if self._white(words):
            return self.of_words(words)
        for w in words:
            if (v := self.words.get(w)) is None:
                v = self.of_word(w.encode("utf-8", "surrogatepass"))
                if len(w) <= LONGEST:
                    if len(self.words) >= self.most:
                        self.words.clear()
                    self.words[w] = v
            out.append(v)
        return self.join(out)
