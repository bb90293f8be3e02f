"""Benchmark decontamination: passages of a corpus within an edit distance of a benchmark item.

Texts and items are words: lower case, ASCII punctuation as space. An item of n words is leaked if some window of a
text is within floor(n * edit_share) word edits of it. Items of too few words for one edit are leaked by exact
windows only; their walks are their own words, so they are looked up as they are, without loss. ``min_words`` leaves
shorter items out where a user wants that; by default every item that has a word is searched for.

Candidates come from CGK embeddings (Chakraborty, Goldenberg and Koucky, "Streaming algorithms for embedding and
computing edit distance in the low distance regime", 2016): a walk over the words stays or steps on as random bits of
the word and the step say, and its trace turns edit distance into Hamming distance. Every window that can start a
match is embedded, one walk for all items of a size class; a few steps of the walk are sampled, and a window and an
item whose sampled words agree are a candidate. An item is embedded from its first word and from each that can be the
first one matched, as many as edits are allowed: the words before may be changed or cut off. This is repeated with
other bits and steps; the number of times is fitted on the driver, by simulation on the class's own items with the
most edits allowed, to reach ``recall`` for edits anywhere, at the head, in the middle, at the tail, and after the
first word with walks from first words alone, each by itself. Each candidate's edit distance is then computed
exactly, hence nothing is reported that isn't one.

Items of any length: one of more than ``LONG`` words is cut into pieces, of which one at least is within its equal share
of the edits wherever the item is leaked. Pieces are walked like items, and where one is met, the whole item is compared
with all windows around by one table of distances. Where walks would have to be repeated more than 400 times (a large
``edit_share``), items are cut into one more piece than edits are allowed, so that one is left as it was, and are looked
up by those: an exact way, without loss.

Windows are left out only where no match can start: at a word that can't be the first matched one of any item (a best
window starts with a matched word), or where the words in no item already exceed the edits allowed. Nothing is sampled
or capped.

Items go out in blocks of at most ``block_items`` items, each broadcast by itself, so the benchmark may have any
size; texts are mapped where they lie, whole documents at a time, without a shuffle.

Defined results: null or empty texts and items match nothing; repeated documents each give their rows; items equal
in words are each reported; for a document and an item the fewest edits of the windows found (of all windows around
for items in pieces), then the first window; empty tables give
no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import math
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specula.llm.bpe_codec import blocks
from specula.llm.common import table

_SPACES = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
SAMPLES = 3
#: Items of more words are cut into pieces of PIECE words or a little more.
LONG, PIECE = 60, 40
KINDS = ("anywhere", "head", "middle", "tail", "later")


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACES).split()


class Family:
    """The hash functions of one size class: random bits of the walks and sampled steps, from a seed."""

    def __init__(self, seed: int, repetitions: int, steps: int, vocabulary: int):
        r = np.random.default_rng(seed)
        self.bits = [r.integers(0, 2, (steps, vocabulary + 1), dtype=np.int8) for _ in range(repetitions)]
        self.steps = [np.sort(r.choice(steps, SAMPLES, replace=False)) for _ in range(repetitions)]

    def traces(self, k: int, symbols: np.ndarray, starts: np.ndarray):
        """Yields, for each sampled step, the words where the walks of repetition ``k`` are; ``send`` says which go on."""
        at, last = starts.copy(), 0
        for step in self.steps[k]:
            for j in range(last, step):
                at += self.bits[k][j].take(symbols.take(at))
            last = step
            keep = yield symbols.take(at)
            if keep is not None:
                at = at[keep]


def sampled(family: Family, k: int, symbols: np.ndarray, starts: np.ndarray, base: int) -> np.ndarray:
    """Keys of the sampled words; -1 where a walk has left the words."""
    keys, gone = np.zeros(len(starts), np.int64), np.zeros(len(starts), bool)
    for s in family.traces(k, symbols, starts):
        keys, gone = keys * base + s, gone | (s == 0)
    return np.where(gone, -1, keys)


def edits(items: np.ndarray, lens: np.ndarray, symbols: np.ndarray, starts: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Least edit distance of each item to a window that starts at its place: exact, for rows of items padded with -1."""
    width = items.shape[1]
    ramp = np.arange(width + 1, dtype=np.int16)
    d = np.repeat(ramp[None], len(items), 0)
    rows = np.arange(len(items))
    best = lens.astype(np.int16).copy()
    for t in range(int((lens + bound).max())):
        new = np.empty_like(d)
        new[:, 0] = t + 1
        np.minimum(d[:, :-1] + (items != symbols.take(starts + t)[:, None]), d[:, 1:] + 1, out=new[:, 1:])
        d = np.minimum.accumulate(new - ramp, axis=1) + ramp
        best = np.minimum(best, d[rows, lens])
    return best


class SizeClass:
    """Items of similar size with their hash tables, one for each repetition."""

    def __init__(self, items: list[np.ndarray], numbers: list[int], edit_share: float, recall: float, vocabulary: int, seed: int, repetitions: int | None = None, most_repetitions: int = 400):
        self.lens = np.array([len(x) for x in items])
        self.numbers = np.array(numbers)
        self.low, self.most = int(self.lens.min()), int(self.lens.max())
        self.bound = np.floor(self.lens * edit_share + 1e-9).astype(int)
        self.reach = self.most + int(self.bound.max()) + 1
        self.sure = self.low - int(math.floor(self.low * edit_share + 1e-9))  # words in every matching window
        self.items = np.full((len(items), self.most), -1, np.int32)
        for row, x in zip(self.items, items, strict=True):
            row[: len(x)] = x
        self.steps = max(SAMPLES, int(1.5 * self.low))
        self.base = vocabulary + 2
        self.heads = np.zeros(self.base, bool)  # words that can be an item's first matched one
        for x, n in zip(items, self.bound, strict=True):
            self.heads[x[: n + 1]] = True
        self.repetitions = repetitions or self._fit(items, seed, vocabulary, recall, most_repetitions)
        self.family = Family(seed, self.repetitions, self.steps, vocabulary)
        self.tables = []
        if repetitions is None:  # only fitted
            return
        flat, starts, owner = self._heads(items, self.bound)
        for k in range(self.repetitions):
            keys = sampled(self.family, k, flat, starts, self.base)
            self.tables.append(self._table(keys, owner))

    def _flat(self, items):
        gap = np.zeros(self.steps + 1, np.int32)
        parts = [np.concatenate([x, gap]) for x in items]
        starts = np.cumsum([0, *(len(p) for p in parts[:-1])])
        return np.concatenate(parts).astype(np.int64), starts.astype(np.int64)

    def _heads(self, items, bound):
        """The items' words, the places of their words 0 to ``bound``, and whose these are."""
        flat, starts = self._flat(items)
        n = np.minimum(bound + 1, [len(x) for x in items])
        owner = np.repeat(np.arange(len(items)), n)
        return flat, starts[owner] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), owner

    def _table(self, keys, owner):
        rows = np.flatnonzero(keys >= 0)
        keys, rows = np.unique(np.stack([keys[rows], owner[rows]]), axis=1)
        prefixes = [np.unique(keys // self.base ** (SAMPLES - 1 - d)) for d in range(SAMPLES)]
        first = np.zeros(self.base, bool)
        first[prefixes[0]] = True
        return first, prefixes[1:], keys, rows

    def _fit(self, items, seed, vocabulary, recall, most) -> int:
        """The least number of repetitions that reaches ``recall`` for each kind of change."""
        n = 1
        for kind, hits in self._simulate(items, seed, vocabulary).items():
            while np.mean(1 - (1 - hits) ** n) < recall:
                n += 1
                if n > most:
                    raise ValueError(f"{most} repetitions don't reach a recall of {recall} for items of {self.low} to {self.most} words edited {kind}")
        return n

    def _simulate(self, items, seed, vocabulary, pairs: int = 100, tries: int = 100) -> dict[str, np.ndarray]:
        """By kind of change, the share of repetitions that catch an item changed as much as allowed, for random changes."""
        r = np.random.default_rng(seed + 1)
        changed, own, allowed = [], [], []
        for kind in KINDS:
            for _ in range(pairs):
                row = int(r.integers(len(items)))
                y, bound = items[row].tolist(), int(self.bound[row])
                middle = (len(y) - bound) // 2
                first = {"head": 0, "middle": (len(y) - bound) // 2, "tail": len(y) - bound}.get(kind)
                for e in reversed(range(bound)):
                    at = int(r.integers(min(kind == "later", len(y) - 1), len(y))) if first is None else first + e
                    new, how = int(r.integers(vocabulary + 1)), r.integers(3)
                    y[at : at + int(how != 0)] = [new] * int(how != 2)
                own.append(items[row])
                changed.append(np.array(y or [0], np.int32))
                allowed.append(bound)
        family = Family(seed + 2, tries, self.steps, vocabulary)
        allowed = np.array(allowed)
        heads = allowed * (np.repeat(KINDS, pairs) != "later")
        a, sa, pa_ = self._heads(own, heads)
        b, sb, pb = self._heads(changed, 2 * heads)
        # a window counts that is a match from its start
        lens = np.array([len(x) for x in own])
        padded = np.full((len(own), self.most), -1, np.int32)
        for x, y in zip(padded, own, strict=True):
            x[: len(y)] = y
        sound = self.heads[b[sb]] & (edits(padded[pb], lens[pb], np.append(b, np.zeros(self.reach, np.int64)), sb, allowed[pb]) <= allowed[pb])
        sb, pb = sb[sound], pb[sound]
        hits = np.zeros(len(own))
        for k in range(tries):
            x, y = sampled(family, k, a, sa, self.base), sampled(family, k, b, sb, self.base)
            x, y = (np.where(keys < 0, -1, keys * len(own) + of) for keys, of in ((x, pa_), (y, pb)))
            met = np.zeros(len(own), bool)
            met[pb[(y >= 0) & np.isin(y, x)]] = True
            hits += met
        return dict(zip(KINDS, (hits / tries).reshape(len(KINDS), pairs), strict=True))

    def candidates(self, symbols: np.ndarray, outside: np.ndarray, ends: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and rows of items that agree in some repetition. ``outside``: running count of words in no item."""
        starts = np.flatnonzero(self.heads[symbols[:ends]] & (outside[self.sure : ends + self.sure] - outside[:ends] <= self.bound.max()))
        found = []
        for chunk in np.array_split(starts, max(1, len(starts) >> 17)):
            for k, (first, prefixes, keys, rows) in enumerate(self.tables):
                p, key, walks = chunk, None, self.family.traces(k, symbols, chunk)
                s = next(walks)
                for d in range(SAMPLES):
                    if d == 0:
                        keep = first[s]
                        key = s[keep].astype(np.int64)
                    else:
                        key = key * self.base + s
                        at = np.minimum(np.searchsorted(prefixes[d - 1], key), len(prefixes[d - 1]) - 1)
                        keep = prefixes[d - 1][at] == key
                        key = key[keep]
                    p = p[keep]
                    if not len(p) or d == SAMPLES - 1:
                        break
                    s = walks.send(keep)
                if len(p):
                    lo, hi = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
                    n = hi - lo
                    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    found.append(np.repeat(p, n) * len(self.lens) + rows[np.repeat(lo, n) + within])
        pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        return pairs // len(self.lens), pairs % len(self.lens)

    def matches(self, symbols, outside, ends):
        """(start, item number, edits, words of the item) of every candidate that is a match."""
        starts, rows = self.candidates(symbols, outside, ends)
        for at in range(0, len(starts), 4096):
            s, r = starts[at : at + 4096], rows[at : at + 4096]
            d = edits(self.items[r], self.lens[r], symbols, s, self.bound[r])
            ok = d <= self.bound[r]
            yield from zip(s[ok].tolist(), self.numbers[r[ok]].tolist(), d[ok].tolist(), self.lens[r[ok]].tolist(), strict=True)


class ExactClass(SizeClass):
    """Items of one number of words that no edit is allowed to: windows are looked up by their first words, then compared."""

    def __init__(self, items: list[np.ndarray], numbers: list[int], vocabulary: int):
        n = len(items[0])
        self.lens, self.numbers, self.low, self.most = np.full(len(items), n), np.array(numbers), n, n
        self.bound, self.sure, self.reach, self.steps, self.repetitions = np.zeros(len(items), int), n, n + 1, n, 1
        self.items, self.base, self.depth = np.array(items, np.int32), vocabulary + 2, min(n, SAMPLES)
        self.keys, self.rows = self._table_of(self.items.astype(np.int64))

    def _key(self, columns):
        return functools.reduce(lambda key, c: key * self.base + c, columns[1:], columns[0])

    def _table_of(self, items):
        keys = self._key([items[:, k] for k in range(self.depth)])
        order = np.argsort(keys, kind="stable")
        return keys[order], order

    def candidates(self, symbols, outside, ends):
        starts = np.flatnonzero((symbols[:ends] > 0) & (outside[self.sure : ends + self.sure] == outside[:ends]))
        key = self._key([symbols.take(starts + k) for k in range(self.depth)])
        lo, hi = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, "right")
        n = hi - lo
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(starts, n), self.rows[np.repeat(lo, n) + within]


def pieces_of(n: int, count: int) -> list[tuple[int, int]]:
    """First and end of ``count`` parts of n words, as equal as can be."""
    cuts = [n * k // count for k in range(count + 1)]
    return [*zip(cuts, cuts[1:], strict=False)]


def nearest_window(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The fewest edits between an item and any window of a text, and the first word of the first such window."""
    backward = text[::-1]
    d, ramp = np.zeros(len(text) + 1, np.int32), np.arange(len(text) + 1, dtype=np.int32)
    for k, word in enumerate(item[::-1], 1):  # windows start anywhere backward, that is, end anywhere
        new = np.empty_like(d)
        new[0] = k
        np.minimum(d[:-1] + (backward != word), d[1:] + 1, out=new[1:])
        d = np.minimum.accumulate(new - ramp) + ramp
    least = int(d.min())
    return least, len(text) - int(np.flatnonzero(d == least)[-1])


class Index:
    """The items of one block, by size class. A unit is an item or a piece of one.

    repetitions: for each group of units of similar size, as fitted before; -1 where units are looked up by exact parts.
    """

    def __init__(self, items: list[tuple[int, str]], edit_share: float, recall: float, min_words: int, repetitions: list[int] | None = None):
        split = [(i, words(t)) for i, t in items]
        split = [(i, w) for i, w in split if len(w) >= max(1, min_words)]
        names = sorted({x for _, w in split for x in w})
        self.symbol = {w: k + 1 for k, w in enumerate(names)}
        self.wholes = [(i, np.array([self.symbol[x] for x in w], np.int32), int(len(w) * edit_share + 1e-9)) for i, w in split]
        #: whole, first word in it, and whether it is a piece: then its whole is compared where it is met
        self.units: list[tuple[int, int, bool]] = []
        cut = []
        for k, (_, w, _) in enumerate(self.wholes):
            for first, end in pieces_of(len(w), -(-len(w) // PIECE) if len(w) > LONG else 1):
                cut.append((len(w[first:end]), len(self.units), w[first:end]))
                self.units.append((k, first, len(w) > LONG))
        self.classes: list[SizeClass] = []
        self.repetitions: list[int] = []
        low, group = 0, []
        for n, unit, w in [*sorted(cut, key=lambda x: x[:2]), (0, -1, None)]:
            exact = low * edit_share + 1e-9 < 1
            if group and (w is None or n > max(low * 1.3, low + 1) or (exact and n > low)):
                known = repetitions[len(self.repetitions)] if repetitions else None
                self.repetitions.append(self._group(group, exact, edit_share, recall, len(names), known))
                group = []
            if w is not None:
                low = low if group else n
                group.append((unit, w))
        self.gap = max((max(c.reach, c.steps) + 2 for c in self.classes), default=1)

    def _group(self, group, exact: bool, edit_share: float, recall: float, vocabulary: int, known: int | None) -> int:
        """Adds the classes of a group of units and gives its repetitions."""
        numbers, coded = [u for u, _ in group], [w for _, w in group]
        if exact:
            self.classes.append(ExactClass(coded, numbers, vocabulary))
            return 1
        if known != -1:
            try:
                self.classes.append(SizeClass(coded, numbers, edit_share, recall, vocabulary, len(self.repetitions) * 10 + 7, known))
                return self.classes[-1].repetitions
            except ValueError:
                pass
        parts: dict[int, list] = {}
        for unit, w in group:
            whole, begin, _ = self.units[unit]
            for first, end in pieces_of(len(w), min(int(len(w) * edit_share + 1e-9) + 1, len(w))):
                parts.setdefault(end - first, []).append((len(self.units), w[first:end]))
                self.units.append((whole, begin + first, True))
        for of_size in parts.values():
            self.classes.append(ExactClass([w for _, w in of_size], [u for u, _ in of_size], vocabulary))
        return -1

    def search(self, texts: list[str | None]):
        """(text's place, item, edits, words of the item, first word of the window) for whole texts."""
        get, zeros = self.symbol.get, [0] * self.gap
        flat: list[int] = []
        begins = []
        for t in texts:
            begins.append(len(flat))
            flat += [get(w, 0) for w in words(t)]
            flat += zeros
        symbols = np.array(flat + zeros, np.int64)
        outside = np.concatenate([[0], np.cumsum(symbols == 0)])
        begins_ = np.array(begins)
        ends = np.append(begins_[1:], len(flat)) - self.gap
        best: dict = {}
        met: dict[tuple[int, int], set[int]] = {}
        for c in self.classes:
            for start, unit, d, n in c.matches(symbols, outside, len(flat)):
                k = int(np.searchsorted(begins_, start, "right")) - 1
                whole, first, piece = self.units[unit]
                if piece:
                    met.setdefault((k, whole), set()).add(start - first)
                else:
                    item = self.wholes[whole][0]
                    best[k, item] = min(best.get((k, item), (1 << 30, 0, 0)), (d, start - begins[k], n))
        for (k, whole), starts in met.items():
            item, w, e = self.wholes[whole]
            for low, high in _joined(sorted(starts), 2 * e + 1):
                low, high = max(low - e, begins[k]), min(high + len(w) + 2 * e, int(ends[k]))
                d, at = nearest_window(w, symbols[low:high])
                if d <= e:
                    best[k, item] = min(best.get((k, item), (1 << 30, 0, 0)), (d, low + at - begins[k], len(w)))
        return [(k, item, d, n, at) for (k, item), (d, at, n) in sorted(best.items())]


def _joined(places: list[int], apart: int):
    """First and last of runs of places less than ``apart`` apart."""
    begin = places[0]
    for a, b in zip(places, [*places[1:], None], strict=True):
        if b is None or b - a >= apart:
            yield begin, a
            begin = b


@functools.lru_cache(maxsize=2)
def _index(items: tuple, edit_share: float, recall: float, min_words: int, repetitions: tuple) -> Index:
    return Index(list(items), edit_share, recall, min_words, list(repetitions))


def _blocks(docs: DataFrame, benchmark: DataFrame, edit_share: float, recall: float, min_words: int, block_items: int):
    """For each block of items a function that gives the index of it, on driver or executor."""
    n_blocks = max(1, -(-benchmark.count() // block_items))
    for block in range(n_blocks):
        lot = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block
        items = tuple((r["item_id"], r["text"] or "") for r in benchmark.select("item_id", "text").where("item_id is not null").where(lot).distinct().orderBy("item_id", "text").collect())
        fitted = tuple(Index(list(items), edit_share, recall, min_words).repetitions)
        shared = docs.sparkSession.sparkContext.broadcast((items, fitted))  # about block_items texts

        def index(shared=shared):
            items, fitted = shared.value
            return _index(items, edit_share, recall, min_words, fitted)

        yield index


def leaks(docs: DataFrame, benchmark: DataFrame, edit_share: float = 0.2, recall: float = 0.95, min_words: int = 1, block_items: int = 2000) -> DataFrame:
    """doc_id, item_id, n_edits, item_words and first_word (of the window) of each document and item that it leaks."""
    out = None
    for index in _blocks(docs, benchmark, edit_share, recall, min_words, block_items):

        def run(batches, index=index):
            for batch in blocks(batches, 200):
                ids = batch.column(0).to_pylist()
                found = index().search(batch.column(1).to_pylist())
                cols = list(zip(*found, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in cols[0]], pa.int64()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["doc_id", "item_id", "n_edits", "item_words", "first_word"])

        part = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, item_id bigint, n_edits bigint, item_words bigint, first_word bigint")
        out = part if out is None else out.union(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, edit_share: float = 0.2, recall: float = 0.95, min_words: int = 1, block_items: int = 2000) -> DataFrame:
    """The rows of ``docs`` whose text leaks no item, each judged by itself whatever its doc_id; a map."""
    for index in _blocks(docs, benchmark, edit_share, recall, min_words, block_items):

        def run(batches, index=index):
            for batch in blocks(batches, 200):
                leaked = {k for k, *_ in index().search(batch.column(batch.schema.names.index("text")).to_pylist())}
                yield batch.filter(pa.array([k not in leaked for k in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
