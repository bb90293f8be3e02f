"""Fill-in-the-middle rearrangement: a text is cut twice at ends of units, and its parts change order.

Characters fall into a few classes, and a wavelet matrix over the classes of a text answers how many of a class stand
before a place (rank) and where the k-th of a class stands (select). A unit ends after a character of certain classes;
how many units end before a place is a sum of ranks. With one closing class a cut is a select, with several it is found
by bisection on the sum of ranks.

The draw is by a hash of a seed and doc_id, so it is the same however rows are dealt out. A map without a shuffle.

Defined results: a null text is empty; a null doc_id is drawn as an empty one; rows that repeat a doc_id are drawn
alike; texts that are empty or hold a marker stay plain, with null lengths; an empty table gives no rows; other columns
pass through unless they bear the name of an added one, which then replaces them. The matrix takes about half a
byte and 3 bytes more a character while it is made, whatever the length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specula.llm.bpe_codec import schema_with, with_columns
from specula.llm.common import table

MARKERS = ("<P>", "<S>", "<M>")
#: Classes of characters: anything else, line feed, ends of sentences, inner stops, blanks.
OTHER, LINE, SENTENCE, STOP, BLANK = range(5)
_OF = {"\n": LINE, ".": SENTENCE, "!": SENTENCE, "?": SENTENCE, ",": STOP, ";": STOP, ":": STOP, " ": BLANK, "\t": BLANK}
#: The classes that close a unit.
UNITS = {"line": (LINE,), "sentence": (LINE, SENTENCE), "piece": (LINE, SENTENCE, STOP), "word": (LINE, BLANK)}
_CLASS = np.zeros(128, np.uint8)
for _c, _k in _OF.items():
    _CLASS[ord(_c)] = _k


def classes(text: str, part: int = 1 << 20) -> np.ndarray:
    """The class of each code point, taken in parts."""
    out = np.empty(len(text), np.uint8)
    for at in range(0, len(text), part):
        points = np.frombuffer(text[at : at + part].encode("utf-32-le", "surrogatepass"), np.uint32)
        out[at : at + len(points)] = np.where(points < 128, _CLASS[np.minimum(points, 127)], OTHER)
    return out


class WaveletMatrix:
    """Ranks and selects over a sequence of small numbers: a level for each bit, ones moved behind zeros after it."""

    def __init__(self, values: np.ndarray, bits: int) -> None:
        self.n, self.bits = len(values), bits
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        for bit in range(bits - 1, -1, -1):
            one = (values >> bit & 1).astype(bool)
            packed = np.packbits(one, bitorder="little")
            packed = np.append(packed, np.zeros(8 - len(packed) % 8, np.uint8)).view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.levels.append((packed, before, self.n - int(before[-1])))
            values = np.concatenate([values[~one], values[one]])

    def _ones(self, level: int, at: int) -> int:
        packed, before, _ = self.levels[level]
        word, rest = at >> 6, at & 63
        return int(before[word]) + (int(packed[word]) & ((1 << rest) - 1)).bit_count()

    def rank(self, value: int, at: int) -> int:
        """How many of ``value`` stand before ``at``."""
        begin = 0
        for level, (_, _, zeros) in enumerate(self.levels):
            a, b = self._ones(level, begin), self._ones(level, at)
            begin, at = (zeros + a, zeros + b) if value >> (self.bits - 1 - level) & 1 else (begin - a, at - b)
        return at - begin

    def select(self, value: int, k: int) -> int:
        """Where the k-th of ``value`` stands, k from 1; it must be there."""
        begins = [0]
        for level, (_, _, zeros) in enumerate(self.levels):
            a = self._ones(level, begins[-1])
            begins.append(zeros + a if value >> (self.bits - 1 - level) & 1 else begins[-1] - a)
        at = begins[-1] + k - 1
        for level in range(self.bits - 1, -1, -1):
            zeros = self.levels[level][2]
            if value >> (self.bits - 1 - level) & 1:
                at = self._find(level, at - zeros + 1, True)
            else:
                at = self._find(level, at + 1, False)
        return at

    def _find(self, level: int, k: int, one: bool) -> int:
        """Where the k-th one, or zero, of a level stands."""
        packed, before, _ = self.levels[level]
        lo, hi = 0, len(packed)  # words before lo hold fewer than k
        while hi - lo > 1:
            mid = (lo + hi) // 2
            held = int(before[mid]) if one else mid * 64 - int(before[mid])
            lo, hi = (mid, hi) if held < k else (lo, mid)
        k -= int(before[lo]) if one else lo * 64 - int(before[lo])
        word = int(packed[lo]) if one else ~int(packed[lo])
        bits = np.flatnonzero(np.unpackbits(np.array([word & (2**64 - 1)], np.uint64).view(np.uint8), bitorder="little"))
        return lo * 64 + int(bits[k - 1])


class Units:
    """The units of a text: how many there are, and where the first k of them end."""

    def __init__(self, text: str, unit: str) -> None:
        self.closing, self.length = UNITS[unit], len(text)
        of = classes(text)
        self.matrix = WaveletMatrix(of, 3)
        self.closed = self.before(self.length)
        self.count = self.closed + int(self.length > 0 and int(of[-1]) not in self.closing)

    def before(self, at: int) -> int:
        """How many units end before ``at``: ranks of the closing classes together."""
        return sum(self.matrix.rank(c, at) for c in self.closing)

    def cut(self, k: int) -> int:
        if k == 0:
            return 0
        if k > self.closed:
            return self.length
        if len(self.closing) == 1:
            return self.matrix.select(self.closing[0], k) + 1
        lo, hi = 0, self.length  # before(lo) < k <= before(hi)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.before(mid) < k else (lo, mid)
        return hi


def draws(seed: int, doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def rearranged(text: str, doc_id: int | None, unit: str, rate: int, spm: int, seed: int) -> tuple:
    """n, form, lengths of prefix and middle, and the output."""
    h1, h2, h3, h4 = draws(seed, doc_id)
    units = Units(text, unit)
    n = units.count
    if not text or any(m in text for m in MARKERS) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = units.cut(a), units.cut(b)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = MARKERS
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


_ADDED = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType()}


def fill_in_middle(docs: DataFrame, unit: str = "line", rate: int = 100, spm: int = 50, seed: int = 7) -> DataFrame:
    """``docs`` with n (units), form, prefix_chars, middle_chars (code points) and output.

    ``rate`` percent of the documents are rearranged, of these ``spm`` percent with the suffix first.
    """

    def run(batches):
        for batch in batches:
            for part, texts, ids in _by_bytes(batch):
                found = list(zip(*(rearranged(t or "", k, unit, rate, spm, seed) for t, k in zip(texts, ids, strict=True)), strict=True))
                yield with_columns(part, {k: pa.array(x, pa.string() if t == T.StringType() else pa.int64()) for (k, t), x in zip(_ADDED.items(), found, strict=True)})

    return docs.mapInArrow(run, schema_with(docs, _ADDED))


def _by_bytes(batch: pa.RecordBatch, most: int = 8 << 20):
    """Parts of a batch of 1,000 rows or about ``most`` bytes of text, with their texts and ids."""
    text = batch.column(batch.schema.names.index("text"))
    ids = batch.column(batch.schema.names.index("doc_id"))
    begin, held = 0, 0
    for k in range(batch.num_rows):
        held += len(text[k].as_buffer() or b"") if text[k].is_valid else 0
        if k + 1 == batch.num_rows or held >= most or k + 1 - begin == 1000:
            part = slice(begin, k + 1)
            yield batch.slice(begin, k + 1 - begin), text[part].to_pylist(), ids[part].to_pylist()
            begin, held = k + 1, 0


def restored(output: str = "output", form: str = "form") -> Column:
    """The text again, from output and form alone."""
    p, s, m = MARKERS
    first, second = f"CASE {form} WHEN 'psm' THEN '{s}' ELSE '{p}' END", f"'{m}'"
    a = f"substring({output}, 4, instr({output}, {first}) - 4)"
    b = f"substring({output}, instr({output}, {first}) + 3, instr({output}, {second}) - instr({output}, {first}) - 3)"
    c = f"substring({output}, instr({output}, {second}) + 3)"
    return F.expr(f"CASE {form} WHEN 'psm' THEN concat({a}, {c}, {b}) WHEN 'spm' THEN concat({b}, {c}, {a}) ELSE {output} END")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return fill_in_middle(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored()).alias("restored_sha256"))


#: Lines by splitting, parts by joining them again.
SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units, [CAST('0x' || h[8 * k + 1:8 * k + 8] AS BIGINT) FOR k IN range(0, 4)] AS h FROM d),
c AS (SELECT *, len(units) AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b,
CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, n, form, text, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
