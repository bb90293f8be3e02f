"""Exact token counts without token ids, by dynamic programming over prefixes.

For each pre-split word the token count of every prefix follows from the counts of shorter ones: exactly one
token that ends at a place may follow the tokens before it. ``token_counts`` stores them for a whole text: one signed
byte for each byte of the text, the change of the count there, from which ``count_at`` and ``longest_within`` answer
questions on truncation and budgets later without encoding. A document's count is its last stored one.

A stored count is that of the text cut there, wherever a character ends. Three things change when more of a text is
known, and are stored as they are without it: a run of white space at the end is one word, of which the last character
goes to a word that follows; a contraction such as 'll is a mark and letters until it is whole; and so is a special
string, which may even lengthen the word before it until it is whole.

A map without a shuffle. Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows stay;
other columns pass through unless they bear the name of an added column, which then replaces them.
"""

from __future__ import annotations

from array import array
from operator import sub

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from specula.llm.bpe_automaton import BpeAutomaton
from specula.llm.bpe_codec import blocks, schema_with, shared_automaton, with_columns
from specula.llm.common import table
from specula.llm.prefix_table import PrefixTable
from specula.llm.pretokens import PieceMap


class PrefixCounts:
    """Changes of the token count of a text's prefixes, as bytes, through the automaton ``a``."""

    #: Pieces, and words, that a process remembers in a generation, of at most 64 characters: about 200 MB with both generations.
    MOST = 500_000
    #: Fixed value: what a byte-level vocabulary splits off as a word when it is whole.
    CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

    def __init__(self, a: BpeAutomaton):
        self.a = a
        self.marks = {w.encode(): [0, *(n + 1 for n in a.prefix_counts(w[1:-1].encode())), len(a.encode(w.encode()))] for w in self.CONTRACTIONS}
        self.pieces = PieceMap(self.of_word, b"".join, dict.fromkeys(a.special, b""), most=self.MOST, of_words=self.of_words, of_special=self.of_special)
        self.plain = PieceMap(self.of_word, b"".join, of_words=self.of_words)
        self.table = PrefixTable(a)

    def learn(self, texts: list[str]) -> None:
        self.pieces.learn(texts, self._of_many)

    def of_all(self, texts: pa.Array) -> pa.Array:
        """Changes over each text of an array, as ``pieces.of`` gives them."""
        return self.pieces.of_all(texts, self._of_many)

    def _of_many(self, words: list[bytes]) -> list[bytes]:
        return [self.of_word(w) if w in self.marks else v for w, v in zip(words, self.table.changes(words), strict=True)]

    @staticmethod
    def packed(counts: list[int]) -> bytes:
        """Changes from count to count; an OverflowError if one is more than a signed byte holds."""
        return array("b", map(sub, counts[1:], counts)).tobytes()

    def counts(self, word: bytes) -> list[int]:
        return self.marks.get(word) or self.a.prefix_counts(word)

    def of_word(self, word: bytes) -> bytes:
        return self.packed(self.counts(word))

    def of_words(self, words: list[str]) -> bytes:
        """Of white space before a word that takes its last character, the whole run is one word until the next character."""
        all_, before, run = [0], 0, b""
        for w in words:
            coded = w.encode("utf-8", "surrogatepass")
            own = [before + n for n in self.counts(coded)]
            last = own[-1]
            if run and w[0].isspace():
                first = w[0].encode()
                own[len(first)] = before - self.a.prefix_counts(run)[-1] + self.a.prefix_counts(run + first)[-1]
            all_ += own[1:]
            before, run = last, coded if w.isspace() else b""
        return self.packed(all_)

    def of_special(self, before: str, special: str) -> bytes:
        """Changes over a text and the special string behind it, which counts as plain text until it is whole."""
        cut = self.plain.of(before + special[:-1])
        return cut + self.packed([count_at(cut, len(cut)), count_at(cut, len(before.encode("utf-8", "surrogatepass"))) + 1])


_COUNTS: dict[BpeAutomaton, PrefixCounts] = {}


def shared_counts(a: BpeAutomaton) -> PrefixCounts:
    """The counts of an automaton, its tables and remembered pieces; one a Python process, whatever it has of tasks."""
    if a not in _COUNTS:
        _COUNTS.clear()
        _COUNTS[a] = PrefixCounts(a)
    return _COUNTS[a]


def token_counts(docs: DataFrame, path: str, limit: int, text: str = "text", store: str = "prefixes") -> DataFrame:
    """``docs`` with n_bytes, n_tokens, over_limit (n_tokens > limit) and the stored counts of all prefixes in ``store``."""
    automaton = shared_automaton(docs.sparkSession, path)
    added = {"n_bytes": T.LongType(), "n_tokens": T.LongType(), "over_limit": T.BooleanType(), store: T.BinaryType()}

    def run(batches):
        counts = shared_counts(automaton())
        for batch in blocks(batches, 2000):
            found = counts.of_all(batch.column(batch.schema.names.index(text)))
            n = totals(found)
            columns = {"n_bytes": pc.binary_length(found).cast(pa.int64()), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)}
            yield with_columns(batch, columns | {store: found})

    return docs.mapInArrow(run, schema_with(docs, added))


def count_at(stored: bytes, n_bytes: int) -> int:
    """Tokens of the text cut after ``n_bytes`` bytes."""
    return int(np.frombuffer(stored, np.int8, min(n_bytes, len(stored))).sum(dtype=np.int64))


def totals(stored: pa.Array) -> np.ndarray:
    """:func:`count_at` of whole texts: the last stored counts of an array."""
    _, ends, changes = stored.buffers()
    ends = np.frombuffer(ends, np.int32, len(stored) + 1, stored.offset * 4)
    counts = np.concatenate([[0], np.cumsum(np.frombuffer(changes or b"", np.int8, ends[-1]), dtype=np.int64)])
    return np.diff(counts[ends])


def longest_within(stored: bytes, budget: int) -> int:
    """Bytes of the longest prefix of which the count is at most ``budget``."""
    fits = np.flatnonzero(np.cumsum(np.frombuffer(stored, np.int8), dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024).select("doc_id", "n_bytes", "n_tokens", "over_limit")
