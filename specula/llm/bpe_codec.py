"""Byte-pair encoding and decoding of whole texts through the tokenization automaton.

``encode`` adds a document's token ids as little-endian unsigned 32-bit integers in one binary column, ``decode``
turns such a column back into text. Both are maps without a shuffle: nothing but the fixed vocabulary is shared
between tasks, so rows may be dealt out in any way and a lost task is run again by itself. Hot sources or groups
of copies don't matter.

Defined results: a null or empty text gives no ids (an empty binary), null or empty ids decode to the empty text,
repeated rows give repeated rows, other columns pass through unless they bear the name of an added column, which
then replaces them. Special strings inside a text give their special id, as the tokenizer file says by default.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specula.llm.bpe_automaton import BpeAutomaton, compile_json
from specula.llm.common import table
from specula.llm.prefix_table import PrefixTable
from specula.llm.pretokens import PieceMap

_COMPILED: dict[int, BpeAutomaton] = {}


def shared_automaton(spark: SparkSession, path: str):
    """A function giving the automaton on any executor: the file's content is broadcast, compiled once a process.

    The content is a vocabulary of fixed size, about 1.5 MB, and doesn't grow with the data.
    """
    with open(path, encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())

    def automaton() -> BpeAutomaton:
        key = hash(content.value)
        if key not in _COMPILED:
            _COMPILED[key] = compile_json(content.value)
        return _COMPILED[key]

    return automaton


def with_columns(batch: pa.RecordBatch, added: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = [k for k in batch.schema.names if k not in added]
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index(k)) for k in kept] + [*added.values()], names=[*kept, *added])


def schema_with(df: DataFrame, added: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name not in added] + [T.StructField(k, t) for k, t in added.items()])


def blocks(batches, rows: int = 500, most_bytes: int = 4 << 20):
    """Arrow batches in blocks of few rows and bytes (one row at least), so that what is made from long texts stays small."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, rows)
            while part.num_rows > 1 and part.nbytes > most_bytes:
                part = part.slice(0, part.num_rows // 2)
            yield part
            at += part.num_rows


class Encoder:
    """Token ids of texts, as bytes, through the automaton ``a``: new words of an array of texts are walked side by side."""

    #: Pieces, and words, that a process remembers in a generation, of at most 64 characters and so 1 KB of ids.
    MOST = 100_000

    def __init__(self, a: BpeAutomaton):
        pack = lambda t: struct.pack(f"<{len(t)}I", *t)
        self.table = PrefixTable(a)
        self.pieces = PieceMap(lambda w: pack(a.encode(w)), b"".join, {k: pack([v]) for k, v in a.special.items()}, most=self.MOST)

    def of_all(self, texts: pa.Array) -> pa.Array:
        return self.pieces.of_all(texts, self.table.ids)


class Decoder:
    """Texts of arrays of ids: the labels of the arcs read, put together by Arrow; bytes that are no UTF-8 are replaced."""

    def __init__(self, label: dict[int, bytes]):
        self.labels = pa.array([label.get(t) for t in range(max(label) + 1)], pa.binary())

    def of_all(self, ids: pa.Array) -> pa.Array:
        ids = pc.fill_null(ids, b"")
        _, ends, arcs = ids.buffers()
        ends = np.frombuffer(ends, np.int32, len(ids) + 1, ids.offset * 4)
        if (np.diff(ends) % 4).any():
            raise ValueError("ids are 32-bit integers")
        read = self.labels.take(pa.array(np.frombuffer(arcs or b"", "<u4", (ends[-1] - ends[0]) // 4, ends[0])))
        if read.null_count:
            raise KeyError("an id has no token in this vocabulary")
        stops = np.frombuffer(read.buffers()[1], np.int32, len(read) + 1)[(ends - ends[0]) // 4]
        coded = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(stops.tobytes()), read.buffers()[2]])
        try:
            return coded.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in coded.to_pylist()], pa.string())


_ENCODERS: dict[BpeAutomaton, Encoder] = {}


def shared_encoder(a: BpeAutomaton) -> Encoder:
    """The encoder of an automaton with its remembered pieces; one a Python process, whatever it has of tasks."""
    if a not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[a] = Encoder(a)
    return _ENCODERS[a]


def _coded(found: pa.Array, ids: str) -> dict[str, pa.Array]:
    return {ids: found, "n_tokens": pc.divide(pc.binary_length(found), 4).cast(pa.int64())}


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the column ``ids`` (binary) and ``n_tokens`` (long)."""
    automaton = shared_automaton(docs.sparkSession, path)

    def run(batches):
        encoder = shared_encoder(automaton())
        for batch in blocks(batches, 2000):
            yield with_columns(batch, _coded(encoder.of_all(batch.column(batch.schema.names.index(text))), ids))

    return docs.mapInArrow(run, schema_with(docs, {ids: T.BinaryType(), "n_tokens": T.LongType()}))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the column ``text``: the labels of the arcs read, special tokens included, bytes that are no UTF-8 replaced."""
    with open(path, encoding="utf-8") as f:
        labels = df.sparkSession.sparkContext.broadcast(compile_json(f.read()).label)

    def run(batches):
        decoder = Decoder(labels.value)
        for batch in blocks(batches):
            yield with_columns(batch, {text: decoder.of_all(batch.column(batch.schema.names.index(ids)))})

    return df.mapInArrow(run, schema_with(df, {text: T.StringType()}))


def round_trip(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """What ``encode`` and then ``decode`` give, in one pass of one Python process a task."""
    automaton = shared_automaton(docs.sparkSession, path)

    def run(batches):
        encoder, decoder = shared_encoder(automaton()), Decoder(automaton().label)
        for batch in blocks(batches, 2000):
            found = encoder.of_all(batch.column(batch.schema.names.index(text)))
            yield with_columns(batch, _coded(found, ids) | {decoded: decoder.of_all(found)})

    return docs.mapInArrow(run, schema_with(docs, {ids: T.BinaryType(), "n_tokens": T.LongType(), decoded: T.StringType()}))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of a document's ids and of the text decoded from them."""
    coded = round_trip(docs.select("doc_id", "text"), path)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
