"""Token ids of a corpus in files of patched frame-of-reference blocks.

A file holds the documents of one range of doc_id, in ascending order. Its ids are cut into blocks of 4,096. Of
each block the minimum is subtracted; what is left is packed at the smallest width that holds 90 % of the values;
the rest, the exceptions, are stored whole with their places. A segment row is whole documents, 64 blocks and the
rest of the last document at most, with an index of block starts, so that a reader can begin at any segment or
block. Spark's writer commits the files, hence a lost or repeated task leaves no half file, and any file system of
Spark's will do.

``write`` needs one shuffle of the texts, by range of doc_id; ``read`` is a map over segments, to which only the
start of each file, a sum for each file, is sent. Defined results: a null or empty text is one document with the end id alone; documents
with one doc_id (or a null one, which come first) stand in the order of a hash of their text; other columns aren't stored;
an empty table gives a table of no files.

Block layout, little-endian: count u32, minimum u32, width u8, exceptions u32, packed values (ceil(count * width
/ 8) bytes, lowest bit first), exception places u32 each, exception values u32 each.
Segment payload: blocks u32, start of each block u32, the blocks.
"""

from __future__ import annotations

import functools
import os
import string
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from specula.llm.bpe_automaton import byte_symbols
from specula.llm.bpe_codec import blocks as small_batches
from specula.llm.common import partitions, shared_dir, table, texts_of
from specula.llm.pretokens import LONGEST

BLOCK = 4096
SEGMENT = 64 * BLOCK
PERCENTILE = 90
ARROW = [("file", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("payload", pa.binary())]
FILE_SCHEMA = "file int, segment int, first bigint, doc_ids array<bigint>, lengths array<bigint>, n_tokens bigint, payload binary"


def pack_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    low = int(ids.min()) if len(ids) else 0
    rest = ids.astype(np.uint32) - np.uint32(low)
    wide = np.sort(rest)[max(0, int(np.ceil(len(rest) * percentile / 100)) - 1)] if len(rest) else 0
    width = int(wide).bit_length()
    odd = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    kept = rest.copy()
    kept[odd] = 0
    bits = (kept[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    packed = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
    return struct.pack("<IIBI", len(ids), low, width, len(odd)) + packed + odd.astype("<u4").tobytes() + rest[odd].astype("<u4").tobytes()


def unpack_block(data: bytes, at: int = 0) -> np.ndarray:
    count, low, width, n_odd = struct.unpack_from("<IIBI", data, at)
    at += 13
    n_bytes = (count * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, n_bytes, at), count=count * width, bitorder="little").reshape(count, width)
    out = (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(1, dtype=np.uint32)
    at += n_bytes
    places = np.frombuffer(data, "<u4", n_odd, at)
    out[places] = np.frombuffer(data, "<u4", n_odd, at + 4 * n_odd)
    return out + np.uint32(low)


def pack_segment(ids: np.ndarray) -> bytes:
    packed = [pack_block(ids[k : k + BLOCK]) for k in range(0, len(ids), BLOCK)]
    head = 4 * (len(packed) + 1)
    starts = head + np.cumsum([0, *map(len, packed[:-1])]) if packed else np.empty(0)
    return struct.pack("<I", len(packed)) + np.asarray(starts).astype("<u4").tobytes() + b"".join(packed)


def unpack_segment(data: bytes) -> np.ndarray:
    n = struct.unpack_from("<I", data)[0]
    parts = [unpack_block(data, s) for s in np.frombuffer(data, "<u4", n, 4).tolist()]
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)


class LibraryPieces:
    """Ids of texts by the tokenizers library, asked for each word once while it is remembered (64 characters at most).

    For vocabularies that lower case, drop white space and keep letters apart from other characters: the ids of a text
    are then those of its pieces between spaces and line ends, one after another, and a piece of letters with ASCII
    marks behind has the ids of the letters in lower case and of the marks. Such words and runs of marks go to the
    library's model at once, as its normalizing and splitting leave them whole; pieces of any other kind, and letters
    beyond U+024F, go through the library's whole chain.
    """

    def __init__(self, tokenizer, most: int = 400_000):
        self.tokenizer, self.tokenize, self.most = tokenizer, tokenizer.model.tokenize, most
        self.stand_ins = {b: c for c, b in byte_symbols().items()}
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.young = self._generation()

    def _generation(self) -> dict[str, bytes]:
        """Remembered pieces; one that isn't there is looked up among those before, or made."""
        old, word, whole = self.old, self._word, self.tokenizer.encode

        class Pieces(dict):
            def __missing__(self, piece: str) -> bytes:
                if (v := old.get(piece)) is None:
                    stem = piece.rstrip(string.punctuation)
                    low = stem.lower()
                    if low.isalpha() and (low.isascii() or max(low) <= "\u024f"):
                        v = word(low) if len(stem) == len(piece) else word(low) + word(piece[len(stem) :])
                    else:
                        v = np.array(whole(piece, add_special_tokens=False).ids, "<u4").tobytes()
                if len(piece) <= LONGEST:
                    self[piece] = v
                return v

        return Pieces()

    def _word(self, word: str) -> bytes:
        if (v := self.words.get(word)) is None:
            ids = [t.id for t in self.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.stand_ins))]
            if len(self.words) >= self.most:
                self.words.clear()
            v = struct.pack(f"<{len(ids)}I", *ids)
            if len(word) <= LONGEST:
                self.words[word] = v
        return v

    def of(self, text: str) -> bytes:
        if len(self.young) > self.most:  # what was remembered longest goes
            self.old = dict(self.young)
            self.young = self._generation()
        return b"".join(map(self.young.__getitem__, text.replace("\n", " ").split(" ")))


@functools.lru_cache(maxsize=2)
def _pieces(content: str) -> LibraryPieces:
    """The remembered pieces of a Python process; its tasks share them."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(content)
    t.no_truncation()
    t.no_padding()
    return LibraryPieces(t)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, files: int | None = None) -> None:
    """Write the ids of ``docs`` (doc_id, text), each document closed by ``end_id``, as segment rows below ``path``."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())  # a vocabulary, of fixed size

    def run(batches):
        from pyspark import TaskContext

        pieces, end = _pieces(content.value), np.array([end_id], "<u4").tobytes()
        file, segment, first, held, ids, lens = TaskContext.get().partitionId(), 0, 0, bytearray(), [], []

        def row():
            nonlocal segment, first, held, ids, lens
            n = len(held) // 4
            out = [[file], [segment], [first], [ids], [lens], [n], [pack_segment(np.frombuffer(bytes(held), "<u4"))]]
            segment, first, held, ids, lens = segment + 1, first + n, bytearray(), [], []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, ARROW, strict=True)], names=[k for k, _ in ARROW])

        for batch in small_batches(batches):
            for doc, coded in zip(batch.column(0).to_pylist(), map(pieces.of, texts_of(batch, "text")), strict=True):
                held += coded + end
                ids.append(doc)
                lens.append(len(coded) // 4 + 1)
                if len(held) >= 4 * SEGMENT:
                    yield row()
        if ids:
            yield row()

    order = [F.col("doc_id").asc_nulls_first(), F.col("h").asc()]  # the driver gets a sample of these two numbers, never of texts
    ranged = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange(files or partitions(docs), *order)
    ranged.sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, FILE_SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids (binary, u32)."""
    segments = spark.read.schema(FILE_SCHEMA).parquet(path)
    files = segments.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    # one row of two numbers for each file, of which there are as many as shuffle partitions: small whatever the data
    before = files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("file_start"))

    def run(batches):
        for batch in batches:
            for x in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                lens = np.array(x["lengths"], np.int64)
                starts = np.cumsum(lens) - lens
                ids = unpack_segment(x["payload"]).astype("<u4").tobytes()
                coded = [ids[4 * s : 4 * (s + n)] for s, n in zip(starts.tolist(), x["lengths"], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x["doc_ids"], pa.int64()), pa.array(starts + (x["file_start"] + x["first"])), pa.array(lens), pa.array(coded, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return segments.join(F.broadcast(before), "file").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    path = f"{shared_dir(spark)}/specula/tokens-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
