"""Near-duplicates by SimHash: fingerprints within a few bits are linked, links make groups.

Fingerprints come from whole texts, by a map. Equal ones are one node. Links between different ones are found by a
self-join of the binary trie of fingerprints: pairs of trie nodes are walked together, differing bits add up, and a
pair is left when they exceed the budget. To share the walk out, the trie is built in ``bits + 1`` rotations: of two
fingerprints within the budget at least one block of bits agrees, so in that block's rotation the walk starts in a
common node, below the block, and each such node is walked in one task. A pair of nodes with more than
``heavy`` fingerprints is walked further by Spark itself: its fingerprints are dealt out to pairs of the nodes eight
bits below that are still within the budget, again and again while any is too large, so a very large group of near
copies spreads over many tasks and none holds more than ``heavy`` of one pair. A fingerprint
has no more than 2,080 others within two bits, hence links stay in proportion to fingerprints; copies aren't
expanded into pairs at all.

Defined results: a null or empty text, or one of separators only, has fingerprint 0 and is linked like any other;
fewer words than a shingle make one shingle; repeated rows with one doc_id stay separate rows; null doc_ids keep
their row and don't become a component's id unless all of the component's are null; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specula.llm.bpe_codec import blocks
from specula.llm.common import partitions, table, written
from specula.llm.components import components

WIDTH = 64


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Bits set in over half of the hashes of a text's shingles. Words are parted by the six ASCII separators."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), seed)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    line, starts = memoryview(b" ".join(words)), [0, *ends]
    hashes = np.array([digest(line[s : e - 1], seed) for s, e in zip(starts, ends[shingle - 1 :], strict=False)], np.uint64)
    counts = np.zeros(WIDTH, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # 8 bytes become 64
        part = hashes[at : at + (1 << 16)].astype(">u8")
        counts += np.unpackbits(part.view(np.uint8)).reshape(-1, WIDTH).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, h (hash of the text) and fp, the fingerprint as a signed long."""

    def run(batches):
        for batch in blocks(batches):
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps)], names=["doc_id", "h", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("h")).mapInArrow(run, "doc_id bigint, h bigint, fp bigint")


def _children(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where the nodes [lo, hi) of the sorted trie part at ``bit``: the first value that has it."""
    at, end = lo.copy(), hi.copy()
    while (open_ := at < end).any():  # binary search in all nodes at once
        mid = (at + end) // 2
        has = np.zeros(len(at), bool)
        has[open_] = (values[mid[open_]] >> np.uint64(bit)) & np.uint64(1) == 1
        end = np.where(open_ & has, mid, end)
        at = np.where(open_ & ~has, mid + 1, at)
    return at


def walk(values: np.ndarray, pairs: np.ndarray, top: int, bits: int, chunk: int = 1 << 17):
    """Walks pairs of trie nodes together and yields index pairs (i, j) of values within ``bits`` of each other.

    ``values`` is sorted inside each node; a row of ``pairs`` is (lo, hi, lo, hi, differing bits); ``top``: the bit
    below the nodes. Depth first in chunks, so memory is bounded.
    """
    stack = [(pairs, top)]
    while stack:
        p, bit = stack.pop()
        if len(p) > chunk:
            stack += [(p[chunk:], bit), (p[:chunk], bit)]
            continue
        small = (p[:, 1] - p[:, 0] <= 2) & (p[:, 3] - p[:, 2] <= 2)  # leaves are compared; below the last bit all are
        leaf, p = p[small], p[~small]
        for i in (0, 1):
            for j in (0, 1):
                yield from _leaves(values, leaf, i, j, bits)
        if not len(p):
            continue
        same = (p[:, 0] == p[:, 2]) & (p[:, 1] == p[:, 3])
        cut = np.stack([_children(values, p[:, 0], p[:, 1], bit), _children(values, p[:, 2], p[:, 3], bit)])
        below = []
        for x in (0, 1):
            for y in (0, 1):
                a = (p[:, 0], cut[0]) if x == 0 else (cut[0], p[:, 1])
                b = (p[:, 2], cut[1]) if y == 0 else (cut[1], p[:, 3])
                d = p[:, 4] + (x != y)
                keep = (a[0] < a[1]) & (b[0] < b[1]) & (d <= bits) & ~(same & (x > y))
                below.append(np.stack([a[0], a[1], b[0], b[1], d], 1)[keep])
        stack.append((np.concatenate(below), bit - 1))


def _leaves(values, leaf, i, j, bits):
    a, b = leaf[:, 0] + i, leaf[:, 2] + j
    same = leaf[:, 0] == leaf[:, 2]
    use = (a < leaf[:, 1]) & (b < leaf[:, 3]) & (a != b) & (~same | (a < b))
    a, b = a[use], b[use]
    near = np.bitwise_count(values[a] ^ values[b]) <= bits
    if near.any():
        yield a[near], b[near]


#: What names a pair of trie nodes: the rotation, how many levels it was dealt out, and the nodes' leading bits.
_PAIR = ["turn", "level", "low", "high"]


def _dealt(rows: DataFrame, sizes: list[int], bits: int, further: int) -> DataFrame:
    """Rows of pairs of nodes, dealt out to the pairs of nodes ``further`` bits below that are within ``bits``."""
    masks = [m for m in range(1 << further) if m.bit_count() <= bits]
    top = F.get(F.array(*map(F.lit, sizes)), F.col("turn"))
    width = F.least(F.lit(further), F.lit(WIDTH) - top - F.col("level") * further)  # the last level may be narrower
    below = F.call_function("shiftrightunsigned", "value", F.lit(WIDTH) - top - F.col("level") * further - width).bitwiseAND(F.call_function("shiftleft", F.lit(1), width) - 1)
    longer = lambda node: F.call_function("shiftleft", node, width)
    other = F.when(F.col("own") == F.col("low"), F.col("high")).otherwise(F.col("low"))
    # the other node's bits below differ from a row's own in a mask; masks past the budget or the level's width fall out
    near = F.filter(F.array(*[F.lit(m).cast("bigint") for m in masks]), lambda m: (F.bit_count(m) + F.bit_count(F.col("low").bitwiseXOR(F.col("high"))) <= bits) & (m < F.call_function("shiftleft", F.lit(1), width)))
    mine = longer(F.col("own")).bitwiseOR(below)
    met = rows.select("turn", "level", "value", mine.alias("mine"), F.transform(near, lambda m: longer(other).bitwiseOR(below.bitwiseXOR(m))).alias("others"))
    out = met.select("turn", (F.col("level") + 1).alias("below"), "value", "mine", F.explode("others").alias("other"))
    return out.select("turn", F.col("below").alias("level"), F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), F.col("mine").alias("own"), "value")


def _shared_out(rows: DataFrame, sizes: list[int], bits: int, heavy: int, further: int) -> DataFrame:
    """``rows`` with every pair of nodes above ``heavy`` rows dealt out, level by level, until none is left.

    At the last level a node is one fingerprint, so a pair has two rows and the levels end.
    """
    done = None
    while True:
        of_pair = rows.groupBy(*_PAIR).agg(F.count(F.lit(1)).alias("n"), ((F.col("low") == F.col("high")) | (F.min("own") < F.max("own"))).alias("is_met"))
        large = written(of_pair.where(F.col("n") > max(heavy, 2)).drop("n"), "large-nodes")
        small = rows.join(large, _PAIR, "left_anti").select(rows.columns)
        done = small if done is None else done.unionByName(small)
        if large.isEmpty():
            return done
        # a node whose fellow holds no fingerprint has no links in this pair
        rows = written(_dealt(rows.join(large.where("is_met"), _PAIR, "left_semi").select(rows.columns), sizes, bits, further), "dealt-nodes")


def links(nodes: DataFrame, bits: int = 2, heavy: int = 20_000, further: int = 8) -> DataFrame:
    """Pairs (a, b) of different values of ``fp`` within ``bits`` differing bits. ``nodes``: distinct values of fp."""
    turns = bits + 1
    edges = [WIDTH * k // turns for k in range(turns + 1)]
    turned = [F.expr(f"shiftleft(fp, {e}) | shiftrightunsigned(fp, {WIDTH - e})") if e else F.col("fp") for e in edges[:-1]]
    sizes = [b - a for a, b in zip(edges, edges[1:], strict=False)]
    rows = nodes.select(F.posexplode(F.array(*[F.struct(t.alias("value"), F.shiftrightunsigned(t, WIDTH - n).alias("low")) for t, n in zip(turned, sizes, strict=True)])).alias("turn", "x"))
    rows = rows.select("turn", F.lit(0).alias("level"), "x.low", F.col("x.low").alias("high"), F.col("x.low").alias("own"), "x.value")
    dealt = _shared_out(rows, sizes, bits, heavy, further)

    def run(batches):
        import pyarrow as pa

        for t in _whole_keys(batches):
            turn, level, low, high, own = (t.column(c).to_numpy() for c in (*_PAIR, "own"))
            values = t.column("value").to_numpy().view(np.uint64)
            order = np.lexsort((values, own, high, low, level, turn))
            turn, level, low, high, own, values = (x[order] for x in (turn, level, low, high, own, values))
            new = np.ones(len(values), bool)
            new[1:] = (turn[1:] != turn[:-1]) | (level[1:] != level[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (own[1:] != own[:-1])
            lo = np.flatnonzero(new)
            hi = np.append(lo[1:], len(values))
            alone = low[lo] == high[lo]
            twin = np.zeros(len(lo), bool)  # the second node of a pair of different nodes
            twin[1:] = (~alone[1:]) & (turn[lo[1:]] == turn[lo[:-1]]) & (level[lo[1:]] == level[lo[:-1]]) & (low[lo[1:]] == low[lo[:-1]]) & (high[lo[1:]] == high[lo[:-1]])
            for k in range(turns):
                t_ = turn[lo] == k
                a = np.flatnonzero(t_ & alone & (hi - lo > 1))
                b = np.flatnonzero(t_ & twin)
                # nodes of every level start at the bit below the block: the walk finds the common bits again
                start = np.concatenate([np.stack([lo[a], hi[a], lo[a], hi[a], 0 * a], 1), np.stack([lo[b - 1], hi[b - 1], lo[b], hi[b], 0 * b], 1)]).astype(np.int64)
                for i, j in walk(values, start, WIDTH - 1 - sizes[k], bits):
                    e = edges[k]
                    back = (lambda v: (v >> np.uint64(e)) | (v << np.uint64(WIDTH - e))) if e else (lambda v: v)
                    x, y = back(values[i]).view(np.int64), back(values[j]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return dealt.repartition(partitions(nodes), *_PAIR).sortWithinPartitions(*_PAIR).mapInArrow(run, "a bigint, b bigint").distinct()


def _whole_keys(batches, most: int = 100_000):
    """Tables of at least ``most`` rows that end where a key ends; input sorted by key."""
    held, n = [], 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        n += batch.num_rows
        if n >= most:
            t = pa.concat_tables(held)
            cols = [t.column(c).to_numpy() for c in _PAIR]
            differs = np.zeros(n - 1, bool)
            for c in cols:
                differs |= c[1:] != c[:-1]
            ends = np.flatnonzero(differs)
            if len(ends):
                yield t.slice(0, ends[-1] + 1)
                held, n = [t.slice(ends[-1] + 1)], n - ends[-1] - 1
            else:
                held = [t]
    if n:
        yield pa.concat_tables(held)


def _members(fps: DataFrame, first, bits: int) -> DataFrame:
    """fp, first (an aggregate over its rows) and component of each distinct fingerprint."""
    nodes = written(fps.groupBy("fp").agg(first.alias("first")), "distinct-fingerprints")
    found = components(links(nodes.select("fp"), bits), "a", "b")
    return nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, bits: int = 2, shingle: int = 3) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) of every row of ``docs``."""
    fps = written(fingerprints(docs, shingle).drop("h"), "fingerprints")
    member = _members(fps, F.min("doc_id"), bits)
    least = member.groupBy("component").agg(F.min("first").alias("component_id"))
    of_fp = written(member.join(least, "component").select("fp", "component_id"), "components")
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, bits: int = 2, shingle: int = 3) -> DataFrame:
    """Of each group of near copies one row of ``docs``: of the smallest doc_id, null last, then the smallest hash of the text.

    A row is known by doc_id, null or not, and text; of rows that repeat both one stays, put together before the shuffle.
    """
    fps = written(fingerprints(docs, shingle), "fingerprints")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    least = _members(fps, F.min(key), bits).groupBy("component").agg(F.min("first").alias("x"))
    stays = written(least.select(F.col("x.doc_id").alias("_doc_id"), F.col("x.h").alias("_h")), "first-copies")
    rows = docs.withColumn("_h_of", F.xxhash64("text")).dropDuplicates(["doc_id", "_h_of"])
    return rows.join(stays, rows["doc_id"].eqNullSafe(stays["_doc_id"]) & (rows["_h_of"] == stays["_h"]), "left_semi").select(docs.columns)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
