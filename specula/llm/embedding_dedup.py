"""Near-duplicate embeddings: a subspace pigeonhole join of vectors of one label.

Unit vectors with a cosine of ``threshold`` or more are at most 2 - 2 * threshold apart, squared. They are rotated (two
rounds of fixed random signs and a Hadamard transform) and split into blocks of few dimensions. Of two linked vectors at
least one block is within the block's proportional share of the squared distance, so each block is range-joined under its
share and the union of candidates is verified on the original vectors in double precision. A pair counts in the first
block that it passes and in one cell of it, so every link is counted once and no list of pairs is made anywhere.

The range join: the first coordinates of a block are a grid whose cells are twice as wide as the block's radius; a
vector goes to each cell that the cube of one radius about it meets, half a radius to each side, so two vectors in range
share a cell. How many coordinates are used grows with the number of vectors of a label. A cell above ``heavy`` vectors
is cut into parts, and pairs of parts meet in tasks of their own: no task holds more than two parts, and rows grow with
vectors times parts, never with pairs. A task gives each vector's links as a number, and of the links themselves a
spanning forest.

Vectors that repeat under a label are one vector with a weight. Defined results: a null label, a null or zero vector and
one with null or non-finite components link with nothing; vectors of different lengths don't link; rows that repeat a
vec_id are rows of their own; a null vec_id links like any other but names a component only if all of the component's
are null; an empty table gives no rows; of further columns none is kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specula.llm.common import table, written
from specula.llm.components import components

#: Dimensions of a block, and how many of them the grid can use.
BLOCK, GRID = 8, 6
#: Distances are rounded; this much is added to every share and radius.
SLACK = 1e-9


def rotated(x: np.ndarray, seed: int = 11) -> np.ndarray:
    """Rows of x rotated. Only sums and differences of two numbers, so a row's result doesn't depend on other rows."""
    size = 1 << max(x.shape[1] - 1, 0).bit_length()
    out = np.zeros((len(x), size))
    out[:, : x.shape[1]] = x
    signs = np.random.default_rng(seed).integers(0, 2, (2, size)) * 2.0 - 1.0
    for s in signs:
        out *= s
        half = 1
        while half < size:
            pairs = out.reshape(len(x), -1, 2, half)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(x), size)
            half *= 2
        out /= np.sqrt(size)
    return out


def _unit(column, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, their lengths and the rotated unit vectors."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    norm = np.sqrt(_dot(x, x))
    return x, norm, rotated(x / norm[:, None])


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.multiply(a, b).sum(1)


class _Range:
    """Blocks of a rotated space, their shares of the squared distance, and cells."""

    def __init__(self, dims: int, threshold: float) -> None:
        size = 1 << max(dims - 1, 0).bit_length()
        self.edges = [*range(0, size, BLOCK), size]
        self.blocks = len(self.edges) - 1
        shares = np.diff(self.edges) / size * (2 - 2 * threshold)
        self.share = shares + SLACK
        self.reach = np.sqrt(self.share) * (1 + SLACK) / 2

    def low(self, u: np.ndarray, block: int, grid: int) -> np.ndarray:
        """Lowest cell of each vector in the first ``grid`` coordinates; a pair's common cell is the higher of two."""
        x = u[:, self.edges[block] : self.edges[block + 1]][:, :grid]
        return np.floor((x - self.reach[block]) / (4 * self.reach[block])).astype(np.int64)

    def high(self, u: np.ndarray, block: int, grid: int) -> np.ndarray:
        x = u[:, self.edges[block] : self.edges[block + 1]][:, :grid]
        return np.floor((x + self.reach[block]) / (4 * self.reach[block])).astype(np.int64)

    def apart(self, u: np.ndarray, v: np.ndarray, block: int) -> np.ndarray:
        d = u[:, self.edges[block] : self.edges[block + 1]] - v[:, self.edges[block] : self.edges[block + 1]]
        return _dot(d, d)


def vectors(df: DataFrame) -> DataFrame:
    """label, embedding, first (smallest vec_id), copies and node of each different vector that can link."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = df.where(F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    return good.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies")).withColumn("node", F.monotonically_increasing_id())


def _placed(nodes: DataFrame, threshold: float, target: int) -> DataFrame:
    """label, dims, block, cell, node, copies and embedding: a row for each cell that a vector meets."""
    sized = nodes.withColumn("dims", F.size("embedding"))
    of_label = sized.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("n"))
    # coordinates of the grid: each parts a label's vectors about threefold
    grid = F.least(F.lit(GRID), F.greatest(F.lit(0), F.ceil(F.ln(F.col("n") / target) / math.log(3)))).cast("int")
    sized = sized.join(of_label.select("label", "dims", grid.alias("grid")), ["label", "dims"])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                dims, grids = (batch.column(batch.schema.names.index(c)).to_numpy() for c in ("dims", "grid"))
                for d, g in set(zip(dims.tolist(), grids.tolist(), strict=True)):
                    at_ = np.flatnonzero((dims == d) & (grids == g))
                    part = batch.take(pa.array(at_))
                    col = {c: part.column(part.schema.names.index(c)) for c in ("label", "dims", "node", "copies", "embedding")}
                    u, space = _unit(col["embedding"], d)[2], _Range(d, threshold)
                    use = min(g, d)
                    for block in range(space.blocks):
                        low, high = space.low(u, block, use), space.high(u, block, use)
                        rows, cells = np.arange(len(u)), low
                        for k in range(low.shape[1]):  # a cube is as wide as half a cell, so it meets two at most
                            both = np.flatnonzero(high[rows, k] > low[rows, k])
                            more = cells[both].copy()
                            more[:, k] += 1
                            rows, cells = np.concatenate([rows, rows[both]]), np.concatenate([cells, more])
                        key = [" ".join(map(str, c)) for c in cells.tolist()]
                        take = pa.array(rows)
                        yield pa.RecordBatch.from_arrays([col["label"].take(take), col["dims"].take(take), pa.array(np.full(len(rows), block, np.int32)), pa.array(key, pa.string()), *(col[c].take(take) for c in ("node", "copies", "embedding")), pa.array(np.full(len(rows), g, np.int32))], names=["label", "dims", "block", "cell", "node", "copies", "embedding", "grid"])

    kept = sized.select("label", "dims", "node", "copies", "embedding", "grid")
    kind = dict(sized.dtypes)
    return kept.mapInArrow(run, f"label {kind['label']}, dims int, block int, cell string, node bigint, copies bigint, embedding {kind['embedding']}, grid int")


_KEY = ["label", "dims", "block", "cell"]


def _parts(rows: DataFrame, heavy: int) -> DataFrame:
    """Rows with one and two, the parts of their cell that meet, and mine, the row's own part. A cell of one part meets itself."""
    parts = rows.groupBy(*_KEY).agg(F.ceil(F.count(F.lit(1)) / heavy).cast("int").alias("parts"))
    own = rows.join(parts, _KEY).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least("mine", k).alias("one"), F.greatest("mine", k).alias("two")))
    return own.select("*", F.explode(meets).alias("m")).select(*rows.columns, "mine", "m.one", "m.two")


def _groups(batches, key: list[str]):
    """Tables of the rows of one key; input sorted by key."""
    held: list[pa.Table] = []
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if held:
            t = pa.concat_tables([*held, t])
        differs = np.zeros(max(t.num_rows - 1, 0), bool)
        for c in key:
            codes = t.column(c).combine_chunks().dictionary_encode()
            ids = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
            differs |= ids[1:] != ids[:-1]
        begin = 0
        for end in (np.flatnonzero(differs) + 1).tolist():
            yield t.slice(begin, end - begin)
            begin = end
        held = [t.slice(begin)]
    if held:
        yield held[0]


def _linked(u, x, norm, lows, block: int, space: _Range, grid: int, threshold: float, left: np.ndarray, right: np.ndarray, same: bool, width: int = 256):
    """Pairs (i, j) that count in this block and cell: index arrays, part by part."""
    a, b = space.edges[block], space.edges[block + 1]
    square = _dot(u[:, a:b], u[:, a:b])
    for at in range(0, len(left), width):
        rows = left[at : at + width]
        near = square[rows][:, None] + square[right][None] - 2 * (u[rows, a:b] @ u[right, a:b].T) <= space.share[block] + SLACK
        if same:
            near &= rows[:, None] < right[None]
        i, j = np.nonzero(near)
        for part in range(0, len(i), 1 << 16):
            p, q = rows[i[part : part + (1 << 16)]], right[j[part : part + (1 << 16)]]
            ok = space.apart(u[p], u[q], block) <= space.share[block]
            p, q = p[ok], q[ok]
            for earlier in range(block):
                ok = space.apart(u[p], u[q], earlier) > space.share[earlier]
                p, q = p[ok], q[ok]
            ok = (np.maximum(lows[p], lows[q]) == grid).all(1)
            p, q = p[ok], q[ok]
            ok = _dot(x[p], x[q]) / (norm[p] * norm[q]) >= threshold
            yield p[ok], q[ok]


def _met(t: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes with the links they got here, and a spanning forest of these links."""
    first = {c: t.column(c)[0].as_py() for c in ("dims", "block", "cell", "grid", "one", "two")}
    node, copies, mine = (t.column(c).to_numpy() for c in ("node", "copies", "mine"))
    x, norm, u = _unit(t.column("embedding").combine_chunks(), first["dims"])
    space, block, use = _Range(first["dims"], threshold), first["block"], min(first["grid"], first["dims"])
    cell = np.array([int(c) for c in first["cell"].split()], np.int64)
    lows = space.low(u, block, use)
    same = first["one"] == first["two"]
    left = np.arange(len(node)) if same else np.flatnonzero(mine == first["one"])
    right = left if same else np.flatnonzero(mine == first["two"])
    n, tree, forest = np.zeros(len(node), np.int64), np.arange(len(node)), []
    for p, q in _linked(u, x, norm, lows, block, space, cell, threshold, left, right, same):
        n += np.bincount(p, copies[q], len(node)).astype(np.int64) + np.bincount(q, copies[p], len(node)).astype(np.int64)
        while len(p):  # hang higher trees on lower ones until all these links lie inside trees
            a, b = tree[p], tree[q]
            ok = a != b
            p, q, a, b = p[ok], q[ok], np.minimum(a[ok], b[ok]), np.maximum(a[ok], b[ok])
            if not len(p):
                break
            _, k = np.unique(b, return_index=True)
            forest.append(np.stack([node[p[k]], node[q[k]]]))
            tree[b[k]] = a[k]
            while (tree != tree[tree]).any():
                tree = tree[tree]
    got = np.flatnonzero(n)
    edges = np.concatenate(forest, 1) if forest else np.zeros((2, 0), np.int64)
    return node[got], n[got], edges[0], edges[1]


def links(nodes: DataFrame, threshold: float = 0.98, target: int = 2048, heavy: int = 8192) -> DataFrame:
    """node and n: numbers of links (rows on the other side) found in one task; a and b: edges of a spanning forest of each task's links."""

    def run(batches):
        for t in _groups(batches, [*_KEY, "one", "two"]):
            node, n, a, b = _met(t, threshold)
            for at in range(0, max(len(node), len(a)), 10_000):
                nothing = [None] * max(len(node[at : at + 10_000]), len(a[at : at + 10_000]))
                pad = lambda v: pa.array([*v[at : at + 10_000].tolist(), *nothing[len(v[at : at + 10_000]) :]], pa.int64())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pad(node), pad(n), pad(a), pad(b)], names=["node", "n", "a", "b"])

    key = [*_KEY, "one", "two"]
    met = _parts(_placed(nodes, threshold, target), heavy)
    return met.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "node bigint, n bigint, a bigint, b bigint")


def near_duplicates(df: DataFrame, threshold: float = 0.98, target: int = 2048, heavy: int = 8192) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``df`` (vec_id, embedding, label)."""
    rows = df.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", "label")
    nodes = written(vectors(rows), "vectors")
    found = written(links(nodes, threshold, target, heavy), "links")
    n = found.where("node IS NOT NULL").groupBy("node").agg(F.sum("n").alias("n"))
    of = components(found.where("a IS NOT NULL"), "a", "b")
    member = written(nodes.select("node", "first").join(of, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component")), "members")
    least = member.groupBy("component").agg(F.min("first").alias("component_id"))
    known = member.join(least, "component").select("node", "component_id").join(n, "node", "left")
    known = nodes.select("label", "embedding", "copies", "node").join(known, "node")
    known = known.select("label", "embedding", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.struct("component_id").alias("c"))
    out = rows.join(known, ["label", "embedding"], "left")
    component = F.when(F.col("c").isNull(), F.col("vec_id")).otherwise(F.col("c.component_id"))
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: Every pair of one label, and all that is reachable from a row.
SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT reach.vec_id, link.b FROM reach JOIN link ON link.a = reach.other)
SELECT vec_id, (SELECT count(*) FROM link WHERE link.a = reach.vec_id) AS n_links, min(other) AS component_id, vec_id = min(other) AS kept FROM reach GROUP BY vec_id"""
