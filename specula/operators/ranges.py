"""Signals of any length, cut into blocks of neighbouring samples: numbering, halos and values carried from block to block.

No task holds a whole signal. A signal's samples get their places from counts of chunks of its ``at`` column, which is a
running number (dense or not); places make blocks of equal size. What a filter needs from neighbours is sent to their
blocks beforehand (a halo, reflected at a signal's ends), and what runs on from block to block (a maximum, a sum, the
state of a recursive filter) is carried by a scan over the blocks' summaries in two levels. Rows without a key or a
place are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from specula.sources.shared import written

#: Samples of a block, numbers of a chunk, and blocks that a first level of a scan takes together.
BLOCK, CHUNK, FAN = 256, 4096, 4096


def _div(x: Column, by) -> Column:
    return F.call_function("div", x, F.lit(by) if isinstance(by, int) else by)


def carried(parts: DataFrame, keys: list[str], at: str, values: dict[str, tuple[Callable, Callable, object]]) -> DataFrame:
    """``parts`` with each of ``values`` replaced by what all earlier parts of its key make together.

    values: by column an aggregate, how two results combine, and the result of no part.
    """
    own = parts.withColumn("_top", _div(F.floor(F.col(at)), FAN))
    top = own.groupBy(*keys, "_top").agg(*[fold(c).alias(f"_{c}") for c, (fold, _, _) in values.items()])
    before = Window.partitionBy(*keys).orderBy("_top").rowsBetween(Window.unboundedPreceding, -1)
    top = top.select(*keys, "_top", *[fold(f"_{c}").over(before).alias(f"_{c}") for c, (fold, _, _) in values.items()])
    inner = Window.partitionBy(*keys, "_top").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumns({c: fold(c).over(inner) for c, (fold, _, _) in values.items()})
    none = {c: F.lit(zero) for c, (_, _, zero) in values.items()}
    out = own.join(top, [*keys, "_top"]).withColumns({c: join(F.coalesce(c, none[c]), F.coalesce(f"_{c}", none[c])) for c, (_, join, _) in values.items()})
    return out.drop("_top", *[f"_{c}" for c in values])


def numbered(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """``df`` with k, a row's place in its signal from 0, and n, the signal's length. ``at`` doesn't repeat within a signal."""
    rows = df.dropna(subset=[*keys, at]).withColumn("_chunk", F.floor(F.col(at) / CHUNK))
    counts = rows.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_before"))
    length = counts.groupBy(*keys).agg(F.sum("_before").alias("n"))
    counts = carried(counts, keys, "_chunk", {"_before": (F.sum, lambda a, b: a + b, 0)})
    rows = rows.join(counts, [*keys, "_chunk"]).withColumn("k", F.col("_before") + F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(at)) - 1)
    return rows.drop("_chunk", "_before").join(length, keys)


def blocks(df: DataFrame, keys: list[str], values: list[str], reach: int = 0, mirrored: bool = True, size: int = BLOCK) -> DataFrame:
    """keys, block, n and s: a block's samples (p, k, values) in order, with ``reach`` more at each side.

    ``df`` has k and n. At a signal's ends its samples come again in opposite order, the ends themselves repeated,
    however far out ``reach`` is; or nothing does, unless ``mirrored``. p is the place that a sample stands for.
    """
    rows = df.select(*keys, "n", "k", *values)
    if reach and mirrored:
        turns = F.sequence(-_div(F.lit(reach), 2 * F.col("n")) - 1, _div(F.lit(reach), 2 * F.col("n")) + 1)
        all_ = F.flatten(F.transform(turns, lambda j: F.array(F.col("k") + 2 * F.col("n") * j, -1 - F.col("k") + 2 * F.col("n") * j)))
        inside = (F.col("k") >= reach) & (F.col("k") < F.col("n") - reach)
        rows = rows.withColumn("p", F.explode(F.when(inside, F.array("k")).otherwise(F.filter(all_, lambda p: (p >= -reach) & (p < F.col("n") + reach)))))
    else:
        rows = rows.withColumn("p", F.col("k"))
    first = F.greatest(_div(F.greatest(F.col("p") - reach, F.lit(0)), size), F.lit(0))
    last = _div(F.least(F.col("p") + reach, F.col("n") - 1), size)
    rows = rows.withColumn("block", F.explode(F.sequence(first, last)))
    return rows.groupBy(*keys, "block").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("p", "k", *values))).alias("s"))


def per_sample(made: DataFrame, keys: list[str], keep: list[str], value: dict[str, Callable], size: int = BLOCK) -> DataFrame:
    """keys, ``keep`` and further columns of each sample of ``made`` (by :func:`blocks`).

    A value gets a function from a distance to the sample there (null beyond what the block has), the place and the length.
    """
    begin = (F.col("block") * size - F.get("s", F.lit(0))["p"]).cast("int")
    own = F.sequence(begin, begin + F.least(F.lit(size), F.col("n") - F.col("block") * size).cast("int") - 1)

    def of(i):
        x = lambda d: F.get("s", i + d)
        return F.struct(*[x(0)[c].alias(c) for c in keep], *[v(x, x(0)["k"], F.col("n")).alias(c) for c, v in value.items()])

    return made.select(*keys, F.explode(F.transform(own, of)).alias("_e")).select(*keys, "_e.*")


def running(array: Column, zero: Column, step: Callable) -> Column:
    """zero and the folds of the array's beginnings, one more than it has elements."""
    return F.aggregate(array, F.array(zero), lambda acc, x: F.concat(acc, F.array(step(F.get(acc, F.size(acc) - 1), x))))


def _states(v: DataFrame, keys: list[str], power: Callable[[int], list[list[float]]], fan: int) -> DataFrame:
    """keys, o and state: what comes before each block of a linear recurrence; v is what block o leaves behind if nothing came before."""

    def after(count: int):
        m = power(count)
        return lambda state, left: F.array(*[sum((m[r][c] * state[c] for c in range(3)), left[r]) for r in range(3)])

    none = F.array(*[F.lit(0.0)] * 3)
    group = v.groupBy(*keys, _div(F.col("o"), fan).alias("_top")).agg(F.array_sort(F.collect_list(F.struct("o", "v"))).alias("_v"))
    left = F.aggregate(F.col("_v.v"), none, after(1))
    top = group.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_top", left.alias("v")))).alias("_t"))
    came = running(F.col("_t.v"), none, after(fan))
    top = top.select(*keys, F.explode(F.arrays_zip(F.col("_t._top").alias("_top"), F.slice(came, F.lit(1), F.size("_t")).alias("came"))).alias("_e")).select(*keys, "_e._top", F.col("_e.came").alias("_came"))
    inside = running(F.col("_v.v"), F.col("_came"), after(1))
    out = group.join(top, [*keys, "_top"])
    return out.select(*keys, F.explode(F.arrays_zip(F.col("_v.o").alias("o"), F.slice(inside, F.lit(1), F.size("_v")).alias("state"))).alias("_e")).select(*keys, "_e.*")


def young_van_vliet(sigma: float) -> tuple[float, list[float]]:
    """The gain of the input and the three weights of earlier outputs of a recursive Gaussian, ``sigma`` of 0.5 or more."""
    # The published fit of q and of the polynomials in it (Young and van Vliet, 2002).
    q = 0.98711 * sigma - 0.96330 if sigma >= 2.5 else 3.97156 - 4.14554 * (1.0 - 0.26891 * sigma) ** 0.5
    b0 = 1.57825 + 2.44413 * q + 1.4281 * q**2 + 0.422205 * q**3
    weights = [(2.44413 * q + 2.85619 * q**2 + 1.26661 * q**3) / b0, -(1.4281 * q**2 + 1.26661 * q**3) / b0, 0.422205 * q**3 / b0]
    return 1.0 - sum(weights), weights


def _powers(weights: list[float]) -> Callable[[int], list[list[float]]]:
    """Powers of the matrix that takes the last three outputs one sample further without input."""
    step = [weights, [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]

    def product(a, b):
        return [[sum(a[r][k] * b[k][c] for k in range(3)) for c in range(3)] for r in range(3)]

    def power(n: int):
        out, square = [[float(r == c) for c in range(3)] for r in range(3)], step
        while n:
            out = product(out, square) if n & 1 else out
            square, n = product(square, square), n >> 1
        return out

    return power


def recursive_gaussian(df: DataFrame, keys: list[str], at: str, value: str, to: str, sigma: float, length: int | None = None, size: int = BLOCK, fan: int = BLOCK) -> DataFrame:
    """keys, ``at`` and ``to``: ``value`` smoothed along ``at`` by a third-order recursion forth and back.

    Its cost doesn't depend on ``sigma``. The recursion starts as if the first sample had always been there, and back as
    if the last output had. Two scans over blocks' states; the samples themselves are shuffled once after numbering, and
    blocks, which each scan reads twice, are written tables. With ``length``, ``at`` already counts each signal from 0
    to ``length`` - 1.
    """
    gain, weights = young_van_vliet(sigma)
    power = _powers(weights)
    rows = df.select(*keys, F.col(at).alias("_at"), F.col(value).cast("double").alias("_x"))
    rows = numbered(rows, keys, "_at") if length is None else rows.withColumns({"k": F.col("_at").cast("bigint"), "n": F.lit(length).cast("bigint")})
    cut = written(blocks(rows, keys, ["_at", "_x"], size=size), "signal-blocks")

    def run(x: Column, state: Column) -> Column:
        """The last three outputs, latest first in ``state``, then this block's."""
        start = F.reverse(state)
        return F.aggregate(x, start, lambda acc, v: F.concat(acc, F.array(sum((w * F.get(acc, F.size(acc) - 1 - d) for d, w in enumerate(weights)), gain * v))))

    def swept(made: DataFrame, x: str, first: Column, o: Column, to_: str) -> DataFrame:
        """``made`` with ``to_``, outputs over the array ``x`` of its blocks in the order of o, with ``first`` before the first block's."""
        thrice = F.array(first, first, first)
        start = F.when(o == 0, thrice).otherwise(F.array(*[F.lit(0.0)] * 3))
        out = F.reverse(F.slice(run(F.col(x), start), -3, 3))
        states = _states(made.select(*keys, o.alias("o"), out.alias("v")), keys, lambda count: power(count * size), fan)
        both = made.withColumn("o", o).join(states, [*keys, "o"])
        whole = run(F.col(x), F.when(F.col("o") == 0, thrice).otherwise(F.col("state")))
        return both.withColumn(to_, F.slice(whole, F.lit(4), F.size(x))).drop("o", "state")

    forth = swept(cut.withColumn("_x", F.col("s._x")), "_x", F.get("_x", F.lit(0)), F.col("block"), "_y")
    back = written(forth.select(*keys, "block", "n", F.col("s._at").alias("_at"), F.reverse("_y").alias("_y")), "signal-forth")
    back = swept(back, "_y", F.get("_y", F.lit(0)), _div(F.col("n") - 1, size) - F.col("block"), "_z")
    return back.select(*keys, F.explode(F.arrays_zip("_at", F.reverse("_z").alias("_z"))).alias("_e")).select(*keys, F.col("_e._at").alias(at), F.col("_e._z").alias(to))
