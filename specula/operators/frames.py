"""Filters and changes of size over frames: images whose rows and columns are known and complete.

A frame may be large: it is cut into tiles, and pixels near a tile's edge, or mirrored at the frame's, are sent to each
tile that needs them. A tile is one row of a shuffle of bounded size, in which a filter runs along columns and then rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and columns of a tile.
TILE = 32


def _div(x: Column, by: int) -> Column:
    return F.call_function("div", x, F.lit(by))


def _met(at: Column, length: int, reach: int, size: int) -> Column:
    """Pairs (p, t) of an axis: every place that a pixel stands for, mirrored ones included, in every tile that needs it."""
    turns = reach // (2 * length) + 1
    mirrored = F.flatten(F.array(*[F.array(at + 2 * length * j, -1 - at + 2 * length * j) for j in range(-turns, turns + 1)]))
    places = F.when((at >= reach) & (at < length - reach), F.array(at)).otherwise(F.filter(mirrored, lambda p: (p >= -reach) & (p < length + reach)))
    first = lambda p: _div(F.greatest(p - reach, F.lit(0)), size)
    last = lambda p: _div(F.least(p + reach, F.lit(length - 1)), size)
    return F.flatten(F.transform(places, lambda p: F.transform(F.sequence(first(p), last(p)), lambda t: F.struct(p.alias("p"), t.alias("t")))))


def tiles(df: DataFrame, key: str, value: str, height: int, width: int, reach: int, size: int = TILE) -> DataFrame:
    """key, ty, tx and v: a tile's values row by row, with ``reach`` more on all sides, from key, y, x and ``value``.

    Beyond a frame its pixels come again in opposite order, the edge itself repeated, however far out ``reach`` is.
    """
    at = df.select(key, F.explode(_met(F.col("y").cast("int"), height, reach, size)).alias("_y"), "x", F.col(value).cast("double").alias("_v"))
    at = at.select(key, "_y", F.explode(_met(F.col("x").cast("int"), width, reach, size)).alias("_x"), "_v")
    of = F.array_sort(F.collect_list(F.struct(F.col("_y.p").alias("y"), F.col("_x.p").alias("x"), "_v")))
    return at.groupBy(key, F.col("_y.t").alias("ty"), F.col("_x.t").alias("tx")).agg(of.alias("s")).select(key, "ty", "tx", F.col("s._v").alias("v"))


def convolved(made: DataFrame, key: str, kernels: list[tuple[float, list[float]]], height: int, width: int, to: dict[str, Callable], size: int = TILE) -> DataFrame:
    """key, y, x and columns of a pixel and its filtered value, from :func:`tiles` whose reach is the kernels' radius.

    The filter is a sum of shares of separable kernels, all of one length: down the columns, then along the rows.
    """
    reach = len(kernels[0][1]) // 2
    rows = F.least(F.lit(size), height - F.col("ty") * size).cast("int")
    columns = F.least(F.lit(size), width - F.col("tx") * size).cast("int")
    df = made.withColumns({"_h": rows, "_w": columns, "_all": columns + 2 * reach})
    for k, (_, w) in enumerate(kernels):
        down = F.transform(F.sequence(F.lit(0), F.col("_h") * F.col("_all") - 1), lambda i: sum(F.get("v", i + d * F.col("_all")) * x for d, x in enumerate(w) if x))  # noqa: B023
        df = df.withColumn(f"_down{k}", down)
    cell = F.sequence(F.lit(0), F.col("_h") * F.col("_w") - 1)

    def of(i):
        y, x = F.call_function("div", i, F.col("_w")).cast("int"), i % F.col("_w")
        begin = y * F.col("_all") + x
        out = sum(share * sum(F.get(f"_down{k}", begin + d) * c for d, c in enumerate(w) if c) for k, (share, w) in enumerate(kernels))
        own = F.get("v", (y + reach) * F.col("_all") + x + reach)
        return F.struct((F.col("ty") * size + y).cast("int").alias("y"), (F.col("tx") * size + x).cast("int").alias("x"), *[f(own, out).alias(c) for c, f in to.items()])

    return df.select(key, F.explode(F.transform(cell, of)).alias("_e")).select(key, "_e.*")


def padded(kernels: list[tuple[float, list[float]]]) -> list[tuple[float, list[float]]]:
    """Kernels of one length, zeros at the ends."""
    most = max(len(w) for _, w in kernels) // 2
    return [(share, [0.0] * (most - len(w) // 2) + w + [0.0] * (most - len(w) // 2)) for share, w in kernels]


def area_downscale(df: DataFrame, key: str, value: str, height: int, width: int, longest: int) -> DataFrame:
    """key, y, x and ``value`` of frames whose longer side becomes ``longest``: means by the area that cells share.

    A pixel gives to the two cells of an axis at most that it meets, so it is a sum by cell, combined before the shuffle.
    """
    scale = longest / max(height, width)
    new = [n if scale >= 1 else round(n * scale) for n in (height, width)]
    if min(new) < 1:
        raise ValueError(f"frames of {height} x {width} become too small")

    def shares(at: Column, old: int, now: int) -> Column:
        step = old / now  # of old pixels in a cell
        first = F.floor(at / step + 1e-12)
        cells = F.filter(F.array(first, first + 1), lambda c: c < now)
        part = lambda c: F.least((c + 1) * F.lit(step), at + 1) - F.greatest(c * F.lit(step), at)
        return F.filter(F.transform(cells, lambda c: F.struct(c.cast("int").alias("c"), part(c).alias("w"))), lambda s: s["w"] > 1e-12)

    met = df.select(key, F.explode(shares(F.col("y"), height, new[0])).alias("_y"), "x", value).select(key, "_y", F.explode(shares(F.col("x"), width, new[1])).alias("_x"), value)
    w = F.col("_y.w") * F.col("_x.w")
    return met.groupBy(key, F.col("_y.c").alias("y"), F.col("_x.c").alias("x")).agg((F.sum(F.col(value) * w) / F.sum(w)).alias(value))


def _let(value: Column, f) -> Column:
    """f(value) with ``value`` computed once: where a lambda's body holds it, it is computed anew for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _through_fourier(v: Column, length: int, sigma: float, truncate: float) -> Column:
    """A complete line filtered by a Gaussian's response to its frequencies, mirrored about its ends before."""
    pad = int(truncate * sigma + 0.5)
    n, turn = length + 2 * pad, max(2 * (length - 1), 1)
    places = [min(p % turn, turn - p % turn) if length > 1 else 0 for p in range(-pad, length + pad)]
    cos, sin = (F.lit([f(2 * math.pi * k / n) for k in range(n)]) for f in (math.cos, math.sin))
    half = n // 2 + 1  # the other frequencies mirror these
    response = F.lit([math.exp(-2 * (math.pi * sigma * u / n) ** 2) * (1 if u in (0, n - u) else 2) / n for u in range(half)])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    wave = lambda line, table: F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda u: F.get(response, u) * total(F.transform(line, lambda x, i: x * F.get(table, (u * i) % n))))
    back = lambda both: F.transform(F.sequence(F.lit(pad), F.lit(pad + length - 1)), lambda x: total(F.transform(both, lambda f, u: f["re"] * F.get(cos, (u * x) % n) + f["im"] * F.get(sin, (u * x) % n))))
    there = lambda line: _let(F.arrays_zip(wave(line, cos).alias("re"), wave(line, sin).alias("im")), back)
    return _let(v, lambda v: _let(F.transform(F.lit(places), lambda p: F.get(v, p)), there))


def fourier_gaussian(df: DataFrame, key: str, value: str, height: int, width: int, sigma: float, truncate: float = 7.0) -> DataFrame:
    """key, y, x and ``value`` filtered by a Gaussian in the frequencies of rows and then of columns.

    The response is a product of both axes', so lines are transformed, weighted and taken back one by one; a task holds
    single lines. The frame is mirrored about its edge pixels, ``truncate`` sigmas out.
    """
    out = df.select(key, "y", "x", F.col(value).cast("double").alias(value))
    for fixed, along, length in (("y", "x", width), ("x", "y", height)):
        line = out.groupBy(key, fixed).agg(F.array_sort(F.collect_list(F.struct(along, value))).alias("_s")).withColumn("_s", F.col(f"_s.{value}"))
        out = line.select(key, fixed, F.posexplode(_through_fourier(F.col("_s"), length, sigma, truncate)).alias(along, value))
    return out.select(key, "y", "x", value)
