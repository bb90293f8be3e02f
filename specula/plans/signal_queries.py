"""Signals in order: filters, differences, running maxima, curves. Signals are cut into blocks, so they can be of any length."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from specula.operators.ranges import BLOCK, blocks, carried, numbered, per_sample, recursive_gaussian, young_van_vliet
from specula.plans.registry import query
from specula.sources.tables import SIG, signal


def kernel(sigma: float, truncate: float = 3.0) -> list[float]:
    """Weights of a Gaussian, radius floor(truncate * sigma + 0.5), summing to 1."""
    radius = int(truncate * sigma + 0.5)
    w = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def stencils(spark: SparkSession, sf_dir: str, reach: int, mirrored: bool = True) -> DataFrame:
    """Blocks of the signals with ``reach`` samples more at each side."""
    return blocks(numbered(signal(spark, sf_dir), ["image"], "id"), ["image"], ["id", "x"], reach, mirrored)


def smoothed(spark: SparkSession, sf_dir: str, weights: list[float], value=lambda x, y: y) -> DataFrame:
    """image, id and y: a weighted sum of the neighbours in order, the signal reflected beyond its ends."""
    radius = len(weights) // 2
    y = lambda x: sum(x(d)["x"] * weights[d + radius] for d in range(-radius, radius + 1))
    return per_sample(stencils(spark, sf_dir, radius), ["image"], ["id"], {"y": lambda x, k, n: F.round(value(x(0)["x"], y(x)), 8)})


def _filtered_sql(weights: list[float], name: str = "y") -> str:
    radius = len(weights) // 2
    w = ", ".join(f"({d}, {weights[d + radius]!r})" for d in range(-radius, radius + 1))
    m = "((s.k - 1 + k.d) % (2 * s.n) + 2 * s.n) % (2 * s.n)"
    return f"""kern_{name} AS (SELECT * FROM (VALUES {w}) t(d, w)), {name} AS (SELECT s.image, s.id, any_value(s.x) AS x, sum(k.w * o.x) AS y FROM numbered s CROSS JOIN kern_{name} k
JOIN numbered o ON o.image = s.image AND o.k = 1 + CASE WHEN {m} >= s.n THEN 2 * s.n - 1 - {m} ELSE {m} END GROUP BY s.image, s.id)"""


NUMBERED = f"{SIG}, numbered AS (SELECT image, id, x, row_number() OVER (PARTITION BY image ORDER BY id) AS k, count(*) OVER (PARTITION BY image) AS n FROM sig)"
SHARP = kernel(0.8)
#: Shares of three Gaussians that stand for an exponential spread, and their sigmas over its decay.
EXPONENTIAL = ((0.1633, 0.5360), (0.6496, 1.5236), (0.1870, 2.7684))


@query(f"WITH {NUMBERED}, {_filtered_sql(SHARP)} SELECT image, id, round(y, 8) AS y FROM y")
def gauss_fir_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoothed(spark, sf_dir, SHARP)


@query(f"WITH {NUMBERED}, {_filtered_sql(SHARP)} SELECT image, id, round(x + 0.7 * (x - y), 8) AS y FROM y")
def unsharp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoothed(spark, sf_dir, SHARP, lambda x, y: x + 0.7 * (x - y))


def mixture(decay: float) -> list[float]:
    """Weights of the three Gaussians together."""
    parts = [(share, kernel(ratio * decay)) for share, ratio in EXPONENTIAL]
    radius = max(len(w) // 2 for _, w in parts)
    return [sum(share * w[d + len(w) // 2] for share, w in parts if abs(d) <= len(w) // 2) for d in range(-radius, radius + 1)]


@query(f"WITH {NUMBERED}, {', '.join(_filtered_sql(kernel(ratio), f'y{k}') for k, (_, ratio) in enumerate(EXPONENTIAL))} SELECT image, id, round({' + '.join(f'{share} * y{k}.y' for k, (share, _) in enumerate(EXPONENTIAL))}, 8) AS y FROM y0 JOIN y1 USING (image, id) JOIN y2 USING (image, id)")
def exp_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exponential spread as a mixture of three Gaussians, in one pass."""
    return smoothed(spark, sf_dir, mixture(1.0))


@query(f"WITH {SIG} SELECT image, id, round(max(x) OVER (PARTITION BY image ORDER BY id ROWS UNBOUNDED PRECEDING), 8) AS y FROM sig")
def running_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximum so far: inside blocks by a window, from block to block carried."""
    rows = numbered(signal(spark, sf_dir), ["image"], "id").withColumn("block", F.call_function("div", F.col("k"), F.lit(BLOCK)))
    before = carried(rows.groupBy("image", "block").agg(F.max("x").alias("before")), ["image"], "block", {"before": (F.max, F.greatest, None)})
    so_far = F.max("x").over(Window.partitionBy("image", "block").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(before, ["image", "block"]).select("image", "id", F.round(F.greatest(so_far, "before"), 8).alias("y"))


_D = f"{SIG}, d AS (SELECT image, x, x - lag(x) OVER w AS d, lead(x) OVER w - 2 * x + lag(x) OVER w AS d2 FROM sig WINDOW w AS (PARTITION BY image ORDER BY id))"


@query(f"WITH {_D} SELECT image, count(*) FILTER (WHERE d < 0) AS falls, round(least(0.0, min(d)), 8) AS worst, round(avg(abs(d)), 8) AS variation, round(max(abs(d2)), 8) AS bend FROM d GROUP BY image")
def monotonicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Falls, the worst of them, total variation and the largest second difference."""
    d = lambda x, k, n: x(0)["x"] - x(-1)["x"]
    bend = lambda x, k, n: x(1)["x"] - 2 * x(0)["x"] + x(-1)["x"]
    d = per_sample(stencils(spark, sf_dir, 1, False), ["image"], [], {"d": d, "d2": bend})
    return d.groupBy("image").agg(F.count_if(F.col("d") < 0).alias("falls"), F.round(F.least(F.lit(0.0), F.min("d")), 8).alias("worst"), F.round(F.avg(F.abs("d")), 8).alias("variation"), F.round(F.max(F.abs("d2")), 8).alias("bend"))


@query(
    f"""WITH {NUMBERED}, d AS (SELECT image, id, k, n, x - lag(x) OVER w AS a, lead(x) OVER w - x AS b, lag(x) OVER w - lag(x, 2) OVER w AS a2, lead(x, 2) OVER w - lead(x) OVER w AS b2 FROM numbered WINDOW w AS (PARTITION BY image ORDER BY id)),
e AS (SELECT image, id, k, n, a, b, CASE WHEN k = 1 THEN b ELSE a END AS d0, CASE WHEN k = 1 THEN b2 ELSE a2 END AS d1 FROM d)
SELECT image, id, round(CASE WHEN n = 1 THEN 0.0 WHEN n = 2 THEN d0 WHEN k > 1 AND k < n THEN CASE WHEN a * b <= 0 THEN 0.0 ELSE 2 * a * b / (a + b) END
WHEN (3 * d0 - d1) * d0 <= 0 THEN 0.0 WHEN d0 * d1 < 0 AND abs(0.5 * (3 * d0 - d1)) > abs(3 * d0) THEN 3 * d0 ELSE 0.5 * (3 * d0 - d1) END, 8) AS slope FROM e"""
)
def pchip_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes of a monotone cubic: harmonic means inside, 0 where the signal turns, limited three-point ones at the ends."""

    def slope(at, k, n):
        x = lambda d: at(d)["x"]
        a, b = x(0) - x(-1), x(1) - x(0)
        inside = F.when(a * b <= 0, 0.0).otherwise(F.try_divide(2 * a * b, a + b))
        first = k == 0
        d0 = F.when(first, b).otherwise(a)
        d1 = F.when(first, x(2) - x(1)).otherwise(x(-1) - x(-2))
        three = 0.5 * (3 * d0 - d1)
        end = F.when(three * d0 <= 0, 0.0).when((d0 * d1 < 0) & (F.abs(three) > F.abs(3 * d0)), 3 * d0).otherwise(three)
        return F.round(F.when(n == 1, 0.0).when(n == 2, d0).when((k > 0) & (k < n - 1), inside).otherwise(end), 8)

    return per_sample(stencils(spark, sf_dir, 2, False), ["image"], ["id"], {"slope": slope})


SIGMA = 4.0
_GAIN, _W = young_van_vliet(SIGMA)


def _sweep_sql(name: str, source: str, x: str, order: str, key: str = "image") -> str:
    """A recursion over the samples of ``source`` one by one, all signals together."""
    return f"""{name}_n AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS place FROM {source}),
{name} AS (SELECT * REPLACE ({x} AS {x}), {_GAIN!r} * {x} + {_W[0]!r} * {x} + {_W[1]!r} * {x} + {_W[2]!r} * {x} AS w1, {x} AS w2, {x} AS w3 FROM {name}_n WHERE place = 1
UNION ALL SELECT n.*, {_GAIN!r} * n.{x} + {_W[0]!r} * p.w1 + {_W[1]!r} * p.w2 + {_W[2]!r} * p.w3, p.w1, p.w2 FROM {name} p JOIN {name}_n n ON {' AND '.join(f'n.{c.strip()} = p.{c.strip()}' for c in key.split(','))} AND n.place = p.place + 1)"""


@query(f"WITH RECURSIVE {SIG}, {_sweep_sql('forth', 'sig', 'x', 'id')}, out AS (SELECT image, id, w1 AS y FROM forth), {_sweep_sql('back', 'out', 'y', 'id DESC')} SELECT image, id, round(w1, 8) AS y FROM back")
def iir_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Gaussian of any width as a recursion forth and back, the blocks' states composed by a scan."""
    out = recursive_gaussian(signal(spark, sf_dir), ["image"], "id", "x", "y", SIGMA)
    return out.select("image", "id", F.round("y", 8).alias("y"))


def interpolated(x, knots: list[tuple[float, float]]):
    """Piecewise-linear with constant ends; the knots are part of the plan, so rows stay where they are."""
    out = F.when(x <= knots[0][0], knots[0][1])
    for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False):
        out = out.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(knots[-1][1])


KNOTS = [(0.05, 0.0), (0.1, 0.2), (0.3, 0.5), (0.6, 0.9), (0.9, 1.0)]
_SEGMENTS = ", ".join(f"({a[0]!r}, {b[0]!r}, {a[1]!r}, {(b[1] - a[1]) / (b[0] - a[0])!r})" for a, b in zip(KNOTS, KNOTS[1:], strict=False))


@query(f"WITH {SIG}, seg AS (SELECT * FROM (VALUES {_SEGMENTS}) t(x0, x1, y0, m)) SELECT image, id, round(CASE WHEN x <= 0.05 THEN 0.0 WHEN x > 0.9 THEN 1.0 ELSE y0 + (x - x0) * m END, 8) AS y FROM sig LEFT JOIN seg ON x > x0 AND x <= x1")
def interp_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal(spark, sf_dir).select("image", "id", F.round(interpolated(F.col("x"), KNOTS), 8).alias("y"))


@query(f"WITH {SIG}, e AS (SELECT image, id, least(greatest((log10(greatest(x, 0.0) + 1e-10) / 0.7 + 3) / 4, 0.0), 1.0) AS x FROM sig), seg AS (SELECT * FROM (VALUES {_SEGMENTS}) t(x0, x1, y0, m)) SELECT image, id, round(2.2 * CASE WHEN x <= 0.05 THEN 0.0 WHEN x > 0.9 THEN 1.0 ELSE y0 + (x - x0) * m END, 8) AS density FROM e LEFT JOIN seg ON x > x0 AND x <= x1")
def density_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log exposure, its axis divided by gamma, to density on a curve."""
    e = F.least(F.greatest((F.log10(F.greatest(F.col("x"), F.lit(0.0)) + 1e-10) / 0.7 + 3) / 4, F.lit(0.0)), F.lit(1.0))
    return signal(spark, sf_dir).select("image", "id", e.alias("e")).select("image", "id", F.round(2.2 * interpolated(F.col("e"), KNOTS), 8).alias("density"))
