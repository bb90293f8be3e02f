"""Filters over frames, changes of size, and tables with monotone cubics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specula.operators import frames as P
from specula.operators import lookup_tables as L
from specula.operators.ranges import recursive_gaussian
from specula.plans.colour_queries import RGB, rounded
from specula.plans.registry import query
from specula.plans.signal_queries import EXPONENTIAL, SHARP, SIGMA, _sweep_sql, kernel
from specula.plans.table_queries import N
from specula.sources.tables import FULL, HEIGHT, PX, WIDTH, full_frames, pixels


def _filtered(spark: SparkSession, sf_dir: str, kernels: list[tuple[float, list[float]]], value) -> DataFrame:
    kernels = P.padded(kernels)
    made = P.tiles(full_frames(spark, sf_dir), "image", "v", HEIGHT, WIDTH, len(kernels[0][1]) // 2)
    return P.convolved(made, "image", kernels, HEIGHT, WIDTH, {"v": lambda own, out: F.round(value(own, out), 8)})


def _mirrored(at: str, n: int) -> str:
    m = f"(({at}) % {2 * n} + {2 * n}) % {2 * n}"
    return f"CASE WHEN {m} >= {n} THEN {2 * n - 1} - {m} ELSE {m} END"


def _blur_sql(name: str, weights: list[float]) -> str:
    """Both passes as joins with the kernel's weights."""
    radius = len(weights) // 2
    values = ", ".join(f"({k - radius}, {w!r})" for k, w in enumerate(weights))
    return f"""k_{name} AS (SELECT * FROM (VALUES {values}) t(d, w)),
down_{name} AS (SELECT f.image, f.y, f.x, sum(k.w * o.v) AS v FROM whole f CROSS JOIN k_{name} k JOIN whole o ON o.image = f.image AND o.x = f.x AND o.y = {_mirrored('f.y + k.d', HEIGHT)} GROUP BY 1, 2, 3),
{name} AS (SELECT f.image, f.y, f.x, sum(k.w * o.v) AS v FROM whole f CROSS JOIN k_{name} k JOIN down_{name} o ON o.image = f.image AND o.y = f.y AND o.x = {_mirrored('f.x + k.d', WIDTH)} GROUP BY 1, 2, 3)"""


@query(f"WITH {FULL}, {_blur_sql('b', SHARP)} SELECT image, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(v, 8) AS v FROM b")
def gauss_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A narrow Gaussian over frames: tiles with what lies around them, columns and then rows."""
    return _filtered(spark, sf_dir, [(1.0, SHARP)], lambda own, out: out)


@query(f"WITH {FULL}, {_blur_sql('b', SHARP)} SELECT image, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(w.v + 0.7 * (w.v - b.v), 8) AS v FROM b JOIN whole w USING (image, y, x)")
def unsharp_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a blur takes away, added again in part."""
    return _filtered(spark, sf_dir, [(1.0, SHARP)], lambda own, out: own + 0.7 * (own - out))


@query(f"WITH {FULL}, {', '.join(_blur_sql(f'b{k}', kernel(ratio)) for k, (_, ratio) in enumerate(EXPONENTIAL))} SELECT image, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round({' + '.join(f'{share} * b{k}.v' for k, (share, _) in enumerate(EXPONENTIAL))}, 8) AS v FROM b0 JOIN b1 USING (image, y, x) JOIN b2 USING (image, y, x)")
def exp_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exponential spread over frames: three Gaussians' shares in one pass over tiles."""
    return _filtered(spark, sf_dir, [(share, kernel(ratio)) for share, ratio in EXPONENTIAL], lambda own, out: out)


_ROWS = ", ".join([_sweep_sql("f1", "whole", "v", "x", "image, y"), "r1 AS (SELECT image, y, x, w1 AS v FROM f1)", _sweep_sql("f2", "r1", "v", "x DESC", "image, y"), "r2 AS (SELECT image, y, x, w1 AS v FROM f2)"])
_COLUMNS = ", ".join([_sweep_sql("f3", "r2", "v", "y", "image, x"), "r3 AS (SELECT image, y, x, w1 AS v FROM f3)", _sweep_sql("f4", "r3", "v", "y DESC", "image, x")])


@query(f"WITH RECURSIVE {FULL}, {_ROWS}, {_COLUMNS} SELECT image, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(w1, 8) AS v FROM f4")
def iir_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide Gaussian over frames as recursions along rows and then columns."""
    rows = recursive_gaussian(full_frames(spark, sf_dir), ["image", "y"], "x", "v", "v", SIGMA, WIDTH)
    out = recursive_gaussian(rows, ["image", "x"], "y", "v", "v", SIGMA, HEIGHT)
    return out.select("image", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.round("v", 8).alias("v"))


FOURIER, REACH = 0.9, 6  # sigma, and pixels mirrored at each edge: floor(7 * sigma + 0.5)


def _circle_sql(name: str, source: str, fixed: str, along: str, n: int) -> str:
    """One axis: the response's kernel in space, as a sum over frequencies, around a circle of the mirrored line."""
    size, turn = n + 2 * REACH, 2 * (n - 1)
    return f"""{name}_k AS (SELECT d, sum(exp(-2 * power(pi() * {FOURIER} * (CASE WHEN 2 * u > {size} THEN u - {size} ELSE u END) / {size}, 2)) * cos(2 * pi() * u * d / {size})) / {size} AS w FROM (SELECT unnest(range(0, {size})) AS d), (SELECT unnest(range(0, {size})) AS u) GROUP BY d),
{name}_p AS (SELECT p, least(((p - {REACH}) % {turn} + {turn}) % {turn}, {turn} - ((p - {REACH}) % {turn} + {turn}) % {turn}) AS o FROM (SELECT unnest(range(0, {size})) AS p)),
{name} AS (SELECT s.image, s.{fixed}, t.{along}, sum(k.w * s.v) AS v FROM {source} s JOIN {name}_p p ON p.o = s.{along} CROSS JOIN (SELECT unnest(range(0, {n})) AS {along}) t JOIN {name}_k k ON k.d = (p.p - {REACH} - t.{along} + {size}) % {size} GROUP BY 1, 2, 3)"""


@query(f"WITH {FULL}, {_circle_sql('h', 'whole', 'y', 'x', WIDTH)}, {_circle_sql('g', 'h', 'x', 'y', HEIGHT)} SELECT image, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(v, 8) AS v FROM g")
def fft_gauss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Gaussian in frequencies: each line transformed, weighted and taken back."""
    out = P.fourier_gaussian(full_frames(spark, sf_dir), "image", "v", HEIGHT, WIDTH, FOURIER)
    return out.select("image", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.round("v", 8).alias("v"))


LONGEST = 12
_NEW = (round(HEIGHT * LONGEST / WIDTH), LONGEST)


@query(
    f"""WITH {FULL}, yy AS (SELECT y, c, least((c + 1) * {HEIGHT}.0 / {_NEW[0]}, y + 1) - greatest(c * {HEIGHT}.0 / {_NEW[0]}, y) AS w FROM lines, (SELECT unnest(range(0, {_NEW[0]})) AS c)),
xx AS (SELECT x, c, least((c + 1) * {WIDTH}.0 / {_NEW[1]}, x + 1) - greatest(c * {WIDTH}.0 / {_NEW[1]}, x) AS w FROM places, (SELECT unnest(range(0, {_NEW[1]})) AS c))
SELECT image, CAST(yy.c AS INT) AS y, CAST(xx.c AS INT) AS x, round(sum(v * yy.w * xx.w) / sum(yy.w * xx.w), 8) AS v FROM whole JOIN yy ON yy.y = whole.y AND yy.w > 1e-9 JOIN xx ON xx.x = whole.x AND xx.w > 1e-9 GROUP BY 1, 2, 3"""
)
def area_downscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smaller frames, each new pixel the mean of what it covers."""
    out = P.area_downscale(full_frames(spark, sf_dir), "image", "v", HEIGHT, WIDTH, LONGEST)
    return out.select("image", "y", "x", F.round("v", 8).alias("v"))


#: A table that turns back once along green, so that slopes of 0 and corners that hold the result occur.
FOLD = lambda r, g, b: (0.9 * r * r + 0.1 * g, abs(g - 0.4) * (1 - 0.5 * b), 0.7 * b * b * b + 0.3 * r * g)
_FOLD = ("0.9 * r * r + 0.1 * g", "abs(g - 0.4) * (1 - 0.5 * b)", "0.7 * b * b * b + 0.3 * r * g")
_POINTS = f"points AS (SELECT k % {N} AS ir, k // {N} % {N} AS ig, k // {N * N} AS ib, (k % {N}) / {N - 1}.0 AS r, (k // {N} % {N}) / {N - 1}.0 AS g, (k // {N * N}) / {N - 1}.0 AS b FROM (SELECT unnest(range(0, {N ** 3})) AS k))"
_VALUES = "value AS (" + " UNION ALL ".join(f"SELECT ir, ig, ib, '{c}' AS c, {s} AS v FROM points" for c, s in zip(RGB, _FOLD, strict=True)) + ")"


def _slope_sql(axis: str) -> str:
    others = ", ".join(f"i{c}" for c in RGB if c != axis)
    return f"""d{axis} AS (SELECT ir, ig, ib, c, i{axis} AS place, v - lag(v) OVER w AS a, lead(v) OVER w - v AS b, lag(v) OVER w - lag(v, 2) OVER w AS a2, lead(v, 2) OVER w - lead(v) OVER w AS b2 FROM value WINDOW w AS (PARTITION BY c, {others} ORDER BY i{axis})),
s{axis} AS (SELECT ir, ig, ib, c, CASE WHEN place > 0 AND place < {N - 1} THEN CASE WHEN a * b <= 0 THEN 0.0 ELSE 2 * a * b / (a + b) END
WHEN (3 * coalesce(a, b) - CASE WHEN place = 0 THEN b2 ELSE a2 END) * coalesce(a, b) <= 0 THEN 0.0 WHEN coalesce(a, b) * CASE WHEN place = 0 THEN b2 ELSE a2 END < 0 AND abs(1.5 * coalesce(a, b) - 0.5 * CASE WHEN place = 0 THEN b2 ELSE a2 END) > 3 * abs(coalesce(a, b)) THEN 3 * coalesce(a, b)
ELSE 1.5 * coalesce(a, b) - 0.5 * CASE WHEN place = 0 THEN b2 ELSE a2 END END AS s FROM d{axis})"""


def _weights_sql(axis: str) -> str:
    t, far = f"f{axis}", f"(v.i{axis} > cell.i{axis})"
    return f"CASE WHEN {far} THEN -2 * {t} ** 3 + 3 * {t} ** 2 ELSE 2 * {t} ** 3 - 3 * {t} ** 2 + 1 END AS h{axis}, CASE WHEN {far} THEN {t} ** 3 - {t} ** 2 ELSE {t} ** 3 - 2 * {t} ** 2 + {t} END AS m{axis}, CASE WHEN {far} THEN {t} ELSE 1 - {t} END AS l{axis}"


@query(
    f"""WITH {PX}, {_POINTS}, {_VALUES}, {', '.join(map(_slope_sql, RGB))},
cell AS (SELECT image, n, {', '.join(f'least(floor({c} * {N - 1}), {N - 2}) AS i{c}, {c} * {N - 1} - least(floor({c} * {N - 1}), {N - 2}) AS f{c}' for c in RGB)} FROM (SELECT *, row_number() OVER () AS n FROM px)),
corner AS (SELECT cell.image, cell.n, v.c, v.ir, v.ig, v.ib, v.v, sr.s AS sr, sg.s AS sg, sb.s AS sb, {', '.join(map(_weights_sql, RGB))} FROM cell JOIN value v ON {' AND '.join(f'v.i{c} IN (cell.i{c}, cell.i{c} + 1)' for c in RGB)}
{' '.join(f'JOIN s{a} ON s{a}.c = v.c AND s{a}.ir = v.ir AND s{a}.ig = v.ig AND s{a}.ib = v.ib' for a in RGB)}),
one AS (SELECT image, n, c, ig, ib, any_value(hg) AS hg, any_value(mg) AS mg, any_value(lg) AS lg, any_value(hb) AS hb, any_value(mb) AS mb, sum(hr * v + mr * sr) AS v, sum(lr * sg) AS sg, sum(lr * sb) AS sb, min(v) AS lo, max(v) AS hi FROM corner GROUP BY 1, 2, 3, 4, 5),
two AS (SELECT image, n, c, ib, any_value(hb) AS hb, any_value(mb) AS mb, sum(hg * v + mg * sg) AS v, sum(lg * sb) AS sb, min(lo) AS lo, max(hi) AS hi FROM one GROUP BY 1, 2, 3, 4),
three AS (SELECT image, n, c, least(greatest(sum(hb * v + mb * sb), min(lo)), max(hi)) AS v FROM two GROUP BY 1, 2, 3)
SELECT image, {', '.join(f"round(max(v) FILTER (WHERE c = '{c}'), 8) AS {c}" for c in RGB)} FROM three GROUP BY image, n"""
)
def lut_pchip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours through a table by monotone cubics along three axes, without a join or a shuffle."""
    step = 1 / (N - 1)
    points = [FOLD((k % N) * step, (k // N % N) * step, k // (N * N) * step) for k in range(N**3)]
    out = L.monotone_cubic(pixels(spark, sf_dir), N, {c: [p[k] for p in points] for k, c in enumerate(RGB)})
    return out.select("image", *rounded(RGB, [F.col(f"{c}_out") for c in RGB]))
