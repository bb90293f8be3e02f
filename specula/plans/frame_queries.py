"""Frames with known geometry, test patterns, tables of two and three dimensions, kernels and coordinate changes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from specula.functions import colour as C
from specula.operators import lookup_tables as L
from specula.plans.colour_queries import LAB, LIN, RGB, channels, lin_sql, linear, luma_sql, rounded, srgb_sql
from specula.operators.ranges import per_sample
from specula.plans.registry import query
from specula.plans.signal_queries import KNOTS, NUMBERED, stencils, interpolated, kernel
from specula.plans.table_queries import _LUT, N, SHAPE
from specula.sources.tables import FRAME, HEIGHT, PX, SIG, WIDTH, frames, pixels, signal, table


def _r(x: str, name: str, digits: int = 8) -> str:
    return f"round({x}, {digits}) AS {name}"


# --- frames


def window(centre: tuple[float, float], size: tuple[float, float]) -> tuple[int, int, int, int]:
    """First row and column, rows and columns of a crop; sizes are shares of the long side, (x, y); rounding halves to even."""
    out = []
    for whole, c, s in ((HEIGHT, centre[1], size[1]), (WIDTH, centre[0], size[0])):
        n = round(max(HEIGHT, WIDTH) * s)
        first = max(0, round(round(whole * c) - n / 2))
        out.append((min(first, whole - n), n))
    return out[0][0], out[1][0], out[0][1], out[1][1]


_Y0, _X0, _H, _W = window((0.4, 0.5), (0.3, 0.15))


@query(f"WITH {FRAME} SELECT image, y - {_Y0} AS y, x - {_X0} AS x, round(v, 8) AS v FROM frame WHERE y >= {_Y0} AND y < {_Y0 + _H} AND x >= {_X0} AND x < {_X0 + _W}")
def crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, x = F.col("y"), F.col("x")
    return frames(spark, sf_dir).where((y >= _Y0) & (y < _Y0 + _H) & (x >= _X0) & (x < _X0 + _W)).select("image", (y - _Y0).alias("y"), (x - _X0).alias("x"), F.round("v", 8).alias("v"))


@query(f"WITH {FRAME}, m AS (SELECT l_suppkey AS image, l_linenumber - 1 AS y, CAST(l_partkey % 31 AS INT) AS x, avg(CAST(l_returnflag = 'R' AS INT)) AS m FROM lineitem WHERE l_discount > 0 GROUP BY 1, 2, 3) SELECT image, round(sum(v * m) / nullif(sum(m), 0), 6) AS mean, count(*) AS n FROM frame JOIN m USING (image, y, x) GROUP BY image")
def mask_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of frames under a soft mask; pixels without a mask value drop out."""
    flag = (F.col("l_returnflag") == "R").cast("int")
    mask = table(spark, sf_dir, "lineitem").where("l_discount > 0").groupBy(F.col("l_suppkey").alias("image"), (F.col("l_linenumber") - 1).alias("y"), F.pmod("l_partkey", F.lit(WIDTH)).cast("int").alias("x")).agg(F.avg(flag).alias("m"))
    both = frames(spark, sf_dir).join(mask, ["image", "y", "x"])
    return both.groupBy("image").agg(F.round(F.try_divide(F.sum(F.col("v") * F.col("m")), F.sum("m")), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


# --- selections and tone


def _gate_sql(x: str, lo: float, hi: float) -> str:
    t = f"least(greatest(({x} - {lo}) / {hi - lo}, 0.0), 1.0)"
    return f"({t} * {t} * (3 - 2 * {t}))"


@query(
    f"""WITH {LAB}, h AS (SELECT image, l, a, b, sqrt(a * a + b * b) AS c, CASE WHEN degrees(atan2(round(b, 9), round(a, 9))) < 0 THEN degrees(atan2(round(b, 9), round(a, 9))) + 360 ELSE degrees(atan2(round(b, 9), round(a, 9))) END AS h FROM lab),
s AS (SELECT image, round({_gate_sql('h', 2, 14)} * (1 - {_gate_sql('h', 46, 66)}) * {_gate_sql('c', 5, 13)} * (1 - {_gate_sql('c', 70, 95)}) * {_gate_sql('l', 12, 22)} * (1 - {_gate_sql('l', 86, 95)}), 9) > 0.5 AS skin FROM h),
n AS (SELECT image, (CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0.0 END) < 0.22 AND {luma_sql()} > 0.05 AND {luma_sql()} < 0.95 AS neutral FROM px)
SELECT s.image, skin, neutral FROM (SELECT image, count(*) FILTER (WHERE skin) AS skin FROM s GROUP BY 1) s JOIN (SELECT image, count(*) FILTER (WHERE neutral) AS neutral FROM n GROUP BY 1) n USING (image)"""
)
def selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels that three soft gates of hue, chroma and lightness take for skin, and unsaturated middle greys."""
    light, a, b = C.linear_to_lab(*linear())
    y = C.luma(*channels())
    df = pixels(spark, sf_dir).select("image", light.alias("l"), C.chroma(a, b).alias("c"), C.hue_degrees(F.round(a, 9), F.round(b, 9)).alias("h"), ((C.saturation(*channels()) < 0.22) & (y > 0.05) & (y < 0.95)).alias("neutral"))
    up = lambda c, lo, hi: C.smoothstep(F.col(c), lo, hi)
    skin = up("h", 2, 14) * (1 - up("h", 46, 66)) * up("c", 5, 13) * (1 - up("c", 70, 95)) * up("l", 12, 22) * (1 - up("l", 86, 95))
    return df.groupBy("image").agg(F.count_if(F.round(skin, 9) > 0.5).alias("skin"), F.count_if("neutral").alias("neutral"))


@query(f"WITH {LAB} SELECT image, round(quantile_cont(round(l, 9), 0.5), 1) AS l, round(quantile_cont(round(sqrt(a * a + b * b), 9), 0.5), 1) AS c FROM lab GROUP BY image")
def stats_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of lightness and chroma with one decimal."""
    light, a, b = C.linear_to_lab(*linear())
    lab = pixels(spark, sf_dir).select("image", F.round(light, 9).alias("l"), F.round(C.chroma(a, b), 9).alias("c"))
    return lab.groupBy("image").agg(*(F.round(F.expr(f"percentile({c}, 0.5)"), 1).alias(c) for c in "lc"))


#: Exponent, level, knee and ceiling of the entry curve, and its toe with the ends of the toe over the median.
GAMMA, LEVEL, KNEE, CEILING, TOE, TOE_LOW, TOE_HIGH = 0.886, 0.55, 0.80, 0.985, 0.32, 0.08, 0.84
_SHOULDER = f"(CASE WHEN y > {KNEE} THEN {KNEE} + {CEILING - KNEE!r} * (1 - exp(-(y - {KNEE}) / {CEILING - KNEE!r})) ELSE y END)"


@query(
    f"""WITH {LIN}, t AS (SELECT *, greatest({luma_sql()}, 1e-9) AS lum FROM lin), p AS (SELECT *, power(lum, {GAMMA}) * {LEVEL} AS y FROM t), s AS (SELECT image, r, g, b, lum, {_SHOULDER} AS y FROM p), m AS (SELECT image, quantile_cont(y, 0.5) AS m FROM s GROUP BY image),
w AS (SELECT s.*, least(greatest((y - {TOE_LOW} * m) / greatest({TOE_HIGH} * m - {TOE_LOW} * m, 1e-9), 0.0), 1.0) AS t FROM s JOIN m USING (image))
SELECT image, {', '.join(_r(f'{c} * y * ({TOE} + {1 - TOE!r} * t * t * (3 - 2 * t)) / lum', c, 6) for c in RGB)} FROM w"""
)
def entry_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Light on a fixed curve with a soft shoulder and a toe that hangs on each image's own median; hues stay."""
    lin = pixels(spark, sf_dir).select("image", *(c.alias(n) for c, n in zip(linear(), RGB, strict=True)))
    lin = lin.withColumn("lum", F.greatest(C.luma(*channels()), F.lit(1e-9))).withColumn("y", F.pow("lum", F.lit(GAMMA)) * LEVEL)
    y, room = F.col("y"), CEILING - KNEE
    lin = lin.withColumn("y", F.when(y > KNEE, KNEE + room * (1 - F.exp(-(y - KNEE) / room))).otherwise(y))
    m = lin.groupBy("image").agg(F.expr("percentile(y, 0.5)").alias("m"))
    t = F.least(F.greatest((y - TOE_LOW * F.col("m")) / F.greatest(TOE_HIGH * F.col("m") - TOE_LOW * F.col("m"), F.lit(1e-9)), F.lit(0.0)), F.lit(1.0))
    return lin.join(m, "image").withColumn("t", t).select("image", *rounded(RGB, [c * y * (TOE + (1 - TOE) * F.col("t") * F.col("t") * (3 - 2 * F.col("t"))) / F.col("lum") for c in channels()], 6))


TONE = [(-8.0, -9.0), (-4.0, -4.4), (-2.0, -1.8), (-0.5, -0.3), (0.0, 0.0)]
_TONE_SEG = ", ".join(f"({a[0]!r}, {b[0]!r}, {a[1]!r}, {(b[1] - a[1]) / (b[0] - a[0])!r})" for a, b in zip(TONE, TONE[1:], strict=False))


@query(f"WITH {SIG}, seg AS (SELECT * FROM (VALUES {_TONE_SEG}) t(x0, x1, y0, m)), t AS (SELECT image, id, x, log2(greatest(x, 1e-6)) AS t FROM sig) SELECT image, id, round(power(2, CASE WHEN t <= -8.0 THEN -9.0 WHEN t > 0.0 THEN 0.0 ELSE y0 + (t - x0) * m END) / greatest(x, 1e-6), 8) AS gain FROM t LEFT JOIN seg ON t > x0 AND t <= x1")
def tone_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output over input of a curve between stops."""
    x = F.greatest(F.col("x"), F.lit(1e-6))
    return signal(spark, sf_dir).select("image", "id", F.round(F.pow(F.lit(2.0), interpolated(F.log2(x), TONE)) / x, 8).alias("gain"))


_A, _FROM = 28.0**0.5, 0.184 * 2.0


@query(
    f"""WITH {SIG}, m AS (SELECT image, max(x) AS top FROM sig GROUP BY image), p AS (SELECT s.*, top, {_FROM!r} / top AS x0 FROM sig s JOIN m USING (image)), k AS (SELECT *, exp({_A!r} * (1 - x0)) - {_A!r} * (1 - x0) - 1 AS d FROM p)
SELECT image, id, round(CASE WHEN top <= {_FROM!r} OR x <= {_FROM!r} THEN x ELSE x + 3.0 / d * top * (exp({_A!r} * ((x - {_FROM!r}) / top)) - {_A!r} * ((x - {_FROM!r}) / top) - 1) END, 8) AS y FROM k"""
)
def boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies a stop above middle grey lifted, the brightest by two stops; an image that has nothing there stays."""
    s = signal(spark, sf_dir)
    x, top = F.col("x"), F.col("top")
    df = s.join(s.groupBy("image").agg(F.max("x").alias("top")), "image")
    rest = 1 - _FROM / top
    step = (x - _FROM) / top
    lift = F.lit(3.0) / (F.exp(_A * rest) - _A * rest - 1) * top * (F.exp(_A * step) - _A * step - 1)
    return df.select("image", "id", F.round(F.when((top <= _FROM) | (x <= _FROM), x).otherwise(x + lift), 8).alias("y"))


@query(f"WITH {SIG} SELECT image, id, round(CASE WHEN id % 10 = 0 THEN 0.0 ELSE power(10, -(x * 3)) * 0.8 END, 8) AS light FROM sig")
def density_to_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Light behind a density; a density that is no number passes none."""
    density = F.when(F.col("id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("x") * 3)
    return signal(spark, sf_dir).select("image", "id", F.round(F.nanvl(F.pow(F.lit(10.0), -density) * 0.8, F.lit(0.0)), 8).alias("light"))


#: The constants of the perceptual quantizer.
M1, M2, C1, C2, C3 = 2610 / 16384, 2523 / 4096 * 128, 3424 / 4096, 2413 / 4096 * 32, 2392 / 4096 * 32


@query(f"WITH {SIG}, p AS (SELECT image, id, x, power(least(greatest(x, 0.0), 1.0), {1 / M2!r}) AS q, power(greatest(x, 0.0) / 10000, {M1!r}) AS e FROM sig) SELECT image, id, {_r(lin_sql('x'), 'srgb_decoded')}, {_r(srgb_sql('x'), 'srgb_encoded')}, {_r(f'10000 * power(greatest(q - {C1!r}, 0) / ({C2!r} - {C3!r} * q), {1 / M1!r})', 'pq_decoded', 5)}, {_r(f'power(({C1!r} + {C2!r} * e) / (1 + {C3!r} * e), {M2!r})', 'pq_encoded')}, {_r('x', 'linear')} FROM p")
def cctf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code values to light and back for three kinds of spaces: gamma, perceptual quantizer, linear."""
    x = F.col("x")
    q = F.pow(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)), F.lit(1 / M2))
    e = F.pow(F.greatest(x, F.lit(0.0)) / 10000, F.lit(M1))
    pq = F.round(10000 * F.pow(F.greatest(q - C1, F.lit(0.0)) / (C2 - C3 * q), F.lit(1 / M1)), 5).alias("pq_decoded")
    return signal(spark, sf_dir).select("image", "id", *rounded(("srgb_decoded", "srgb_encoded"), (C.srgb_to_linear(x), C.linear_to_srgb(x))), pq, *rounded(("pq_encoded", "linear"), (F.pow((C1 + C2 * e) / (1 + C3 * e), F.lit(M2)), x)))


# --- coordinates

_XY = "xy AS (SELECT image, r * 0.6 AS x, g * 0.4 AS y FROM px)"


def _xy(spark, sf_dir):
    return pixels(spark, sf_dir).select("image", (F.col("r") * 0.6).alias("x"), (F.col("g") * 0.4).alias("y"))


@query(f"WITH {PX}, {_XY}, q AS (SELECT image, least(greatest((1 - x) * (1 - x), 0.0), 1.0) AS x, least(greatest(y / greatest(1 - x, 1e-10), 0.0), 1.0) AS y FROM xy) SELECT image, round(x, 8) AS qx, round(y, 8) AS qy, round(1 - sqrt(x), 8) AS tx, round(y * sqrt(x), 8) AS ty FROM q")
def tri_quad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chromaticities on a square instead of a triangle, and back."""
    unit = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    x, y = F.col("x"), F.col("y")
    q = _xy(spark, sf_dir).select("image", unit((1 - x) * (1 - x)).alias("x"), unit(y / F.greatest(1 - x, F.lit(1e-10))).alias("y"))
    return q.select("image", *rounded(("qx", "qy", "tx", "ty"), (x, y, 1 - F.sqrt(x), y * F.sqrt(x))))


_NEAR = (0.3127, 0.329)


@query(f"WITH {PX}, {_XY}, d AS (SELECT image, x - {_NEAR[0]} AS dx, y - {_NEAR[1]} AS dy FROM xy), s AS (SELECT *, 1 / (1 + 0.7 * sqrt(dx * dx + dy * dy)) AS k FROM d) SELECT image, round({_NEAR[0]} + dx * k, 8) AS x, round({_NEAR[1]} + dy * k, 8) AS y FROM s")
def mobius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chromaticities drawn towards a white, farther ones more."""
    dx, dy = F.col("x") - _NEAR[0], F.col("y") - _NEAR[1]
    k = 1 / (1 + 0.7 * F.sqrt(dx * dx + dy * dy))
    return _xy(spark, sf_dir).select("image", *rounded("xy", (_NEAR[0] + dx * k, _NEAR[1] + dy * k)))


#: Powers of x and y of the terms; the constant is left out, so that the centre stays.
TERMS = ((1, 0), (0, 1), (2, 0), (0, 2), (1, 1), (3, 0), (0, 3), (2, 1), (1, 2), (4, 0), (0, 4), (3, 1), (2, 2), (1, 3))
_FACTORS = [round(0.5 / (k + 1), 4) for k in range(len(TERMS))]


def _power_sql(x: str, n: int) -> str:
    return " * ".join([x] * n)


@query(f"WITH {PX}, {_XY}, d AS (SELECT image, x - {_NEAR[0]} AS x, y - {_NEAR[1]} AS y FROM xy) SELECT image, round({' + '.join(' * '.join(filter(None, (repr(c), _power_sql('x', a), _power_sql('y', b)))) for c, (a, b) in zip(_FACTORS, TERMS, strict=True))}, 8) AS v FROM d")
def poly2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A polynomial of degree four over two coordinates."""
    x, y = F.col("x") - _NEAR[0], F.col("y") - _NEAR[1]
    power = lambda v, n: math.prod([v] * n) if n else 1
    return _xy(spark, sf_dir).select("image", F.round(sum(c * power(x, a) * power(y, b) for c, (a, b) in zip(_FACTORS, TERMS, strict=True)), 8).alias("v"))


#: Chromaticities of the primaries of one output space.
PRIMARIES = ((0.64, 0.33), (0.30, 0.60), (0.15, 0.06))


def _edges():
    return [(PRIMARIES[k], PRIMARIES[(k + 1) % 3]) for k in range(3)]


_SIDE = [f"(({bx - ax!r}) * (y - {ay}) - ({by - ay!r}) * (x - {ax}))" for (ax, ay), (bx, by) in _edges()]


@query(f"WITH {PX}, {_XY} SELECT image, round(avg(CAST(({' AND '.join(f'{s} >= 0' for s in _SIDE)}) OR ({' AND '.join(f'{s} <= 0' for s in _SIDE)}) AS INT)), 8) AS share FROM xy GROUP BY image")
def in_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of chromaticities inside the triangle of an output's primaries."""
    x, y = F.col("x"), F.col("y")
    sides = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for (ax, ay), (bx, by) in _edges()]
    inside = (F.least(*sides) >= 0) | (F.greatest(*sides) <= 0)
    return _xy(spark, sf_dir).groupBy("image").agg(F.round(F.avg(inside.cast("int")), 8).alias("share"))


# --- kernels, indices, curves


@query("SELECT CAST(sigma AS DOUBLE) / 10 AS sigma, CAST(k AS INT) AS k, round(exp(-0.5 * power(k / (sigma / 10.0), 2)) / sum(exp(-0.5 * power(k / (sigma / 10.0), 2))) OVER (PARTITION BY sigma), 10) AS w FROM (SELECT sigma, unnest(range(-CAST(floor(3 * sigma / 10.0 + 0.5) AS BIGINT), CAST(floor(3 * sigma / 10.0 + 0.5) AS BIGINT) + 1)) AS k FROM (SELECT unnest([8, 14, 25]) AS sigma))")
def gauss_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of Gaussians, cut at three sigmas, with sum 1."""
    rows = [(s, k - len(kernel(s)) // 2, w) for s in (0.8, 1.4, 2.5) for k, w in enumerate(kernel(s))]
    return spark.createDataFrame(rows, "sigma double, k int, w double").select("sigma", "k", F.round("w", 10).alias("w"))


@query("SELECT CAST(i AS INT) AS i, CAST(CASE WHEN m >= 7 THEN 13 - m ELSE m END AS INT) AS repeated, CAST(CASE WHEN i < 0 THEN -i WHEN i >= 7 THEN 12 - i ELSE i END AS INT) AS mirrored FROM (SELECT i, ((i % 14) + 14) % 14 AS m FROM (SELECT unnest(range(-20, 30)) AS i))")
def reflect_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places beyond the ends of seven, mirrored at the ends' edges (any distance) and at the ends themselves (once)."""
    i = F.col("id").cast("int")
    m = F.pmod(i, F.lit(14))
    return spark.range(-20, 30).select(i.alias("i"), F.when(m >= 7, 13 - m).otherwise(m).alias("repeated"), F.when(i < 0, -i).when(i >= 7, 12 - i).otherwise(i).alias("mirrored"))


@query("SELECT t, round(CASE WHEN x < 1 THEN (7 * x * x * x - 12 * x * x + 16.0 / 3) / 6 WHEN x < 2 THEN (-7.0 / 3 * x * x * x + 12 * x * x - 20 * x + 32.0 / 3) / 6 ELSE 0.0 END, 8) AS w FROM (SELECT k / 10.0 AS t, abs(k / 10.0) AS x FROM (SELECT CAST(unnest(range(-25, 26)) AS DOUBLE) AS k))")
def mitchell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the cubic kernel with both parameters a third."""
    t, x, b, c = F.col("t"), F.abs("t"), 1 / 3, 1 / 3
    near = ((12 - 9 * b - 6 * c) * x * x * x + (-18 + 12 * b + 6 * c) * x * x + (6 - 2 * b)) / 6
    far = ((-b - 6 * c) * x * x * x + (6 * b + 30 * c) * x * x + (-12 * b - 48 * c) * x + (8 * b + 24 * c)) / 6
    return spark.range(-25, 26).select((F.col("id") / 10.0).alias("t")).select("t", F.round(F.when(x < 1, near).when(x < 2, far).otherwise(0.0), 8).alias("w"))


#: Strengths of a diffusion filter, the share of light that each scatters, and the families' factors.
STRENGTHS = [(0.125, 0.10), (0.25, 0.20), (0.5, 0.35), (1.0, 0.55), (2.0, 0.75)]
FAMILIES = {"glimmerglass": 0.65, "black_pro_mist": 0.75, "pro_mist": 1.05, "cinebloom": 1.00}
_STRENGTH_SEG = ", ".join(f"({math.log2(a[0])!r}, {math.log2(b[0])!r}, {a[1]!r}, {b[1] - a[1]!r})" for a, b in zip(STRENGTHS, STRENGTHS[1:], strict=False))


@query(f"WITH {SIG}, f AS (SELECT * FROM (VALUES {', '.join(f'({k!r}, {g})' for k, g in FAMILIES.items())}) t(family, gain)), seg AS (SELECT * FROM (VALUES {_STRENGTH_SEG}) t(x0, x1, y0, m)), s AS (SELECT image, id, x * 3 AS strength, CASE WHEN x > 0 THEN log2(greatest(x * 3, 1e-6)) END AS e FROM sig) SELECT image, id, family, round(CASE WHEN strength <= 0 THEN 0.0 ELSE least(greatest(gain * CASE WHEN e <= -3 THEN 0.1 WHEN e > 1 THEN 0.75 ELSE y0 + (e - x0) * m END, 0.0), 0.99) END, 8) AS scatter FROM s CROSS JOIN f LEFT JOIN seg ON e > x0 AND e <= x1 WHERE id % 4 = CASE family WHEN 'glimmerglass' THEN 0 WHEN 'black_pro_mist' THEN 1 WHEN 'pro_mist' THEN 2 ELSE 3 END")
def strength_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of light that a filter of some family and strength scatters."""
    names = F.array(*map(F.lit, FAMILIES))
    family = F.get(names, (F.col("id") % 4).cast("int"))
    gain = F.try_element_at(F.create_map(*(F.lit(x) for pair in FAMILIES.items() for x in pair)), family)
    strength = F.col("x") * 3
    base = interpolated(F.log2(F.greatest(strength, F.lit(1e-6))), [(math.log2(a), b) for a, b in STRENGTHS])
    scatter = F.when(strength <= 0, 0.0).otherwise(F.least(F.greatest(gain * base, F.lit(0.0)), F.lit(0.99)))
    return signal(spark, sf_dir).select("image", "id", family.alias("family"), F.round(scatter, 8).alias("scatter"))


_GEOM = "g AS (SELECT kind, k, 40.0 / 3 * power(9.0, k / 4.0) AS lam FROM (SELECT unnest(['core', 'bloom']) AS kind), (SELECT CAST(unnest(range(0, 5)) AS DOUBLE) AS k))"


@query(f"WITH {_GEOM}, w AS (SELECT *, CASE WHEN kind = 'bloom' THEN power(lam, 2.0 - 3.0) ELSE 1.0 END AS w FROM g) SELECT kind, CAST(k AS INT) AS k, round(lam, 8) AS lam, round(w / sum(w) OVER (PARTITION BY kind), 8) AS w FROM w")
def geom_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decays in geometric progression round a centre, with equal weights or, for bloom, by a power of the decay."""
    k = F.col("id") % 5
    kind = F.when(F.col("id") < 5, "core").otherwise("bloom")
    df = spark.range(10).select(kind.alias("kind"), k.cast("int").alias("k"), (40.0 / 3 * F.pow(F.lit(9.0), k / 4.0)).alias("lam"))
    df = df.withColumn("w", F.when(F.col("kind") == "bloom", F.pow("lam", F.lit(2.0 - 3.0))).otherwise(1.0))
    return df.select("kind", "k", F.round("lam", 8).alias("lam"), F.round(F.col("w") / F.sum("w").over(Window.partitionBy("kind")), 8).alias("w"))  # five rows a kind


#: How warmth acts on red, green and blue.
WARMTH = (1.30, 0.15, -1.45)


@query(f"WITH g AS (SELECT k, 0.1 * (k + 1) AS w, -1 + k / 2.0 AS g FROM (SELECT CAST(unnest(range(0, 5)) AS DOUBLE) AS k)), c AS (SELECT *, g - sum(w * g) OVER () / sum(w) OVER () AS gc, sum(w) OVER () AS total FROM g), r AS (SELECT k, ch, total, greatest(w * (1 + 0.9 * a * gc), 0.0) AS raw FROM c CROSS JOIN (VALUES ('r', {WARMTH[0]}), ('g', {WARMTH[1]}), ('b', {WARMTH[2]})) t(ch, a)) SELECT ch, CAST(k AS INT) AS k, round(raw * total / sum(raw) OVER (PARTITION BY ch), 8) AS w FROM r")
def halo_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of a halo's parts, shifted by channel towards the outside or the inside, each channel's sum kept."""
    df = spark.range(5).select(F.col("id").cast("int").alias("k"), (0.1 * (F.col("id") + 1)).alias("w"), (-1 + F.col("id") / 2.0).alias("g"))
    every = Window.partitionBy(F.lit(1))  # five rows
    df = df.withColumn("total", F.sum("w").over(every)).withColumn("gc", F.col("g") - F.sum(F.col("w") * F.col("g")).over(every) / F.col("total"))
    axis = F.explode(F.array(*(F.struct(F.lit(n).alias("ch"), F.lit(a).alias("a")) for n, a in zip("rgb", WARMTH, strict=True)))).alias("x")
    raw = df.select("k", "total", "w", "gc", axis).select("k", "total", "x.ch", F.greatest(F.col("w") * (1 + 0.9 * F.col("x.a") * F.col("gc")), F.lit(0.0)).alias("raw"))
    return raw.select("ch", "k", F.round(F.col("raw") * F.col("total") / F.sum("raw").over(Window.partitionBy("ch")), 8).alias("w"))


#: Inhibition inside a layer (r, g, b) and between layers (donor to the other two, in order).
SAME, BETWEEN = (0.341, 0.324, 0.273), ((0.355, 0.305), (0.154, 0.358), (0.171, 0.225))
_COUPLERS = [(d, t, SAME[d] if d == t else BETWEEN[d][[x for x in range(3) if x != d].index(t)]) for d in range(3) for t in range(3)]


@query(f"WITH m AS (SELECT * FROM (VALUES {', '.join(map(str, _COUPLERS))}) t(donor, taker, v)), px AS (SELECT l_suppkey AS image, avg(l_quantity / 50) AS r, avg(1 - 5 * l_discount) AS g, avg(l_tax / 0.08) AS b FROM lineitem GROUP BY 1), v AS (SELECT image, unnest([0, 1, 2]) AS donor, unnest([r, g, b]) AS x FROM px) SELECT image, CAST(taker AS INT) AS taker, round(sum(x * v), 8) AS held FROM v JOIN m USING (donor) GROUP BY image, taker")
def couplers_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each layer is held back by what all layers give off."""
    means = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("image")).agg(F.avg(F.col("l_quantity") / 50).alias("r"), F.avg(1 - 5 * F.col("l_discount")).alias("g"), F.avg(F.col("l_tax") / 0.08).alias("b"))
    held = [sum(F.col(RGB[d]) * v for d, t, v in _COUPLERS if t == taker) for taker in range(3)]
    rows = F.explode(F.array(*(F.struct(F.lit(t).alias("taker"), F.round(h, 8).alias("held")) for t, h in enumerate(held)))).alias("x")
    return means.select("image", rows).select("image", "x.taker", "x.held")


@query(f"WITH {SIG}, seg AS (SELECT * FROM (VALUES {', '.join(f'({a[0]!r}, {b[0]!r}, {a[1]!r}, {(b[1] - a[1]) / (b[0] - a[0])!r})' for a, b in zip(KNOTS, KNOTS[1:], strict=False))}) t(x0, x1, y0, m)), c AS (SELECT image, id, ch, least(x * f, 1.0) AS x FROM sig CROSS JOIN (VALUES ('r', 1.0), ('g', 0.8), ('b', 1.2)) t(ch, f)) SELECT image, id, ch, round(CASE WHEN x <= {KNOTS[0][0]} THEN {KNOTS[0][1]} WHEN x > {KNOTS[-1][0]} THEN {KNOTS[-1][1]} ELSE y0 + (x - x0) * m END, 8) AS y FROM c LEFT JOIN seg ON x > x0 AND x <= x1")
def interp_curve3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One curve over three channels, its ends held."""
    of = lambda n, f: F.struct(F.lit(n).alias("ch"), F.round(interpolated(F.least(F.col("x") * f, F.lit(1.0)), KNOTS), 8).alias("y"))
    return signal(spark, sf_dir).select("image", "id", F.explode(F.array(of("r", 1.0), of("g", 0.8), of("b", 1.2))).alias("c")).select("image", "id", "c.ch", "c.y")


@query(f"WITH {NUMBERED}, d AS (SELECT image, lead(x) OVER w - 2 * x + lag(x) OVER w AS d2 FROM sig WINDOW w AS (PARTITION BY image ORDER BY id)) SELECT image, round(coalesce(max(abs(d2)), 0.0), 8) AS bend FROM d GROUP BY image")
def second_derivative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest second difference of each signal."""
    bend = lambda x, k, n: F.abs(x(1)["x"] - 2 * x(0)["x"] + x(-1)["x"])
    return per_sample(stencils(spark, sf_dir, 1, False), ["image"], [], {"bend": bend}).groupBy("image").agg(F.round(F.coalesce(F.max("bend"), F.lit(0.0)), 8).alias("bend"))


# --- tables


def _axis_sql(axis: str) -> str:
    same = " AND ".join(f"p.i{c} = q.i{c}" for c in RGB if c != axis)
    return f"(SELECT avg(abs(q.{{c}} - p.{{c}})) FROM lut p JOIN lut q ON {same} AND q.i{axis} = p.i{axis} + 1)"


_TV = {a: "(" + " + ".join(_axis_sql(a).format(c=c) for c in RGB) + ") / 3" for a in RGB}


@query(f"WITH {_LUT} SELECT {', '.join(f'round({e}, 8) AS tv_{a}' for a, e in _TV.items())}, round({' + '.join(_TV.values())}, 8) AS tv")
def total_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean step between a table's neighbours along each axis, and all together. A table has a fixed number of points."""
    points = L.lattice(spark, N).select("ir", "ig", "ib", *(v.alias(c) for v, c in zip(SHAPE(*channels()), RGB, strict=True)))
    steps = []
    for axis in RGB:
        line = Window.partitionBy(*(f"i{c}" for c in RGB if c != axis)).orderBy(f"i{axis}")
        steps.append((sum(F.abs(F.lead(c).over(line) - F.col(c)) for c in RGB) / 3).alias(f"tv_{axis}"))
    means = points.select(*steps).agg(*(F.avg(f"tv_{a}").alias(f"tv_{a}") for a in RGB))
    return means.select(*(F.round(f"tv_{a}", 8).alias(f"tv_{a}") for a in RGB), F.round(sum(F.col(f"tv_{a}") for a in RGB), 8).alias("tv"))


@query(f"WITH {PX}, {_LUT}, c AS (SELECT image, row_number() OVER () AS n, least(greatest(r, 0.0), 1.0) * {N - 1} AS x, least(greatest(g, 0.0), 1.0) * {N - 1} AS y FROM px), f AS (SELECT *, CAST(floor(x) AS INT) AS x0, CAST(floor(y) AS INT) AS y0 FROM c) SELECT image, round((1 - (x - x0)) * (1 - (y - y0)) * a.g + (x - x0) * (1 - (y - y0)) * b.g + (1 - (x - x0)) * (y - y0) * d.g + (x - x0) * (y - y0) * e.g, 8) AS v FROM f JOIN lut a ON a.ib = 0 AND a.ir = x0 AND a.ig = y0 JOIN lut b ON b.ib = 0 AND b.ir = least(x0 + 1, {N - 1}) AND b.ig = y0 JOIN lut d ON d.ib = 0 AND d.ir = x0 AND d.ig = least(y0 + 1, {N - 1}) JOIN lut e ON e.ib = 0 AND e.ir = least(x0 + 1, {N - 1}) AND e.ig = least(y0 + 1, {N - 1})")
def lut_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of two dimensions between its points; beyond its edge the edge is held."""
    values = L.baked(N, SHAPE)[1]
    at = lambda c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0)) * (N - 1)
    x, y = at("r"), at("g")
    x0, y0 = F.floor(x).cast("int"), F.floor(y).cast("int")
    x1, y1 = F.least(x0 + 1, F.lit(N - 1)), F.least(y0 + 1, F.lit(N - 1))
    tx, ty = x - x0, y - y0
    of = lambda i, j: F.get(values, i + j * N)
    v = (1 - tx) * (1 - ty) * of(x0, y0) + tx * (1 - ty) * of(x1, y0) + (1 - tx) * ty * of(x0, y1) + tx * ty * of(x1, y1)
    return pixels(spark, sf_dir).select("image", F.round(v, 8).alias("v"))


def cube_text(spark: SparkSession) -> DataFrame:
    """A cube file's whole text, in ``text``: comments, headers, blank lines and the points, red running fastest."""
    k = F.col("ib") * (N * N) + F.col("ig") * N + F.col("ir")
    lines = L.lattice(spark, N).select(k.alias("k"), F.format_string("%.6f %.6f %.6f", *SHAPE(*channels())).alias("line"))
    one = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda e: e["line"]), "\n").alias("body"))  # N ** 3 lines
    return one.select(F.concat(F.lit(f'# made here\nTITLE "x"\n\nDOMAIN_MIN 0 0 0\nLUT_3D_SIZE {N}\n'), "body", F.lit("\n")).alias("text"))


@query(f"WITH {_LUT} SELECT ib * {N * N} + ig * {N} + ir AS line, {', '.join(f'CAST(printf({chr(39)}%.6f{chr(39)}, {c}) AS DOUBLE) AS {c}' for c in RGB)}, true AS whole FROM lut")
def cube_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of a cube text, and whether they are as many as its header says."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.trim(x))
    size = F.regexp_extract("text", r"(?m)^LUT_3D_SIZE\s+(\d+)", 1).cast("int")
    data = F.filter(lines, lambda x: x.rlike(r"^[-+0-9.]"))
    rows = cube_text(spark).select((F.size(data) == size * size * size).alias("whole"), F.posexplode(data).alias("line", "x"))
    return rows.select("line", *(F.get(F.split("x", r"\s+"), F.lit(k)).cast("double").alias(c) for k, c in enumerate(RGB)), "whole")


_CODE = ", ".join(f"least(greatest(CAST(round_even({c} * 1023, 0) AS INT), 0), 1023) AS {c}" for c in RGB)


@query(f"WITH {_LUT}, c AS (SELECT ib * {N * N} + ig * {N} + ir + 1 AS line, {_CODE} FROM lut) SELECT line, CAST(r AS VARCHAR) || ' ' || CAST(g AS VARCHAR) || ' ' || CAST(b AS VARCHAR) AS text FROM c UNION ALL SELECT 0, '{' '.join(str(round(1023 * k / (N - 1))) for k in range(N))}'")
def threedl_emit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a table in 10-bit codes: the shape first, then the points, red running fastest."""
    code = lambda v: F.least(F.greatest(F.rint(v * 1023), F.lit(0.0)), F.lit(1023.0)).cast("int")
    k = (F.col("ib") * (N * N) + F.col("ig") * N + F.col("ir") + 1).alias("line")
    points = L.lattice(spark, N).select(k, F.concat_ws(" ", *(code(v).cast("string") for v in SHAPE(*channels()))).alias("text"))
    shape = spark.range(1).select(F.lit(0).alias("line"), F.lit(" ".join(str(round(1023 * k / (N - 1))) for k in range(N))).alias("text"))
    return points.union(shape)


@query(f"WITH {_LUT}, c AS (SELECT ib * {N * N} + ig * {N} + ir AS line, {_CODE} FROM lut) SELECT line, {', '.join(f'round({c} / 1023.0, 8) AS {c}' for c in RGB)} FROM c")
def threedl_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points from such lines: codes over the last value of the shape."""
    lines = threedl_emit(spark, sf_dir)
    top = lines.where("line = 0").select(F.element_at(F.split("text", " "), -1).cast("double").alias("top"))
    points = lines.where("line > 0").crossJoin(F.broadcast(top))  # one row
    return points.select((F.col("line") - 1).alias("line"), *(F.round(F.get(F.split("text", " "), F.lit(k)).cast("double") / F.col("top"), 8).alias(c) for k, c in enumerate(RGB)))


# --- patterns


@query("SELECT kind, CAST(k AS INT) AS k, round(CASE kind WHEN 'neutral' THEN k / 15.0 WHEN 'red' THEN 0.46 + k / 15.0 * 0.54 ELSE 0.46 END, 8) AS r, round(CASE kind WHEN 'neutral' THEN k / 15.0 WHEN 'green' THEN 0.46 + k / 15.0 * 0.54 ELSE 0.46 END, 8) AS g, round(CASE kind WHEN 'neutral' THEN k / 15.0 WHEN 'blue' THEN 0.46 + k / 15.0 * 0.54 ELSE 0.46 END, 8) AS b FROM (SELECT unnest(['neutral', 'red', 'green', 'blue']) AS kind), (SELECT CAST(unnest(range(0, 16)) AS DOUBLE) AS k)")
def gen_ramps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A neutral ramp, and one of each channel's highlights from middle grey on, the others held there."""
    t = F.col("k") / 15.0
    rows = spark.range(16).select(F.col("id").cast("int").alias("k"), F.explode(F.array(*map(F.lit, ("neutral", "red", "green", "blue")))).alias("kind"))
    of = lambda name: F.round(F.when(F.col("kind") == "neutral", t).when(F.col("kind") == name, 0.46 + t * 0.54).otherwise(0.46), 8)
    return rows.select("kind", "k", of("red").alias("r"), of("green").alias("g"), of("blue").alias("b"))


@query("WITH e AS (SELECT axis, a, b, k / 4.0 AS t FROM (SELECT unnest([0, 1, 2]) AS axis), (SELECT unnest([0.0, 1.0]) AS a), (SELECT unnest([0.0, 1.0]) AS b), (SELECT CAST(unnest(range(0, 5)) AS DOUBLE) AS k)) SELECT axis, CAST(CASE axis WHEN 0 THEN t ELSE a END AS DOUBLE) AS r, CAST(CASE axis WHEN 0 THEN a WHEN 1 THEN t ELSE b END AS DOUBLE) AS g, CAST(CASE axis WHEN 2 THEN t ELSE b END AS DOUBLE) AS b FROM e")
def gen_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples along the twelve edges of the cube of codes."""
    ends = F.array(F.lit(0.0), F.lit(1.0))
    df = spark.range(5).select((F.col("id") / 4.0).alias("t"), F.explode(F.array(*map(F.lit, range(3)))).alias("axis"))
    df = df.select("t", "axis", F.explode(ends).alias("a")).select("t", "axis", "a", F.explode(ends).alias("b"))
    t, a, b, axis = (F.col(c) for c in ("t", "a", "b", "axis"))
    return df.select("axis", F.when(axis == 0, t).otherwise(a).alias("r"), F.when(axis == 0, a).when(axis == 1, t).otherwise(b).alias("g"), F.when(axis == 2, t).otherwise(b).alias("b"))
