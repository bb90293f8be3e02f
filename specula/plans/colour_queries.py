"""Per-pixel colour and tone: maps without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specula.functions import colour as C
from specula.plans.registry import query
from specula.sources.tables import PX, SIG, pixels, signal

RGB = ("r", "g", "b")


def channels():
    return [F.col(c) for c in RGB]


def linear():
    return [C.srgb_to_linear(F.col(c)) for c in RGB]


def rounded(names, columns, digits: int = 8):
    return [F.round(c, digits).alias(n) for n, c in zip(names, columns, strict=True)]


def lin_sql(c: str) -> str:
    return f"(CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE power(({c} + 0.055) / 1.055, 2.4) END)"


def srgb_sql(c: str) -> str:
    return f"(CASE WHEN greatest({c}, 0.0) <= 0.0031308 THEN greatest({c}, 0.0) * 12.92 ELSE 1.055 * power(greatest({c}, 0.0), {1 / 2.4!r}) - 0.055 END)"


def row_sql(row, a: str, b: str, c: str) -> str:
    return f"({a} * {row[0]!r} + {b} * {row[1]!r} + {c} * {row[2]!r})"


def f_sql(t: str) -> str:
    return f"(CASE WHEN {t} > {216 / 24389!r} THEN cbrt({t}) ELSE ({t} * {24389 / 27!r} + 16) / 116 END)"


def f_inverse_sql(t: str) -> str:
    return f"(CASE WHEN {t} > {6 / 29!r} THEN {t} * {t} * {t} ELSE ({t} * 116 - 16) / {24389 / 27!r} END)"


LIN = f"{PX}, lin AS (SELECT image, {', '.join(f'{lin_sql(c)} AS {c}' for c in RGB)} FROM px)"
LAB = f"""{LIN},
xyz AS (SELECT image, {', '.join(f"{row_sql(row, 'r', 'g', 'b')} / {w!r} AS {n}" for row, w, n in zip(C.RGB_TO_XYZ, C.WHITE, 'xyz', strict=True))} FROM lin),
fxyz AS (SELECT image, {', '.join(f'{f_sql(n)} AS {n}' for n in 'xyz')} FROM xyz),
lab AS (SELECT image, 116 * y - 16 AS l, 500 * (x - y) AS a, 200 * (y - z) AS b FROM fxyz)"""


def luma_sql(r: str = "r", g: str = "g", b: str = "b") -> str:
    return row_sql(C.LUMA, r, g, b)


@query(f"WITH {PX} SELECT image, {', '.join(f'round({lin_sql(c)}, 8) AS {c}' for c in RGB)} FROM px")
def srgb_to_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("image", *rounded(RGB, linear()))


@query(f"WITH {PX} SELECT image, {', '.join(f'round({srgb_sql(c)}, 8) AS {c}' for c in RGB)} FROM px")
def linear_to_srgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("image", *rounded(RGB, [C.linear_to_srgb(c) for c in channels()]))


@query(f"WITH {PX} SELECT image, round({luma_sql()} * 255, 8) AS luma FROM px")
def luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("image", F.round(C.luma(*channels()) * 255, 8).alias("luma"))


@query(f"WITH {LAB} SELECT image, round(l, 8) AS l, round(a, 8) AS a, round(b, 8) AS b, round(sqrt(a * a + b * b), 8) AS c FROM lab")
def to_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    light, a, b = C.linear_to_lab(*linear())
    return pixels(spark, sf_dir).select("image", *rounded("labc", (light, a, b, C.chroma(a, b))))


@query(
    f"""WITH {LAB}, back AS (SELECT image, {f_inverse_sql('((l + 16) / 116 + a / 500)')} * {C.WHITE[0]!r} AS x, {f_inverse_sql('((l + 16) / 116)')} AS y, {f_inverse_sql('((l + 16) / 116 - b / 200)')} * {C.WHITE[2]!r} AS z FROM lab)
SELECT image, {', '.join(f"round({row_sql(row, 'x', 'y', 'z')}, 6) + 0.0 AS {n}" for row, n in zip(C.XYZ_TO_RGB, RGB, strict=True))} FROM back"""
)
def lab_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("image", *((F.round(v, 6) + 0.0).alias(c) for c, v in zip(RGB, C.lab_to_linear(*C.linear_to_lab(*linear())), strict=True)))


@query(f"WITH {SIG}, s AS (SELECT image, id, 116 * {f_sql('x')} - 16 AS l FROM sig) SELECT image, id, round(l, 8) AS l, round({f_inverse_sql('((l + 16) / 116)')}, 8) AS y FROM s")
def lstar(spark: SparkSession, sf_dir: str) -> DataFrame:
    light = C.lightness(F.col("x"))
    return signal(spark, sf_dir).select("image", "id", *rounded("ly", (light, C.from_lightness(light))))


@query(f"WITH {LAB}, h AS (SELECT image, degrees(atan2(round(b, 9), round(a, 9))) AS h FROM lab) SELECT image, round(CASE WHEN h < 0 THEN h + 360 ELSE h END, 6) AS h FROM h")
def hue_deg(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, a, b = C.linear_to_lab(*linear())
    return pixels(spark, sf_dir).select("image", F.round(C.hue_degrees(F.round(a, 9), F.round(b, 9)), 6).alias("h"))


@query(f"WITH {PX} SELECT image, round(CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0.0 END, 8) AS s FROM px")
def sat_hsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("image", F.round(C.saturation(*channels()), 8).alias("s"))


@query(f"WITH {SIG}, t AS (SELECT image, id, least(greatest((x - 0.1) / (0.6 - 0.1), 0.0), 1.0) AS t FROM sig) SELECT image, id, round(t * t * (3 - 2 * t), 8) AS w FROM t")
def smoothstep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal(spark, sf_dir).select("image", "id", F.round(C.smoothstep(F.col("x"), 0.1, 0.6), 8).alias("w"))


@query(
    f"""WITH {LAB}, h AS (SELECT image, degrees(atan2(round(b, 9), round(a, 9))) AS h FROM lab), p AS (SELECT image, abs((CASE WHEN h < 0 THEN h + 360 ELSE h END) - 30.0) AS d FROM h),
t AS (SELECT image, least(greatest(1 - ((CASE WHEN d > 180 THEN 360 - d ELSE d END) - 45.0 * 0.35) / (45.0 * 0.65), 0.0), 1.0) AS t FROM p) SELECT image, round(t * t * (3 - 2 * t), 6) AS w FROM t"""
)
def hue_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, a, b = C.linear_to_lab(*linear())
    return pixels(spark, sf_dir).select("image", F.round(C.hue_weight(C.hue_degrees(F.round(a, 9), F.round(b, 9)), 30.0, 45.0), 6).alias("w"))


@query(f"WITH {LIN}, y AS (SELECT *, {luma_sql()} AS y FROM lin) SELECT image, {', '.join(f'round(CASE WHEN y > 0 THEN {c} * (sqrt(y) / y) ELSE 0.0 END, 8) AS {c}' for c in RGB)} FROM y")
def retone(spark: SparkSession, sf_dir: str) -> DataFrame:
    lin = linear()
    return pixels(spark, sf_dir).select("image", *rounded(RGB, C.retone(*lin, F.sqrt(C.luma(*lin)))))


@query(
    f"""WITH {LIN}, k AS (SELECT image, {', '.join(f'{c} * 1.6 AS {c}' for c in RGB)} FROM lin), y AS (SELECT *, {luma_sql()} AS y, greatest(r, g, b) AS m FROM k),
f AS (SELECT *, CASE WHEN m > 1 AND m > y THEN (1 - least(y, 1.0)) / (m - least(y, 1.0)) ELSE 1.0 END AS k FROM y)
SELECT image, {', '.join(f'round(y + ({c} - y) * k, 8) AS {c}' for c in RGB)} FROM f"""
)
def fit_gamut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("image", *rounded(RGB, C.fit_gamut(*(c * 1.6 for c in linear()))))


@query(f"WITH {PX} SELECT image, {', '.join(f'CAST(least(greatest(round_even({c} * 255, 0), 0), 255) AS INTEGER) AS {c}' for c in RGB)} FROM px")
def quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("image", *(C.to_byte(F.col(c)).alias(c) for c in RGB))


def _oklab_sql(name: str, source: str) -> str:
    lms = ", ".join(f"cbrt({row_sql(row, 'r', 'g', 'b')}) AS {n}" for row, n in zip(C.RGB_TO_LMS, ("p", "q", "s"), strict=True))
    lab = ", ".join(f"{row_sql(row, 'p', 'q', 's')} AS {n}" for row, n in zip(C.LMS_TO_OKLAB, ("l", "a", "b"), strict=True))
    return f"{name} AS (SELECT image, k, {lab} FROM (SELECT image, k, {lms} FROM {source}))"


@query(
    f"""WITH {LIN}, n AS (SELECT image, r, g, b, row_number() OVER () AS k FROM lin), d AS (SELECT image, k, r * 0.9 AS r, g * 0.95 AS g, b AS b FROM n), {_oklab_sql('u', 'n')}, {_oklab_sql('v', 'd')}
SELECT u.image, round(avg(sqrt((u.l - v.l) * (u.l - v.l) + (u.a - v.a) * (u.a - v.a) + (u.b - v.b) * (u.b - v.b))), 8) AS delta FROM u JOIN v ON u.k = v.k GROUP BY u.image"""
)
def oklab_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean OkLab distance of each image to a copy with red and green lowered."""
    r, g, b = linear()
    pairs = zip(C.oklab(r, g, b), C.oklab(r * 0.9, g * 0.95, b), strict=True)
    return pixels(spark, sf_dir).groupBy("image").agg(F.round(F.avg(F.sqrt(sum((x - y) * (x - y) for x, y in pairs))), 8).alias("delta"))


@query(f"WITH {SIG} SELECT image, id, round(x / sqrt(1 + (x / 0.8) * (x / 0.8)), 8) AS a, round(power(10, -x * 2), 8) AS d, round(0.18 * power(2, x * 5) / 1.2, 8) AS e FROM sig")
def algebraic_sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limited sigmoid, light passed by a density, and an exposure gain in stops."""
    x = F.col("x")
    return signal(spark, sf_dir).select("image", "id", *rounded("ade", (x / F.sqrt(1 + (x / 0.8) * (x / 0.8)), F.pow(F.lit(10.0), -x * 2), 0.18 * F.pow(F.lit(2.0), x * 5) / 1.2)))


@query(f"WITH {SIG}, c AS (SELECT image, id, log10(greatest(x, 0.0) + 1e-10) AS e FROM sig) SELECT image, id, round((e + 3) / 7, 8) AS code, round((e + 3) / 7 * 7 - 3, 8) AS back, round(least(greatest((x - 0.05) / 0.9, 0.0), 1.0), 8) AS clipped FROM c JOIN sig USING (image, id)")
def shaper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log exposure to code values and back; densities to clipped codes."""
    e = F.log10(F.greatest(F.col("x"), F.lit(0.0)) + 1e-10)
    return signal(spark, sf_dir).select("image", "id", *rounded(("code", "back", "clipped"), ((e + 3) / 7, (e + 3) / 7 * 7 - 3, F.least(F.greatest((F.col("x") - 0.05) / 0.9, F.lit(0.0)), F.lit(1.0)))))


@query(f"WITH {SIG}, t AS (SELECT image, id, x * 4 - 2 AS e FROM sig) SELECT image, id, round(0.15 * log10(1 + power(10, (e + 1) / 0.15)) * 0.6 - 0.2 * log10(1 + power(10, (e - 1.2) / 0.2)) * 0.6, 8) AS density FROM t")
def parametric_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density over log exposure: a straight part between a soft toe and a soft shoulder."""
    e = F.col("x") * 4 - 2
    soft = lambda at, size: size * F.log10(1 + F.pow(F.lit(10.0), (e - at) / size)) * 0.6
    return signal(spark, sf_dir).select("image", "id", F.round(soft(-1.0, 0.15) - soft(1.2, 0.2), 8).alias("density"))
