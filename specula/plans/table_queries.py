"""Tables over colours, spectra and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from specula.functions import colour as C
from specula.operators import lookup_tables as L
from specula.plans.colour_queries import RGB, channels, rounded, row_sql
from specula.plans.registry import query
from specula.sources.tables import PX, SPEC, pixels, spectra

N = 5
SHAPE = (lambda r, g, b: (r**2 * 0.9 + g * 0.1, g**2 * 0.8 + b * 0.2, b**2 * 0.7 + r * 0.3))
_SHAPE = ("r * r * 0.9 + g * 0.1", "g * g * 0.8 + b * 0.2", "b * b * 0.7 + r * 0.3")
_LUT = f"lut AS (SELECT CAST(k % {N} AS INT) AS ir, CAST(k // {N} % {N} AS INT) AS ig, CAST(k // {N * N} AS INT) AS ib, {', '.join(f'{s} AS {c}' for s, c in zip(_SHAPE, RGB, strict=True))} FROM (SELECT k, (k % {N}) * 0.25 AS r, (k // {N} % {N}) * 0.25 AS g, (k // {N * N}) * 0.25 AS b FROM (SELECT unnest(range(0, {N ** 3})) AS k)))"
_CELLS = f"cells AS (SELECT image, n, {', '.join(f'CAST(least(floor({c} * {N - 1}), {N - 2}) AS INT) AS i{c}, {c} * {N - 1} - least(floor({c} * {N - 1}), {N - 2}) AS f{c}' for c in RGB)} FROM (SELECT *, row_number() OVER () AS n FROM px))"


@query(f"WITH {_LUT} SELECT ir, ig, ib, {', '.join(f'round({c}, 8) AS {c}' for c in RGB)} FROM lut")
def lut_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lattice(spark, N).select("ir", "ig", "ib", *rounded(RGB, SHAPE(*channels())))


@query(
    f"""WITH {PX}, {_LUT}, {_CELLS}, w AS (SELECT c.image, c.n, {', '.join(f'lut.{c}' for c in RGB)}, {' * '.join(f'(CASE WHEN lut.i{c} = c.i{c} THEN 1 - f{c} ELSE f{c} END)' for c in RGB)} AS w
FROM cells c JOIN lut ON {' AND '.join(f'(lut.i{c} = c.i{c} OR lut.i{c} = c.i{c} + 1)' for c in RGB)})
SELECT image, {', '.join(f'round(sum(w * {c}), 8) AS {c}' for c in RGB)} FROM w GROUP BY image, n"""
)
def lut_trilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = L.baked(N, SHAPE)
    return pixels(spark, sf_dir).select("image", *rounded(RGB, [L.trilinear(t, N, *channels()) for t in tables]))


_ORDERS = ("rgb", "rbg", "grb", "gbr", "brg", "bgr")


def _corner_join(alias: str, add: str) -> str:
    return f"JOIN lut {alias} ON " + " AND ".join(f"{alias}.i{c} = c.i{c} + {add.format(c=c)}" for c in RGB)


@query(
    f"""WITH {PX}, {_LUT}, {_CELLS}, o AS (SELECT *, CASE {' '.join(f"WHEN f{x} >= f{y} AND f{y} >= f{z} THEN '{x}{y}{z}'" for x, y, z in _ORDERS)} END AS o, greatest(fr, fg, fb) AS hi, least(fr, fg, fb) AS lo, fr + fg + fb - greatest(fr, fg, fb) - least(fr, fg, fb) AS mid FROM cells)
SELECT c.image, {', '.join(f'round(p0.{k} * (1 - hi) + p1.{k} * (hi - mid) + p2.{k} * (mid - lo) + p3.{k} * lo, 8) AS {k}' for k in RGB)} FROM o c
{_corner_join('p0', '0')} {_corner_join('p1', "CAST(substr(o, 1, 1) = '{c}' AS INT)")} {_corner_join('p2', "CAST(substr(o, 3, 1) <> '{c}' AS INT)")} {_corner_join('p3', '1')}"""
)
def lut_tetrahedral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.with_tetrahedra(pixels(spark, sf_dir), N).select("image", *rounded(RGB, [L.tetrahedral(t) for t in L.baked(N, SHAPE)]))


@query(f"WITH {_LUT} SELECT ib * {N * N} + ig * {N} + ir AS line, printf('%.6f %.6f %.6f', r, g, b) AS text FROM lut")
def cube_emit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data lines of a cube file, red running fastest."""
    k = (F.col("ib") * (N * N) + F.col("ig") * N + F.col("ir")).alias("line")
    return L.lattice(spark, N).select(k, F.format_string("%.6f %.6f %.6f", *SHAPE(*channels())).alias("text"))


@query(f"WITH {SPEC}, w AS (SELECT name, family, list_sum(list_transform(bands, lambda x: x * x)) AS power, list_sum(list_transform(range(1, len(bands) + 1), lambda k: bands[k] * ((k - 1) / 64.0))) AS tilt FROM spec) SELECT name, family, round(power, 8) AS power, round(tilt, 8) AS tilt FROM w")
def spectral_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contractions of each spectrum with itself and with a slope over bands."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    tilt = F.transform("bands", lambda x, k: x * (k / 64.0))
    return spectra(spark, sf_dir).select("name", "family", F.round(total(F.transform("bands", lambda x: x * x)), 8).alias("power"), F.round(total(tilt), 8).alias("tilt"))


@query(f"WITH {SPEC}, b AS (SELECT family, unnest(bands) AS v, generate_subscripts(bands, 1) AS band FROM spec), m AS (SELECT family, band, avg(abs(v)) AS v FROM b GROUP BY family, band) SELECT family, CAST(band - 1 AS INT) AS band, round(v / avg(v) OVER (PARTITION BY family), 8) AS v FROM m")
def illuminant_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean spectrum of each family with mean 1 over its bands. The window runs over 64 rows a family."""
    b = spectra(spark, sf_dir).select("family", F.posexplode("bands").alias("band", "v"))
    m = b.groupBy("family", "band").agg(F.avg(F.abs("v")).alias("v"))
    return m.select("family", "band", F.round(F.col("v") / F.avg("v").over(Window.partitionBy("family")), 8).alias("v"))


@query(f"WITH {PX} SELECT image, round(avg((1 - 0.5 * (1 - r)) * (1 - 0.3 * (1 - g)) * (1 - 0.2 * (1 - b))), 8) AS through, round(avg(power(10, -(r * 30 + g * 20) / 100)), 8) AS cc FROM px GROUP BY image")
def filter_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Light through three dimmed filters, and through colour-compensating ones."""
    r, g, b = channels()
    return pixels(spark, sf_dir).groupBy("image").agg(F.round(F.avg((1 - 0.5 * (1 - r)) * (1 - 0.3 * (1 - g)) * (1 - 0.2 * (1 - b))), 8).alias("through"), F.round(F.avg(F.pow(F.lit(10.0), -(r * 30 + g * 20) / 100)), 8).alias("cc"))


@query(f"WITH {PX} SELECT image, {', '.join(f'round({row_sql(row, chr(114), chr(103), chr(98))} * 0.99731, 8) AS {n}' for row, n in zip(C.RGB_TO_XYZ, 'xyz', strict=True))} FROM px")
def matmul(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("image", *rounded("xyz", [v * 0.99731 for v in C.matrix(C.RGB_TO_XYZ, *channels())]))


@query("SELECT CAST(380 + 5 * k AS INT) AS wl, round(power((380 + 5 * k) / 560.0, -5) * (exp(1.4387769e7 / (560.0 * 5000)) - 1) / (exp(1.4387769e7 / ((380 + 5 * k) * 5000.0)) - 1), 8) AS v FROM (SELECT unnest(range(0, 81)) AS k)")
def planck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A black body's spectrum at 5000 K, 1 at 560 nm."""
    wl = F.col("id") * 5 + 380
    return spark.range(81).select(wl.cast("int").alias("wl"), F.round(F.pow(wl / 560.0, F.lit(-5.0)) * (F.exp(F.lit(1.4387769e7 / (560.0 * 5000))) - 1) / (F.exp(1.4387769e7 / (wl * 5000.0)) - 1), 8).alias("v"))
