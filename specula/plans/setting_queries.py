"""Settings made ready for a run: switches that override values, orders of channels, gains, and folds of a table's faces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specula.operators import lookup_tables as L
from specula.plans.colour_queries import RGB, channels
from specula.plans.registry import query
from specula.plans.table_queries import _LUT, N, SHAPE
from specula.sources.tables import PX, pixels, table

#: Which values each switch sets to zero; grain and glare as a whole are switched off by name.
PREVIEW = ("enlarger_blur", "coupler_diffusion", "grain_area", "grain_blur", "glare_blur", "camera_blur", "scanner_blur")
NO_SPATIAL = ("scatter_core", "halation_first", "coupler_diffusion", "grain_blur", "dye_clouds_blur", "glare_blur", "camera_blur", "enlarger_blur", "scanner_blur")
SETTINGS = tuple(dict.fromkeys((*PREVIEW, *NO_SPATIAL)))
_OFF = {s: " OR ".join(c for c, names in (("p_size % 2 = 0", PREVIEW), ("p_size % 3 = 0", NO_SPATIAL)) if s in names) for s in SETTINGS}


@query(f"SELECT p_partkey AS id, {', '.join(f'CASE WHEN {_OFF[s]} THEN 0.0 ELSE p_retailprice + {k} END AS {s}' for k, s in enumerate(SETTINGS))}, NOT (p_size % 2 = 0 OR p_size % 5 = 0) AS grain_active, NOT p_size % 5 = 0 AS glare_active, NOT p_size % 3 = 0 AS diffusion_active FROM part")
def params_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings with what preview, no spatial effects and no random effects switch off; a preview keeps halation."""
    preview, spatial, random = (F.pmod("p_size", F.lit(k)) == 0 for k in (2, 3, 5))
    off = lambda s: reduce(lambda a, b: a | b, [c for c, names in ((preview, PREVIEW), (spatial, NO_SPATIAL)) if s in names])
    values = [F.when(off(s), 0.0).otherwise(F.col("p_retailprice") + k).alias(s) for k, s in enumerate(SETTINGS)]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *values, (~(preview | random)).alias("grain_active"), (~random).alias("glare_active"), (~spatial).alias("diffusion_active"))


@query(f"WITH {PX}, o AS (SELECT *, CASE image % 3 WHEN 0 THEN [1, 2, 3] WHEN 1 THEN [3, 1, 2] ELSE [2, 1, 3] END AS o FROM px) SELECT image, {', '.join(f'round([r, g, b][o[{k + 1}]], 8) AS {c}' for k, c in enumerate(RGB))} FROM o")
def col_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels in the order that an image's settings name; 0, 1, 2 leaves them."""
    order = lambda *k: F.array(*map(F.lit, k))
    of = F.when(F.col("image") % 3 == 0, order(0, 1, 2)).when(F.col("image") % 3 == 1, order(2, 0, 1)).otherwise(order(1, 0, 2))
    df = pixels(spark, sf_dir).select("image", F.array(*channels()).alias("v"), of.alias("o"))
    return df.select("image", *(F.round(F.get("v", F.get("o", F.lit(k))), 8).alias(c) for k, c in enumerate(RGB)))


#: Middle grey, and the offset, slope and shift of the V-Log curve's upper part.
GREY, VLOG_B, VLOG_C, VLOG_D = 0.18, 0.00873, 0.241514, 0.598206


@query(f"SELECT p_partkey AS id, CASE WHEN p_size % 9 = 0 THEN 1.0 ELSE round({GREY} * power(2.0, p_size % 9 - 1) / CASE p_size % 3 WHEN 0 THEN power(10.0, (1 - {VLOG_D}) / {VLOG_C}) - {VLOG_B} ELSE 1.0 END, 6) END AS gain FROM part")
def exposure_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gain that puts a source's white so many stops above middle grey; 1 where no stops are set."""
    white = F.when(F.pmod("p_size", F.lit(3)) == 0, F.pow(F.lit(10.0), F.lit((1 - VLOG_D) / VLOG_C)) - VLOG_B).otherwise(1.0)
    k = F.pmod("p_size", F.lit(9))
    stops = F.when(k > 0, k - 1)
    gain = F.round(GREY * F.pow(F.lit(2.0), stops) / white, 6)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.coalesce(gain, F.lit(1.0)).alias("gain"))


#: For each fixed axis the free ones, in order.
_FREE = {"r": ("g", "b"), "g": ("r", "b"), "b": ("r", "g")}


def _face_sql(f: str, u: str, v: str) -> str:
    at = lambda t, du, dv: f"{t}.i{f} = o.i{f} AND {t}.i{u} = o.i{u} + {du} AND {t}.i{v} = o.i{v} + {dv}"
    det = f"(p.{u} - o.{u}) * (q.{v} - o.{v}) - (p.{v} - o.{v}) * (q.{u} - o.{u})"
    return f"SELECT '{f}' AS axis, o.i{f} AS place, {det} AS det FROM warped o JOIN warped p ON {at('p', 1, 0)} JOIN warped q ON {at('q', 0, 1)} WHERE o.i{f} IN (0, {N - 1})"


@query(f"WITH {_LUT}, warped AS (SELECT ir, ig, ib, r - 1.2 * g * g AS r, g, b FROM lut), d AS ({' UNION ALL '.join(_face_sql(f, *_FREE[f]) for f in RGB)}) SELECT axis, place, count(*) AS cells, least(count(*) FILTER (det < -1e-9), count(*) FILTER (det > 1e-9)) AS flips FROM d GROUP BY axis, place")
def face_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds of a table's six faces: cells whose orientation is the rarer of the face. Rounding counts as none."""
    r, g, b = SHAPE(*channels())
    o = L.lattice(spark, N).select("ir", "ig", "ib", r.alias("r"), g.alias("g"), b.alias("b")).withColumn("r", F.col("r") - 1.2 * F.col("g") * F.col("g"))
    out = None
    for f, (u, v) in _FREE.items():
        face = o.where(F.col(f"i{f}").isin(0, N - 1)).select(F.col(f"i{f}").alias("place"), F.col(f"i{u}").alias("u"), F.col(f"i{v}").alias("v"), F.col(u).alias("x"), F.col(v).alias("y"))
        below = face.select("place", (F.col("u") - 1).alias("u"), "v", F.col("x").alias("ux"), F.col("y").alias("uy"))
        right = face.select("place", "u", (F.col("v") - 1).alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"))
        cells = face.join(below, ["place", "u", "v"]).join(right, ["place", "u", "v"])
        det = (F.col("ux") - F.col("x")) * (F.col("vy") - F.col("y")) - (F.col("uy") - F.col("y")) * (F.col("vx") - F.col("x"))
        part = cells.select(F.lit(f).alias("axis"), "place", det.alias("det"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("axis", "place").agg(F.count(F.lit(1)).alias("cells"), F.least(F.count_if(F.col("det") < -1e-9), F.count_if(F.col("det") > 1e-9)).alias("flips"))
