"""Colour differences, regions, measures of curves and tables, cubic tables, light through dyes, couplers between layers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specula.functions import colour as C
from specula.operators import lookup_tables as L
from specula.plans.colour_queries import LAB, LIN, RGB, channels, f_inverse_sql, f_sql, lin_sql, linear, rounded, row_sql, srgb_sql
from specula.plans.frame_queries import C1, C2, C3, M1, M2, SAME, _COUPLERS
from specula.operators.ranges import per_sample
from specula.plans.registry import query
from specula.plans.signal_queries import stencils, interpolated
from specula.plans.stage_queries import _hue_sql
from specula.plans.table_queries import _CELLS, _LUT, N, SHAPE
from specula.sources.tables import FRAME, HEIGHT, PX, SIG, SPEC, WIDTH, files, frames, pixels, signal, spectra, table

# --- differences between an image and a copy with red and green lowered

LOWERED = (0.9, 0.95, 1.0)
_TWO = f"{LIN}, two AS (SELECT image, r, g, b, {', '.join(f'{c} * {k} AS {c}2' for c, k in zip(RGB, LOWERED, strict=True))} FROM lin)"


def _lab_cte(suffix: str) -> str:
    of = [f"{c}{suffix}" for c in RGB]
    return ", ".join(f"{f_sql(f'({row_sql(row, *of)} / {w!r})')} AS {n}{suffix or 1}" for row, w, n in zip(C.RGB_TO_XYZ, C.WHITE, "xyz", strict=True))


_POW7 = 25.0**7


@query(
    f"""WITH {_TWO}, f AS (SELECT image, {_lab_cte('')}, {_lab_cte('2')} FROM two), q AS (SELECT image, {', '.join(f'116 * y{k} - 16 AS l{k}, 500 * (x{k} - y{k}) AS a{k}, 200 * (y{k} - z{k}) AS b{k}' for k in (1, 2))} FROM f),
m AS (SELECT *, power((sqrt(a1 * a1 + b1 * b1) + sqrt(a2 * a2 + b2 * b2)) / 2, 7) AS m7 FROM q), s AS (SELECT *, 1.5 - 0.5 * sqrt(m7 / (m7 + {_POW7!r})) AS s FROM m),
p AS (SELECT image, l1, l2, {', '.join(f'sqrt(s * a{k} * s * a{k} + b{k} * b{k}) AS c{k}, degrees(atan2(round(b{k}, 9), round(s * a{k}, 9))) AS t{k}' for k in (1, 2))} FROM s),
h AS (SELECT *, {', '.join(f'CASE WHEN t{k} < 0 THEN t{k} + 360 ELSE t{k} END AS h{k}' for k in (1, 2))} FROM p),
d AS (SELECT *, CASE WHEN abs(h2 - h1) <= 180 THEN h2 - h1 WHEN h2 > h1 THEN h2 - h1 - 360 ELSE h2 - h1 + 360 END AS dh, CASE WHEN abs(h2 - h1) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS hm, (l1 + l2) / 2 AS lm, (c1 + c2) / 2 AS cm FROM h),
w AS (SELECT *, 1 - 0.17 * cos(radians(hm - 30)) + 0.24 * cos(radians(2 * hm)) + 0.32 * cos(radians(3 * hm + 6)) - 0.20 * cos(radians(4 * hm - 63)) AS t, 2 * sqrt(power(cm, 7) / (power(cm, 7) + {_POW7!r})) * sin(radians(60 * exp(-power((hm - 275) / 25, 2)))) AS turn FROM d),
e AS (SELECT image, turn, (l2 - l1) / (1 + 0.015 * (lm - 50) * (lm - 50) / sqrt(20 + (lm - 50) * (lm - 50))) AS dl, (c2 - c1) / (1 + 0.045 * cm) AS dc, 2 * sqrt(c1 * c2) * sin(radians(dh / 2)) / (1 + 0.015 * cm * t) AS dh FROM w)
SELECT image, round(avg(sqrt(greatest(dl * dl + dc * dc + dh * dh - turn * dc * dh, 0.0))), 6) AS delta FROM e GROUP BY image"""
)
def delta_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean CIEDE2000 difference of each image to a copy with red and green lowered."""
    lin = linear()
    first, second = C.linear_to_lab(*lin), C.linear_to_lab(*(c * k for c, k in zip(lin, LOWERED, strict=True)))
    df = pixels(spark, sf_dir).select("image", *(v.alias(f"{n}{k}") for k, lab in ((1, first), (2, second)) for n, v in zip("lab", lab, strict=True)))
    col = lambda n: F.col(n)
    mean7 = F.pow((C.chroma(col("a1"), col("b1")) + C.chroma(col("a2"), col("b2"))) / 2, F.lit(7.0))
    df = df.withColumn("m7", mean7).withColumn("s", 1.5 - 0.5 * F.sqrt(col("m7") / (col("m7") + _POW7)))
    for k in "12":
        a, b = col("s") * col(f"a{k}"), col(f"b{k}")
        df = df.withColumn(f"c{k}", C.chroma(a, b)).withColumn(f"h{k}", C.hue_degrees(F.round(a, 9), F.round(b, 9)))
    h1, h2, c1, c2 = (col(x) for x in ("h1", "h2", "c1", "c2"))
    near, sum_ = F.abs(h2 - h1) <= 180, h1 + h2
    df = df.withColumns(
        {
            "dh": F.when(near, h2 - h1).when(h2 > h1, h2 - h1 - 360).otherwise(h2 - h1 + 360),
            "hm": F.when(near, sum_ / 2).when(sum_ < 360, (sum_ + 360) / 2).otherwise((sum_ - 360) / 2),
            "lm": (col("l1") + col("l2")) / 2 - 50,
            "cm": (c1 + c2) / 2,
        }
    )
    hm, cm, lm = col("hm"), col("cm"), col("lm")
    wave = lambda f, shift: F.cos(F.radians(f * hm + shift))
    t = 1 - 0.17 * wave(1, -30) + 0.24 * wave(2, 0) + 0.32 * wave(3, 6) - 0.20 * wave(4, -63)
    c7 = F.pow(cm, F.lit(7.0))
    df = df.withColumns(
        {
            "turn": 2 * F.sqrt(c7 / (c7 + _POW7)) * F.sin(F.radians(60 * F.exp(-F.pow((hm - 275) / 25, F.lit(2.0))))),
            "dl": (col("l2") - col("l1")) / (1 + 0.015 * lm * lm / F.sqrt(20 + lm * lm)),
            "dc": (c2 - c1) / (1 + 0.045 * cm),
            "dt": 2 * F.sqrt(c1 * c2) * F.sin(F.radians(col("dh") / 2)) / (1 + 0.015 * cm * t),
        }
    )
    dl, dc, dt = col("dl"), col("dc"), col("dt")
    delta = F.sqrt(F.greatest(dl * dl + dc * dc + dt * dt - col("turn") * dc * dt, F.lit(0.0)))
    return df.groupBy("image").agg(F.round(F.avg(delta), 6).alias("delta"))


#: XYZ to wide-gamut RGB, that to cones, and coded cones to lightness and two opponent axes.
XYZ_TO_WIDE = ((1.7166512, -0.3556708, -0.2533663), (-0.6666844, 1.6164812, 0.0157685), (0.0176399, -0.0427706, 0.9421031))
WIDE_TO_CONES = ((1688 / 4096, 2146 / 4096, 262 / 4096), (683 / 4096, 2951 / 4096, 462 / 4096), (99 / 4096, 309 / 4096, 3688 / 4096))
CONES_TO_ITP = ((0.5, 0.5, 0.0), (6610 / 4096, -13613 / 4096, 7003 / 4096), (17933 / 4096, -17390 / 4096, -543 / 4096))


def _pq_sql(x: str) -> str:
    return f"power(({C1!r} + {C2!r} * power(greatest({x}, 0.0) / 10000, {M1!r})) / (1 + {C3!r} * power(greatest({x}, 0.0) / 10000, {M1!r})), {M2!r})"


def _step_sql(of: str, to: str, matrix, f=lambda x: x) -> str:
    return ", ".join(f"{f(row_sql(row, *(f'{c}{k}' for c in of)))} AS {n}{k}" for k in (1, 2) for row, n in zip(matrix, to, strict=True))


@query(
    f"""WITH {_TWO.replace('SELECT image, r, g, b, r * ', 'SELECT image, r AS r1, g AS g1, b AS b1, r * ')}, xyz AS (SELECT image, {_step_sql('rgb', 'xyz', C.RGB_TO_XYZ)} FROM two), wide AS (SELECT image, {_step_sql('xyz', 'rgb', XYZ_TO_WIDE)} FROM xyz), cones AS (SELECT image, {_step_sql('rgb', 'lms', WIDE_TO_CONES, _pq_sql)} FROM wide), itp AS (SELECT image, {_step_sql('lms', 'itp', CONES_TO_ITP)} FROM cones)
SELECT image, round(avg(720 * sqrt(power(i1 - i2, 2) + power(0.5 * (t1 - t2), 2) + power(p1 - p2, 2))), 5) AS delta FROM itp GROUP BY image"""
)
def delta_itp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean difference in just noticeable steps, by perceptually coded cones, to a copy with red and green lowered."""

    def code(x):
        e = F.pow(F.greatest(x, F.lit(0.0)) / 10000, F.lit(M1))
        return F.pow((C1 + C2 * e) / (1 + C3 * e), F.lit(M2))

    df = pixels(spark, sf_dir).select("image", *(v.alias(n) for n, v in zip(RGB, linear(), strict=True)))
    for k, factors in ((1, (1.0, 1.0, 1.0)), (2, LOWERED)):
        wide = C.matrix(XYZ_TO_WIDE, *C.matrix(C.RGB_TO_XYZ, *(c * f for c, f in zip(channels(), factors, strict=True))))
        df = df.withColumns({f"{n}{k}": code(v) for n, v in zip("lms", C.matrix(WIDE_TO_CONES, *wide), strict=True)})
    (i1, t1, p1), (i2, t2, p2) = (C.matrix(CONES_TO_ITP, *(F.col(f"{n}{k}") for n in "lms")) for k in (1, 2))
    two = F.lit(2.0)
    return df.groupBy("image").agg(F.round(F.avg(720 * F.sqrt(F.pow(i1 - i2, two) + F.pow(0.5 * (t1 - t2), two) + F.pow(p1 - p2, two))), 5).alias("delta"))


# --- colours brought back into the gamut, regions

#: Rounds at most, the factor of each, and how far a and b may be off after a round trip.
ROUNDS, SHRINK, OFF = 5, 0.8, 0.5
_BACK = f"{f_inverse_sql('((l + 16) / 116 + a / 500)')} * {C.WHITE[0]!r} AS x, {f_inverse_sql('((l + 16) / 116)')} AS y, {f_inverse_sql('((l + 16) / 116 - b / 200)')} * {C.WHITE[2]!r} AS z"
_OUT = ("cr", "cg", "cb")
_CLIPPED = ", ".join(f"least(greatest({row_sql(row, 'x', 'y', 'z')}, 0.0), 1.0) AS {n}" for row, n in zip(C.XYZ_TO_RGB, _OUT, strict=True))


@query(
    f"""WITH {LAB}, n AS (SELECT image, l, a * 1.6 AS a, b * 1.6 AS b, row_number() OVER () AS n FROM lab), t AS (SELECT image, n, k, l, a * power({SHRINK}, k) AS a, b * power({SHRINK}, k) AS b FROM n, (SELECT unnest(range(0, {ROUNDS + 1})) AS k)),
x AS (SELECT image, n, k, a, b, {_BACK} FROM t), c AS (SELECT image, n, k, a, b, {_CLIPPED} FROM x), f AS (SELECT *, {', '.join(f"{f_sql(f'({row_sql(row, *_OUT)} / {w!r})')} AS f{m}" for row, w, m in zip(C.RGB_TO_XYZ, C.WHITE, 'xyz', strict=True))} FROM c),
best AS (SELECT n, min(k) AS k FROM f WHERE k = {ROUNDS} OR (abs(500 * (fx - fy) - a) <= {OFF} AND abs(200 * (fy - fz) - b) <= {OFF}) GROUP BY n)
SELECT image, {', '.join(f"round({srgb_sql(c)}, 6) AS {m}" for c, m in zip(_OUT, RGB, strict=True))}, CAST(k AS INT) AS rounds FROM f JOIN best USING (n, k)"""
)
def gamut_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours outside the gamut drawn to grey at their lightness, a fifth of chroma a round, until a round trip keeps them."""
    light, a, b = C.linear_to_lab(*linear())
    lab = pixels(spark, sf_dir).select("image", light.alias("l"), (a * 1.6).alias("a"), (b * 1.6).alias("b"))
    # each round in three steps whose values are columns, so that none is computed twice
    unit = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    each = range(ROUNDS + 1)
    df = lab.withColumns({f"{n}{k}": v for k in each for n, v in zip("xyz", C.lab_to_xyz(F.col("l"), F.col("a") * SHRINK**k, F.col("b") * SHRINK**k), strict=True)})
    df = df.withColumns({f"{n}{k}": unit(v) for k in each for n, v in zip(RGB, C.matrix(C.XYZ_TO_RGB, *(F.col(f"{n}{k}") for n in "xyz")), strict=True)})
    rounds = F.lit(ROUNDS)
    for k in reversed(range(ROUNDS)):
        df = df.withColumns({f"f{n}{k}": v for n, v in zip("xyz", C.matrix(C.RGB_TO_XYZ, *(F.col(f"{c}{k}") for c in RGB)), strict=True)})
        _, a, b = C.xyz_to_lab(*(F.col(f"f{n}{k}") for n in "xyz"))
        df = df.withColumns({f"a{k}": a, f"d{k}": b})
        kept = (F.abs(F.col(f"a{k}") - F.col("a") * SHRINK**k) <= OFF) & (F.abs(F.col(f"d{k}") - F.col("b") * SHRINK**k) <= OFF)
        rounds = F.when(kept, k).otherwise(rounds)
    df = df.withColumn("rounds", rounds)
    of = lambda c: F.get(F.array(*(F.col(f"{c}{k}") for k in each)), "rounds")
    return df.select("image", *(of(c).alias(c) for c in RGB), "rounds").select("image", *rounded(RGB, [C.linear_to_srgb(c) for c in channels()], 6), "rounds")


def _ramp_sql(x: str, lo: float, hi: float) -> str:
    t = f"least(greatest(({x} - {lo}) / {hi - lo}, 0.0), 1.0)"
    return f"({t} * {t} * (3 - 2 * {t}))"


def _turn_sql(centre: int) -> str:
    return f"(CASE WHEN abs(h - {centre}) > 180 THEN 360 - abs(h - {centre}) ELSE abs(h - {centre}) END)"


_MASKED = "(SELECT l_suppkey AS image, (l_linenumber - 1) / 6.0 AS down, CASE l_returnflag WHEN 'R' THEN 0.8 ELSE 0.0 END AS person, least(greatest(l_quantity / 50, 0.0), 1.0) AS r, least(greatest(1 - 10 * l_discount, 0.0), 1.0) AS g, least(greatest(l_tax / 0.08, 0.0), 1.0) AS b FROM lineitem)"


@query(
    f"""WITH m AS {_MASKED}, f AS (SELECT image, down, person, {', '.join(f"{f_sql(f'({row_sql(row, *(lin_sql(c) for c in RGB))} / {w!r})')} AS {n}" for row, w, n in zip(C.RGB_TO_XYZ, C.WHITE, 'xyz', strict=True))} FROM m), lab AS (SELECT image, down, person, 116 * y - 16 AS l, 500 * (x - y) AS a, 200 * (y - z) AS b FROM f),
h AS (SELECT *, sqrt(a * a + b * b) AS c, {_hue_sql()} AS h FROM lab), s AS (SELECT *, least(greatest((1 - {_ramp_sql(_turn_sql(210), 20, 70)}) * {_ramp_sql('l', 55, 72)} * {_ramp_sql('c', 3, 14)} * (1 - 0.65 * down) * (1 - person), 0.0), 1.0) AS sky FROM h),
v AS (SELECT *, least(greatest((1 - {_ramp_sql(_turn_sql(110), 25, 65)}) * {_ramp_sql('c', 8, 20)} * (1 - person) * (1 - sky), 0.0), 1.0) AS veg FROM s) SELECT image, person, round(sky, 6) AS sky, round(veg, 6) AS veg, round(least(greatest(1 - person - sky - veg, 0.0), 1.0), 6) AS rest FROM v"""
)
def region_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft masks of sky (bright, blue, high up), plants (green) and the rest, beside a given mask of persons."""
    light, a, b = C.linear_to_lab(*linear())
    given = F.when(F.col("l_returnflag") == "R", 0.8).otherwise(0.0).alias("person")
    df = pixels(spark, sf_dir, ((F.col("l_linenumber") - 1) / 6.0).alias("down"), given)
    df = df.select("image", "down", "person", light.alias("l"), C.chroma(a, b).alias("c"), C.hue_degrees(F.round(a, 9), F.round(b, 9)).alias("h"))
    near = lambda centre, lo, hi: 1 - C.smoothstep(C.hue_distance(F.col("h"), centre), lo, hi)
    unit = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    up = lambda c, lo, hi: C.smoothstep(F.col(c), lo, hi)
    others = 1 - F.col("person")
    df = df.withColumn("sky", unit(near(210, 20, 70) * up("l", 55, 72) * up("c", 3, 14) * (1 - 0.65 * F.col("down")) * others))
    df = df.withColumn("veg", unit(near(110, 25, 65) * up("c", 8, 20) * others * (1 - F.col("sky"))))
    return df.select("image", "person", *rounded(("sky", "veg", "rest"), (F.col("sky"), F.col("veg"), unit(others - F.col("sky") - F.col("veg"))), 6))


# --- curves and tables

#: The least slope, in density a stop, at which a stop counts as rendered; the step between samples in stops.
ACTIVE, STEP = 0.10, 0.5


@query(
    f"""WITH {SIG}, n AS (SELECT image, id, x, row_number() OVER w - 1 AS k, lead(x) OVER w AS after, lead(id) OVER w IS NULL AS final FROM sig WINDOW w AS (PARTITION BY image ORDER BY id)), e AS (SELECT image, min(k) FILTER (WHERE id % 7 > 0) AS lo, max(k) FILTER (WHERE id % 7 > 0) AS hi FROM n GROUP BY image),
a AS (SELECT image, min(k) AS first, max(k) AS last, count(*) AS n FROM n JOIN e USING (image) WHERE NOT final AND k >= lo AND k < hi AND round(abs(log10(greatest(after, 1e-4)) - log10(greatest(x, 1e-4))) / {STEP}, 9) > {ACTIVE} GROUP BY image)
SELECT e.image, coalesce(hi - lo, 0) * {STEP} AS encoded, coalesce(a.n, 0) * {STEP} AS active, coalesce(first - lo, hi - lo, 0) * {STEP} AS toe, coalesce(hi - 1 - last, hi - lo, 0) * {STEP} AS shoulder FROM e LEFT JOIN a ON a.image = e.image"""
)
def dynamic_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops that are encoded, that are rendered with enough slope, and that are lost at either end."""
    log = lambda e: F.log10(F.greatest(e["x"], F.lit(1e-4)))
    slope = lambda x, k, n: F.when(x(1).isNotNull(), F.round(F.abs(log(x(1)) - log(x(0))) / STEP, 9) > ACTIVE)
    rows = per_sample(stencils(spark, sf_dir, 1, False), ["image"], ["id", "k"], {"active": slope})
    used = F.when(F.col("id") % 7 > 0, F.col("k"))
    ends = rows.groupBy("image").agg(F.min(used).alias("lo"), F.max(used).alias("hi"))
    active = rows.where("active").join(ends, "image").where("k >= lo AND k < hi").groupBy("image").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.count(F.lit(1)).alias("n"))
    lo, hi = F.col("lo"), F.col("hi")
    stops = lambda name, *x: (F.coalesce(*x, F.lit(0)) * STEP).alias(name)
    return ends.join(active, "image", "left").select("image", stops("encoded", hi - lo), stops("active", F.col("n")), stops("toe", F.col("first") - lo, hi - lo), stops("shoulder", hi - 1 - F.col("last"), hi - lo))


_D = {(c, a): f"(q{a}.{c} - p{a}.{c})" for c in RGB for a in RGB}
_SAME = {a: " AND ".join(f"{{t}}{a}.i{c} = m.i{c}" + (" + {s}" if c == a else "") for c in RGB) for a in RGB}
_NEIGHBOURS = " ".join(f"JOIN lut q{a} ON {_SAME[a].format(t='q', s=1)} JOIN lut p{a} ON {_SAME[a].format(t='p', s=-1)}" for a in RGB)


def _gram_sql(a: str, b: str) -> str:
    return " + ".join(f"{_D[c, a]} * {_D[c, b]}" for c in RGB)


_EIGEN_SQL = """e AS (SELECT *, (rr + gg + bb) / 3 AS q FROM j), p AS (SELECT *, sqrt((power(rr - q, 2) + power(gg - q, 2) + power(bb - q, 2) + 2 * (rg * rg + rb * rb + gb * gb)) / 6) AS p FROM e),
d AS (SELECT *, CASE WHEN p > 0 THEN ((rr - q) * ((gg - q) * (bb - q) - gb * gb) - rg * (rg * (bb - q) - gb * rb) + rb * (rg * gb - (gg - q) * rb)) / (2 * p * p * p) ELSE 1.0 END AS d FROM p), v AS (SELECT *, acos(least(greatest(d, -1.0), 1.0)) / 3 AS v FROM d)"""


def eigenvalues(rr: Column, gg: Column, bb: Column, rg: Column, rb: Column, gb: Column) -> tuple[Column, Column]:
    """Largest and least eigenvalue of a symmetric matrix of three rows."""
    q = (rr + gg + bb) / 3
    two = F.lit(2.0)
    p = F.sqrt((F.pow(rr - q, two) + F.pow(gg - q, two) + F.pow(bb - q, two) + 2 * (rg * rg + rb * rb + gb * gb)) / 6)
    det = (rr - q) * ((gg - q) * (bb - q) - gb * gb) - rg * (rg * (bb - q) - gb * rb) + rb * (rg * gb - (gg - q) * rb)
    turn = F.acos(F.least(F.greatest(F.when(p > 0, det / (2 * p * p * p)).otherwise(1.0), F.lit(-1.0)), F.lit(1.0))) / 3
    return q + 2 * p * F.cos(turn), q + 2 * p * F.cos(turn + 2 * math.pi / 3)


@query(
    f"""WITH {_LUT}, j AS (SELECT m.ir, m.ig, m.ib, {', '.join(f'{_gram_sql(a, b)} AS {a}{b}' for a, b in ('rr', 'gg', 'bb', 'rg', 'rb', 'gb'))} FROM lut m {_NEIGHBOURS}), {_EIGEN_SQL}
SELECT ir, ig, ib, round(greatest(log10(sqrt(q + 2 * p * cos(v)) / greatest(sqrt(greatest(q + 2 * p * cos(v + {2 * math.pi / 3!r}), 0.0)), 1e-12)), 0.0), 5) AS log_cond FROM v"""
)
def jacobian_cond(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near to singular a table is round each inner point: log of the largest over the least stretch."""
    tables = L.baked(N, SHAPE)
    k = F.col("ir") + F.col("ig") * N + F.col("ib") * (N * N)
    inner = L.lattice(spark, N).where(" AND ".join(f"i{c} BETWEEN 1 AND {N - 2}" for c in RGB))
    d = {a: [F.get(t, (k + s).cast("int")) - F.get(t, (k - s).cast("int")) for t in tables] for a, s in zip(RGB, (1, N, N * N), strict=True)}
    gram = {a + b: sum(x * y for x, y in zip(d[a], d[b], strict=True)) for a, b in ("rr", "gg", "bb", "rg", "rb", "gb")}
    df = inner.select("ir", "ig", "ib", *(v.alias(n) for n, v in gram.items()))
    top, low = eigenvalues(*(F.col(n) for n in gram))
    ratio = F.sqrt(top) / F.greatest(F.sqrt(F.greatest(low, F.lit(0.0))), F.lit(1e-12))
    return df.select("ir", "ig", "ib", F.round(F.greatest(F.log10(ratio), F.lit(0.0)), 5).alias("log_cond"))


_TURN = 2 * math.pi / N


@query(
    f"""WITH {_LUT}, p AS (SELECT *, unnest(['r', 'g', 'b']) AS ch, unnest([r, g, b]) AS v FROM lut), l AS (SELECT axis, ch, v, CASE axis WHEN 'r' THEN ir WHEN 'g' THEN ig ELSE ib END AS p, CASE axis WHEN 'r' THEN ig * {N} + ib WHEN 'g' THEN ir * {N} + ib ELSE ir * {N} + ig END AS line FROM p, (SELECT unnest(['r', 'g', 'b']) AS axis)),
s AS (SELECT axis, f, sqrt(power(sum(v * cos(p * f * {_TURN!r})), 2) + power(sum(v * sin(p * f * {_TURN!r})), 2)) AS m FROM l, (SELECT unnest(range(0, {N // 2 + 1})) AS f) GROUP BY axis, ch, line, f) SELECT axis, round(sum(m) FILTER (WHERE f >= {max(1, N // 2 // 2)}) / greatest(sum(m), 1e-12), 8) AS share FROM s GROUP BY axis"""
)
def fft_highband(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Along each axis of a table, the share of its lines' spectrum in the upper band. A table has a fixed number of points."""
    at = dict(zip(RGB, ("ir", "ig", "ib"), strict=True))
    points = L.lattice(spark, N).select("ir", "ig", "ib", *(v.alias(c) for v, c in zip(SHAPE(*channels()), RGB, strict=True)))
    axes = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(at[a]).alias("at"), F.struct(*(at[c] for c in RGB if c != a)).cast("struct<a:int,b:int>").alias("line")) for a in RGB))).alias("x")
    lines = points.select("r", "g", "b", axes).select("x.*", F.explode(F.array(*(F.struct(F.lit(c).alias("ch"), F.col(c).alias("v")) for c in RGB))).alias("y"))
    waves = lines.select("axis", "at", "line", "y.*", F.explode(F.sequence(F.lit(0), F.lit(N // 2))).alias("f"))
    turn, v = F.col("at") * F.col("f") * _TURN, F.col("v")
    two = F.lit(2.0)
    m = waves.groupBy("axis", "ch", "line", "f").agg(F.sqrt(F.pow(F.sum(v * F.cos(turn)), two) + F.pow(F.sum(v * F.sin(turn)), two)).alias("m"))
    high = F.sum(F.when(F.col("f") >= max(1, N // 2 // 2), F.col("m")).otherwise(0.0))
    return m.groupBy("axis").agg(F.round(high / F.greatest(F.sum("m"), F.lit(1e-12)), 8).alias("share"))


def _cubic_sql(x: str) -> str:
    return f"(CASE WHEN abs({x}) < 1 THEN (7 * power(abs({x}), 3) - 12 * power({x}, 2) + 16.0 / 3) / 6 WHEN abs({x}) < 2 THEN (-7.0 / 3 * power(abs({x}), 3) + 12 * power({x}, 2) - 20 * abs({x}) + 32.0 / 3) / 6 ELSE 0.0 END)"


def cubic_weights(t: Column) -> list[Column]:
    """Weights of the four points round a place that is ``t`` of the way from the second to the third."""
    near = lambda x: (7 * x * x * x - 12 * x * x + 16.0 / 3) / 6
    far = lambda x: (-7.0 / 3 * x * x * x + 12 * x * x - 20 * x + 32.0 / 3) / 6
    return [far(t + 1), near(t), near(1 - t), far(2 - t)]


def _mirrored(i: Column, n: int) -> Column:
    return F.when(i < 0, -i).when(i >= n, 2 * n - 2 - i).otherwise(i)


def _axis_cte(axes: str) -> str:
    at = f"CASE WHEN i{{c}} - 1 + d < 0 THEN 1 - i{{c}} - d WHEN i{{c}} - 1 + d >= {N} THEN {2 * N - 2} - (i{{c}} - 1 + d) ELSE i{{c}} - 1 + d END"
    return ", ".join(f"k{c} AS (SELECT n, {at.format(c=c)} AS at, {_cubic_sql(f'(f{c} + 1 - d)')} AS w FROM cells, (SELECT CAST(unnest(range(0, 4)) AS INT) AS d))" for c in axes)


@query(
    f"""WITH {PX}, {_LUT}, {_CELLS}, {_axis_cte('rgb')}, w AS (SELECT n, kr.at AS ir, kg.at AS ig, kb.at AS ib, kr.w * kg.w * kb.w AS w FROM kr JOIN kg USING (n) JOIN kb USING (n)), s AS (SELECT n, {', '.join(f'sum(w * {c}) / sum(w) AS {c}' for c in RGB)} FROM w JOIN lut USING (ir, ig, ib) GROUP BY n)
SELECT image, {', '.join(f'round(s.{c}, 7) AS {c}' for c in RGB)} FROM cells JOIN s USING (n)"""
)
def lut_cubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of three dimensions by cubic weights of 64 points, mirrored at its ends."""
    df = pixels(spark, sf_dir)
    for k, c in enumerate(RGB):
        at = F.col(c) * (N - 1)
        df = df.withColumn(f"i{c}", F.least(F.floor(at), F.lit(N - 2)).cast("int")).withColumn(f"f{c}", at - F.col(f"i{c}"))
        weights = cubic_weights(F.col(f"f{c}"))
        df = df.withColumns({f"p{c}{d}": _mirrored(F.col(f"i{c}") + (d - 1), N) * N**k for d in range(4)} | {f"w{c}{d}": w for d, w in enumerate(weights)})
    # one axis after the other, in sums written out: lambdas over 64 points are not compiled
    df = df.withColumns({f"p{g}{b}": F.col(f"pg{g}") + F.col(f"pb{b}") for g in range(4) for b in range(4)})
    total = lambda c, f: sum(F.col(f"w{c}{d}") * f(d) for d in range(4))
    at = lambda t: total("b", lambda b: total("g", lambda g: total("r", lambda r: F.get(t, F.col(f"pr{r}") + F.col(f"p{g}{b}")))))
    whole = [sum(F.col(f"w{c}{d}") for d in range(4)) for c in RGB]
    return df.select("image", *rounded(RGB, [at(t) / (whole[0] * whole[1] * whole[2]) for t in L.baked(N, SHAPE)], 7))


@query(
    f"""WITH {PX}, {_LUT}, {_CELLS}, {_axis_cte('rg')}, s AS (SELECT n, sum(kr.w * kg.w * lut.g) / sum(kr.w * kg.w) AS v FROM kr JOIN kg USING (n) JOIN lut ON lut.ir = kr.at AND lut.ig = kg.at AND lut.ib = 0 GROUP BY n) SELECT image, round(v, 7) AS v FROM cells JOIN s USING (n)"""
)
def lut_cubic2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of two dimensions by cubic weights of 16 points, mirrored at its ends."""
    values, df, places, weights = L.baked(N, SHAPE)[1], pixels(spark, sf_dir), {}, {}
    for k, c in enumerate("rg"):
        at = F.col(c) * (N - 1)
        df = df.withColumn(f"i{c}", F.least(F.floor(at), F.lit(N - 2)).cast("int")).withColumn(f"f{c}", at - F.col(f"i{c}"))
        places[c] = [_mirrored(F.col(f"i{c}") + (d - 1), N) * N**k for d in range(4)]
        weights[c] = cubic_weights(F.col(f"f{c}"))
    pairs = [(x, y) for x in range(4) for y in range(4)]
    v = sum(weights["r"][x] * weights["g"][y] * F.get(values, places["r"][x] + places["g"][y]) for x, y in pairs)
    return df.select("image", F.round(v / (sum(weights["r"]) * sum(weights["g"])), 7).alias("v"))


PRINT = (lambda r, g, b: (r * 5 / 7 + b * 2 / 7, g * g * 6 / 7, b * 5 / 7 + r * g * 2 / 7))
_PRINT = ("r * 5 / 7 + b * 2 / 7", "g * g * 6 / 7", "b * 5 / 7 + r * g * 2 / 7")
FINE = 9


def _through_sql(name: str, source: str, lut: str) -> str:
    cells = ", ".join(f"CAST(least(floor({c} * {N - 1}), {N - 2}) AS INT) AS i{c}, {c} * {N - 1} - least(floor({c} * {N - 1}), {N - 2}) AS f{c}" for c in RGB)
    w = " * ".join(f"(CASE WHEN t.i{c} = c.i{c} THEN 1 - f{c} ELSE f{c} END)" for c in RGB)
    on = " AND ".join(f"(t.i{c} = c.i{c} OR t.i{c} = c.i{c} + 1)" for c in RGB)
    return f"{name} AS (SELECT n, {', '.join(f'least(greatest(sum({w} * t.{c}), 0.0), 1.0) AS {c}' for c in RGB)} FROM (SELECT n, {cells} FROM {source}) c JOIN {lut} t ON {on} GROUP BY n)"


@query(
    f"""WITH {_LUT}, print AS (SELECT ir, ig, ib, {', '.join(f'{s} AS {c}' for s, c in zip(_PRINT, RGB, strict=True))} FROM (SELECT ir, ig, ib, ir / 4.0 AS r, ig / 4.0 AS g, ib / 4.0 AS b FROM lut)), grid AS (SELECT n, n % {FINE} / 8.0 AS r, n // {FINE} % {FINE} / 8.0 AS g, n // {FINE * FINE} / 8.0 AS b FROM (SELECT unnest(range(0, {FINE ** 3})) AS n)), {_through_sql('film', 'grid', 'lut')}, {_through_sql('pair', 'film', 'print')}
SELECT n AS line, {', '.join(f'round({c}, 10) AS {c}' for c in RGB)} FROM pair"""
)
def lut_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables after one another as one finer table."""
    film, printed = L.baked(N, SHAPE), L.baked(N, PRINT)
    unit = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    first = L.lattice(spark, FINE).select(F.col("k").alias("line"), *(unit(L.trilinear(t, N, *channels())).alias(c) for t, c in zip(film, RGB, strict=True)))
    return first.select("line", *rounded(RGB, [unit(L.trilinear(t, N, *channels())) for t in printed], 10))


@query(f"WITH {_LUT} SELECT ib AS slice, ir, ig, {', '.join(f'CAST(least(greatest(round_even({srgb_sql(c)} * 255, 0), 0), 255) AS INTEGER) AS {c}' for c in RGB)} FROM lut WHERE ib IN (0, 2, 4)")
def lut_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of a table at three blues, as bytes for a display."""
    return L.lattice(spark, N).where("ib IN (0, 2, 4)").select(F.col("ib").alias("slice"), "ir", "ig", *(C.to_byte(C.linear_to_srgb(v)).alias(c) for v, c in zip(SHAPE(*channels()), RGB, strict=True)))


# --- light through dyes, reference black and white

_BANDS = range(64)
#: A made-up light and three made-up responses over 64 bands.
LIGHT = [round(0.6 + 0.4 * math.sin(math.pi * k / 63), 6) for k in _BANDS]
RESPONSES = [[round(math.exp(-0.5 * ((k - centre) / width) ** 2), 6) for k in _BANDS] for centre, width in ((42, 8), (34, 9), (14, 7))]
NORM = sum(a * b for a, b in zip(LIGHT, RESPONSES[1], strict=True))


@query(
    f"""WITH {SPEC}, l AS (SELECT name, unnest(bands) AS d, generate_subscripts(bands, 1) AS k FROM spec), t AS (SELECT name, k, CASE WHEN isnan(d) THEN 0.0 ELSE power(10, -abs(d)) * ({LIGHT})[k] END AS v FROM l)
SELECT name, {', '.join(f'round(log10(sum(v * ({r})[k]) / {NORM!r} + 1e-10), 7) AS log_{n}' for r, n in zip(RESPONSES, 'xyz', strict=True))} FROM t GROUP BY name"""
)
def spectral_xyz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of the three responses to a light behind dyes' spectral density, white at 1."""
    lit = F.transform("bands", lambda d, k: F.nanvl(F.pow(F.lit(10.0), -F.abs(d)) * F.get(F.lit(LIGHT), k), F.lit(0.0)))
    df = spectra(spark, sf_dir).select("name", lit.alias("v"))
    total = lambda r: F.aggregate(F.zip_with("v", F.lit(r), lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    return df.select("name", *rounded([f"log_{n}" for n in "xyz"], [F.log10(total(r) / NORM + 1e-10) for r in RESPONSES], 7))


BLACK, PAPER = 0.02, 0.95


@query(
    f"""WITH {LIN}, xyz AS (SELECT image, {', '.join(f"{row_sql(row, 'r', 'g', 'b')} AS {n}" for row, n in zip(C.RGB_TO_XYZ, 'xyz', strict=True))} FROM lin), e AS (SELECT image, min(y) AS lo, max(y) AS hi FROM xyz GROUP BY image), m AS (SELECT *, {PAPER - BLACK!r} / (hi - lo + 1e-10) AS m FROM e),
s AS (SELECT xyz.*, least(greatest(m * y + {BLACK} - m * lo, 0.0), 1.0) / (y + 1e-10) AS s FROM xyz JOIN m USING (image)) SELECT image, {', '.join(f'round({n} * s, 6) AS {n}' for n in 'xyz')} FROM s"""
)
def bw_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image's black and white brought to given levels, colours scaled with their luminance."""
    xyz = pixels(spark, sf_dir).select("image", *(v.alias(n) for n, v in zip("xyz", C.matrix(C.RGB_TO_XYZ, *linear()), strict=True)))
    ends = xyz.groupBy("image").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).withColumn("m", (PAPER - BLACK) / (F.col("hi") - F.col("lo") + 1e-10))
    y = F.col("y")
    new = F.least(F.greatest(F.col("m") * y + BLACK - F.col("m") * F.col("lo"), F.lit(0.0)), F.lit(1.0))
    return xyz.join(ends, "image").withColumn("s", new / (y + 1e-10)).select("image", *rounded("xyz", [F.col(n) * F.col("s") for n in "xyz"], 6))


#: Densities on a curve, and the part of each that three layers bear there.
LAYERS = [[(0.1, 0.1), (0.5, 0.35), (1.1, 0.5), (1.8, 0.55), (2.2, 0.6)], [(0.1, 0.0), (0.5, 0.15), (1.1, 0.5), (1.8, 0.7), (2.2, 0.8)], [(0.1, 0.0), (0.5, 0.0), (1.1, 0.1), (1.8, 0.55), (2.2, 0.8)]]


@query(
    f"""WITH {SIG}, seg AS (SELECT * FROM (VALUES {', '.join(f'({n}, {a[0]!r}, {b[0]!r}, {a[1]!r}, {(b[1] - a[1]) / (b[0] - a[0])!r})' for n, knots in enumerate(LAYERS) for a, b in zip(knots, knots[1:], strict=False))}) t(layer, x0, x1, y0, m)), d AS (SELECT image, id, x * 2.5 AS d FROM sig),
ends AS (SELECT * FROM (VALUES {', '.join(f'({n}, {k[0][1]!r}, {k[-1][1]!r})' for n, k in enumerate(LAYERS))}) t(layer, low, high)) SELECT image, id, CAST(e.layer AS INT) AS layer, round(CASE WHEN d <= 0.1 THEN low WHEN d > 2.2 THEN high ELSE y0 + (d - x0) * m END, 8) AS density FROM d CROSS JOIN ends e LEFT JOIN seg s ON s.layer = e.layer AND d > x0 AND d <= x1"""
)
def density_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a density is shared out among three layers of one colour, by their curves."""
    of = F.explode(F.array(*(F.struct(F.lit(n).alias("layer"), F.round(interpolated(F.col("d"), k), 8).alias("density")) for n, k in enumerate(LAYERS)))).alias("e")
    return signal(spark, sf_dir).select("image", "id", (F.col("x") * 2.5).alias("d")).select("image", "id", of).select("image", "id", "e.layer", "e.density")


#: Shares of the couplers' full amount, and of what dense layers give off beyond proportion.
AMOUNT, BEYOND = 2 / 3, 0.1


@query(
    f"""WITH m AS (SELECT * FROM (VALUES {', '.join(map(str, _COUPLERS))}) t(donor, taker, v)), px AS (SELECT l_suppkey AS image, row_number() OVER () AS n, [l_quantity / 50, 1 - 5 * l_discount, l_tax / 0.08] AS d FROM lineitem), v AS (SELECT image, n, unnest([0, 1, 2]) AS donor, unnest(d) AS x FROM px),
h AS (SELECT n, taker, sum((x + {BEYOND} * x * x) * v) * {AMOUNT!r} AS held FROM v JOIN m USING (donor) GROUP BY n, taker) SELECT image, {', '.join(f'round(log10(d[{k + 1}] + 1e-4) - sum(held) FILTER (WHERE taker = {k}), 7) AS {c}' for k, c in enumerate(RGB))} FROM px JOIN h USING (n) GROUP BY n, image, d"""
)
def couplers_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log exposures lowered by what all layers' densities give off."""
    df = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("image"), (F.col("l_quantity") / 50).alias("r"), (1 - 5 * F.col("l_discount")).alias("g"), (F.col("l_tax") / 0.08).alias("b"))
    off = [F.col(c) + BEYOND * F.col(c) * F.col(c) for c in RGB]
    held = [sum(off[d] * v for d, t, v in _COUPLERS if t == taker) * AMOUNT for taker in range(len(SAME))]
    return df.select("image", *rounded(RGB, [F.log10(F.col(c) + 1e-4) - h for c, h in zip(RGB, held, strict=True)], 7))


_STEPS = 33
_E = "(-4 + k * 0.25)"
_STEEP = (1.4, 1.5, 1.6)


@query(
    f"""WITH m AS (SELECT * FROM (VALUES {', '.join(map(str, _COUPLERS))}) t(donor, taker, v)), c AS (SELECT ch, k, {_E} AS e, 2.2 / (1 + exp(-{_E} * s)) AS d FROM (VALUES {', '.join(f'({n}, {s})' for n, s in enumerate(_STEEP))}) t(ch, s), (SELECT CAST(unnest(range(0, {_STEPS})) AS INT) AS k)),
a AS (SELECT taker AS ch, k, sum(d * v) * {AMOUNT!r} AS held FROM c JOIN m ON c.ch = m.donor GROUP BY taker, k), s AS (SELECT ch, k, e, e - held AS x, d FROM c JOIN a USING (ch, k)), g AS (SELECT *, lead(x) OVER w AS x1, lead(d) OVER w AS d1 FROM s WINDOW w AS (PARTITION BY ch ORDER BY k)), e AS (SELECT ch, min(x) AS lo, max(x) AS hi, min(d) AS dlo, max(d) AS dhi FROM s GROUP BY ch)
SELECT CAST(s.ch AS INT) AS ch, s.k, round(CASE WHEN s.e <= lo THEN dlo WHEN s.e >= hi THEN dhi ELSE g.d + (s.e - g.x) / (g.x1 - g.x) * (g.d1 - g.d) END, 7) AS density FROM s JOIN e USING (ch) LEFT JOIN g ON g.ch = s.ch AND s.e >= g.x AND s.e < g.x1"""
)
def couplers_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves as they are before couplers act, so that greys come out on the given ones. A curve has a fixed number of points."""
    e = lambda k: -4 + k * 0.25
    d = lambda ch, k: 2.2 / (1 + F.exp(-e(k) * _STEEP[ch]))
    k = F.col("k")
    moved = [e(k) - sum(d(donor, k) * v for donor, t, v in _COUPLERS if t == ch) * AMOUNT for ch in range(3)]
    rows = spark.range(_STEPS).select(F.col("id").cast("int").alias("k"))
    rows = rows.select("k", e(k).alias("e"), F.explode(F.array(*(F.struct(F.lit(ch).alias("ch"), moved[ch].alias("x"), d(ch, k).alias("d")) for ch in range(3)))).alias("c")).select("k", "e", "c.*")
    curves = rows.groupBy("ch").agg(F.array_sort(F.collect_list(F.struct("k", "e", "x", "d"))).alias("s"))  # _STEPS points
    x = lambda at, n: F.get("s", at)[n]

    def density(p):
        j = F.size(F.filter("s", lambda q: q["x"] <= p["e"])) - 1
        between = x(j, "d") + (p["e"] - x(j, "x")) / (x(j + 1, "x") - x(j, "x")) * (x(j + 1, "d") - x(j, "d"))
        return F.when(j < 0, x(F.lit(0), "d")).when(j >= _STEPS - 1, x(F.lit(_STEPS - 1), "d")).otherwise(between)

    points = curves.select("ch", F.explode(F.transform("s", lambda p: F.struct(p["k"].alias("k"), F.round(density(p), 7).alias("density")))).alias("p"))
    return points.select("ch", "p.k", "p.density")


# --- names of lenses


@query(
    r"""WITH l AS (SELECT p_partkey AS id, regexp_replace(trim(lower(p_name || '  ' || p_brand)), '\s+', ' ', 'g') AS model, regexp_replace(lower(p_name || '  ' || p_brand), '[^a-z0-9]', '', 'g') AS packed FROM part), q AS (SELECT p_partkey AS id, regexp_replace(trim(lower(' ' || p_name || CASE WHEN p_partkey % 3 = 0 THEN ' ' || p_brand ELSE '' END)), '\s+', ' ', 'g') AS model, regexp_replace(lower(p_name || CASE WHEN p_partkey % 3 = 0 THEN ' ' || p_brand ELSE '' END), '[^a-z0-9]', '', 'g') AS packed FROM part)
SELECT id, l.model = q.model AS exact, q.packed <> '' AND contains(l.packed, q.packed) AS holds, CAST(len(list_distinct(list_intersect(string_split(l.model, ' '), string_split(q.model, ' ')))) AS INT) AS common FROM l JOIN q USING (id)"""
)
def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well two spellings of a lens agree: equal but for case and spaces, one packed into the other, words in common."""
    own = F.concat("p_name", F.lit("  "), "p_brand")
    asked = F.concat(F.lit(" "), "p_name", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), "p_brand")).otherwise(""))
    tidy = lambda x: F.regexp_replace(F.trim(F.lower(x)), r"\s+", " ")
    packed = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", "")
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tidy(own).alias("a"), tidy(asked).alias("b"), packed(own).alias("pa"), packed(asked).alias("pb"))
    common = F.size(F.array_intersect(F.split("a", " "), F.split("b", " ")))
    return df.select("id", (F.col("a") == F.col("b")).alias("exact"), ((F.col("pb") != "") & F.contains("pa", "pb")).alias("holds"), common.alias("common"))


# --- a camera's own table of a filter, resampled

_WL = 81


@query(
    f"""WITH {SPEC}, b AS (SELECT family, unnest(bands) AS v, generate_subscripts(bands, 1) - 1 AS k FROM spec), p AS (SELECT family, k, CAST(round(avg(abs(v)) * 1000, 3) AS DOUBLE) / 100 AS y FROM b WHERE k < 17 GROUP BY family, k), m AS (SELECT family, k, y, (lead(y) OVER w - y) / 25 AS m2 FROM p WINDOW w AS (PARTITION BY family ORDER BY k)),
e AS (SELECT family, max(m2) FILTER (WHERE k = 0) AS a0, max(m2) FILTER (WHERE k = 1) AS a1, max(m2) FILTER (WHERE k = 15) AS z0, max(m2) FILTER (WHERE k = 14) AS z1 FROM m GROUP BY family),
s AS (SELECT family, k - 2 + 2 AS k, m2 AS m FROM m WHERE k < 16 UNION ALL SELECT family, -1, 2 * a0 - a1 FROM e UNION ALL SELECT family, -2, 3 * a0 - 2 * a1 FROM e UNION ALL SELECT family, 16, 2 * z0 - z1 FROM e UNION ALL SELECT family, 17, 3 * z0 - 2 * z1 FROM e),
t AS (SELECT p.family, p.k, p.y, c.m AS after, CASE WHEN abs(d.m - c.m) + abs(b.m - a.m) > 1e-9 THEN (abs(d.m - c.m) * b.m + abs(b.m - a.m) * c.m) / (abs(d.m - c.m) + abs(b.m - a.m)) ELSE 0.5 * (a.m + d.m) END AS t FROM p JOIN s a ON a.family = p.family AND a.k = p.k - 2 JOIN s b ON b.family = p.family AND b.k = p.k - 1 JOIN s c ON c.family = p.family AND c.k = p.k JOIN s d ON d.family = p.family AND d.k = p.k + 1),
u AS (SELECT *, lead(t) OVER w AS t1 FROM t WINDOW w AS (PARTITION BY family ORDER BY k)), w AS (SELECT CAST(380 + 5 * i AS INT) AS wl, CAST(least(i // 5, 15) AS INT) AS k, 5.0 * i - 25.0 * least(i // 5, 15) AS h FROM (SELECT unnest(range(0, {_WL})) AS i))
SELECT family, wl, round(y + h * (t + h * ((3 * after - 2 * t - t1) / 25 + h * (t + t1 - 2 * after) / 625)), 7) AS through FROM u JOIN w USING (k)"""
)
def csv_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of wavelength and percent, repeated ones dropped, resampled by Akima's curve. A filter has a fixed number of bands."""
    b = spectra(spark, sf_dir).select("family", F.posexplode("bands").alias("k", "v")).where("k < 17")
    means = b.groupBy("family", "k").agg(F.round(F.avg(F.abs("v")) * 1000, 3).alias("y"))
    line = F.concat_ws(",", (380 + 25 * F.col("k")).cast("string"), F.col("y").cast("string"))
    text = means.groupBy("family").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))), lambda e: F.concat(e["line"], F.lit("\n"), e["line"])), "\n").alias("text"))
    points = F.transform(F.array_distinct(F.split("text", "\n")), lambda x: F.get(F.split(x, ","), F.lit(1)).cast("double") / 100)
    df = text.select("family", points.alias("y"))
    m = F.transform(F.slice("y", F.lit(1), F.size("y") - 1), lambda y, k: (F.get("y", k + 1) - y) / 25)
    df = df.withColumn("m", m)
    at = lambda k: F.get("m", F.lit(k) if k >= 0 else F.size("m") + k)
    ends = [3 * at(0) - 2 * at(1), 2 * at(0) - at(1), 2 * at(-1) - at(-2), 3 * at(-1) - 2 * at(-2)]
    df = df.withColumn("m", F.concat(F.array(*ends[:2]), "m", F.array(*ends[2:])))

    def slope(y, k):
        a, b, c, d = (F.get("m", k + j) for j in range(4))
        rest = F.abs(d - c) + F.abs(b - a)
        return F.when(rest > 1e-9, (F.abs(d - c) * b + F.abs(b - a) * c) / rest).otherwise(0.5 * (a + d))

    df = df.withColumn("t", F.transform("y", slope))
    i = F.explode(F.sequence(F.lit(0), F.lit(_WL - 1))).alias("i")
    df = df.select("family", "y", "m", "t", i).withColumn("k", F.least(F.floor(F.col("i") / 5), F.lit(15)).cast("int"))
    h, y, t0, t1, s = 5.0 * F.col("i") - 25.0 * F.col("k"), F.get("y", "k"), F.get("t", "k"), F.get("t", F.col("k") + 1), F.get("m", F.col("k") + 2)
    through = y + h * (t0 + h * ((3 * s - 2 * t0 - t1) / 25 + h * (t0 + t1 - 2 * s) / 625))
    return df.select("family", (380 + 5 * F.col("i")).alias("wl"), F.round(through, 7).alias("through"))


@query(
    f"""WITH {SPEC}, b AS (SELECT family, unnest(bands) AS v, generate_subscripts(bands, 1) - 1 AS k FROM spec WHERE family IN (0, 1, 2)) SELECT CAST(k AS INT) AS band, {', '.join(f'round(avg(abs(v)) FILTER (WHERE family = {n}), 8) AS {c}' for n, c in enumerate('cmy'))} FROM b GROUP BY k"""
)
def pivot_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three filters side by side, a row a band."""
    b = spectra(spark, sf_dir).where("family IN (0, 1, 2)").select("family", F.posexplode("bands").alias("band", "v"))
    wide = b.groupBy("band").pivot("family", [0, 1, 2]).agg(F.avg(F.abs("v")))
    return wide.select("band", *(F.round(F.col(str(n)), 8).alias(c) for n, c in enumerate("cmy")))


@query("SELECT kind, count(*) AS files FROM (SELECT CASE WHEN lower(e) IN ('.jpg', '.tif') THEN 'image' WHEN lower(e) IN ('.raf', '.dng') THEN 'raw' ELSE 'other' END AS kind FROM (SELECT (['.JPG', '.RAF', '.jpg', '.dng', '.tif', '.txt'])[p_size % 6 + 1] AS e FROM part)) GROUP BY kind")
def scan_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which reader each file goes to, by its ending."""
    ending = F.lower(F.regexp_extract("name", r"\.[A-Za-z0-9]+$", 0))
    kind = F.when(ending.isin(".jpg", ".tif"), "image").when(ending.isin(".raf", ".dng"), "raw").otherwise("other")
    return files(spark, sf_dir).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("files"))


_TEMPERATURES = range(2000, 12001, 500)


@query(
    f"""WITH t AS (SELECT CAST(unnest(range(2000, 12001, 500)) AS INT) AS kelvin), b AS (SELECT kelvin, k + 1 AS k, power((380 + 5 * k) / 560.0, -5) / (exp(1.4387769e7 / ((380 + 5 * k) * CAST(kelvin AS DOUBLE))) - 1) AS v FROM t, (SELECT unnest(range(0, 64)) AS k)),
s AS (SELECT kelvin, {', '.join(f'sum(v * ({r})[k]) AS {n}' for r, n in zip(RESPONSES, 'xyz', strict=True))} FROM b GROUP BY kelvin) SELECT kelvin, round(x / (x + y + z), 8) AS x, round(y / (x + y + z), 8) AS y FROM s"""
)
def planck_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chromaticities of black bodies over a range of temperatures."""
    kelvin = F.col("kelvin").cast("double")
    bands = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.pow((380 + 5 * k) / 560.0, F.lit(-5.0)) / (F.exp(1.4387769e7 / ((380 + 5 * k) * kelvin)) - 1))
    df = spark.range(_TEMPERATURES.start, _TEMPERATURES.stop, _TEMPERATURES.step).select(F.col("id").cast("int").alias("kelvin")).withColumn("v", bands)
    total = lambda r: F.aggregate(F.zip_with("v", F.lit(r), lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    df = df.select("kelvin", *(total(r).alias(n) for r, n in zip(RESPONSES, "xyz", strict=True)))
    whole = F.col("x") + F.col("y") + F.col("z")
    return df.select("kelvin", F.round(F.col("x") / whole, 8).alias("x"), F.round(F.col("y") / whole, 8).alias("y"))


#: Sensor noise in codes, and the step of differences.
NOISE, EPS = 0.005, 0.01
_SHIFTS = [tuple(sign * (k == axis) for k in range(3)) for axis in range(3) for sign in (1, -1)]
_GRAM = ("rr", "gg", "bb", "rg", "rb", "gb")


@query(
    f"""WITH {_LUT}, pts AS (SELECT k, 0.1 + 0.8 * (k % 4) / 3 AS r, 0.1 + 0.8 * (k // 4 % 4) / 3 AS g, 0.1 + 0.8 * (k // 16) / 3 AS b FROM (SELECT unnest(range(0, 64)) AS k)), sh AS (SELECT * FROM (VALUES {', '.join(f'({n}, {r * EPS}, {g * EPS}, {b * EPS})' for n, (r, g, b) in enumerate(_SHIFTS))}) t(s, dr, dg, db)),
src AS (SELECT k * 10 + s AS n, r + dr AS r, g + dg AS g, b + db AS b FROM pts CROSS JOIN sh), {_through_sql('seen', 'src', 'lut')}, lin AS (SELECT n, {', '.join(f'{lin_sql(c)} AS {c}' for c in RGB)} FROM seen), lms AS (SELECT n, {', '.join(f"cbrt({row_sql(row, 'r', 'g', 'b')}) AS {m}" for row, m in zip(C.RGB_TO_LMS, 'pqs', strict=True))} FROM lin),
ok AS (SELECT n // 10 AS k, n % 10 AS s, {', '.join(f"{row_sql(row, 'p', 'q', 's')} AS {m}" for row, m in zip(C.LMS_TO_OKLAB, ('v0', 'v1', 'v2'), strict=True))} FROM lms), slope AS (SELECT k, {', '.join(f'(max(v{m}) FILTER (WHERE s = {2 * a}) - max(v{m}) FILTER (WHERE s = {2 * a + 1})) / {2 * EPS} AS j{m}{c}' for m in range(3) for a, c in enumerate(RGB))} FROM ok GROUP BY k),
j AS (SELECT k, {', '.join(f"{' + '.join(f'j{m}{x} * j{m}{y}' for m in range(3))} AS {x}{y}" for x, y in _GRAM)}, {NOISE} * sqrt({' + '.join(f'j0{c} * j0{c}' for c in RGB)}) AS light, {NOISE} * sqrt({' + '.join(f'j{m}{c} * j{m}{c}' for m in (1, 2) for c in RGB)}) AS colour FROM slope), {_EIGEN_SQL}
SELECT CAST(k AS INT) AS k, round(light, 8) AS sigma_light, round(colour, 8) AS sigma_colour, round(sqrt(q + 2 * p * cos(v)), 6) AS stretch, round(sqrt(q + 2 * p * cos(v)) / greatest(sqrt(greatest(q + 2 * p * cos(v + {2 * math.pi / 3!r}), 0.0)), 1e-9), 4) AS unevenness FROM v"""
)
def noise_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a table spreads sensor noise: deviations in lightness and colour, the largest stretch and how uneven stretches are."""
    tables, k = L.baked(N, SHAPE), F.col("id").cast("int")
    at = lambda x: 0.1 + 0.8 * x / 3
    df = spark.range(64).select(k.alias("k"), at(k % 4).alias("r"), at(F.floor(k / 4) % 4).alias("g"), at(F.floor(k / 16)).alias("b"))
    unit = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    moves = F.explode(F.array(*(F.struct(F.lit(n).alias("s"), *(F.lit(d * EPS).alias(f"d{c}") for c, d in zip(RGB, shift, strict=True))) for n, shift in enumerate(_SHIFTS)))).alias("m")
    df = df.select("k", *RGB, moves).select("k", "m.s", *((F.col(c) + F.col(f"m.d{c}")).alias(c) for c in RGB))
    df = df.select("k", "s", *(unit(L.trilinear(t, N, *channels())).alias(c) for c, t in zip(RGB, tables, strict=True)))
    df = df.select("k", "s", *(v.alias(c) for c, v in zip(RGB, linear(), strict=True)))
    df = df.select("k", "s", *(v.alias(f"v{m}") for m, v in enumerate(C.oklab(*channels()))))
    of = lambda m, s: F.max(F.when(F.col("s") == s, F.col(f"v{m}")))
    df = df.groupBy("k").agg(*(((of(m, 2 * a) - of(m, 2 * a + 1)) / (2 * EPS)).alias(f"j{m}{c}") for m in range(3) for a, c in enumerate(RGB)))  # six rows a point
    total = lambda x, y, rows=range(3): sum(F.col(f"j{m}{x}") * F.col(f"j{m}{y}") for m in rows)
    spread = lambda rows: NOISE * F.sqrt(sum(total(c, c, rows) for c in RGB))
    df = df.select("k", spread((0,)).alias("light"), spread((1, 2)).alias("colour"), *(total(*xy).alias(xy) for xy in _GRAM))
    top, low = eigenvalues(*map(F.col, _GRAM))
    uneven = F.sqrt(top) / F.greatest(F.sqrt(F.greatest(low, F.lit(0.0))), F.lit(1e-9))
    return df.select("k", F.round("light", 8).alias("sigma_light"), F.round("colour", 8).alias("sigma_colour"), F.round(F.sqrt(top), 6).alias("stretch"), F.round(uneven, 4).alias("unevenness"))


#: The long side of a small copy.
SMALL = 16


def nearest(n: int) -> list[int]:
    """Places that a small copy takes from ``n``, by the nearest centre."""
    m = round(n * SMALL / max(HEIGHT, WIDTH))
    return [round((k + 0.5) * n / m - 0.5) for k in range(m)]


@query(
    f"""WITH {FRAME}, ys AS (SELECT * FROM (VALUES {', '.join(f'({k}, {y})' for k, y in enumerate(nearest(HEIGHT)))}) t(small_y, y)), xs AS (SELECT * FROM (VALUES {', '.join(f'({k}, {x})' for k, x in enumerate(nearest(WIDTH)))}) t(small_x, x)) SELECT image, CAST(small_y AS INT) AS y, CAST(small_x AS INT) AS x, round(v, 8) AS v FROM frame JOIN ys USING (y) JOIN xs USING (x)"""
)
def nn_downscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small copy of each frame by its nearest pixels; a filter and a renumbering, without a shuffle of its own."""
    place = lambda c, n: (F.array_position(F.lit(nearest(n)), F.col(c).cast("int")) - 1).cast("int")
    df = frames(spark, sf_dir).where(F.col("y").isin(nearest(HEIGHT)) & F.col("x").isin(nearest(WIDTH)))
    return df.select("image", place("y", HEIGHT).alias("y"), place("x", WIDTH).alias("x"), F.round("v", 8).alias("v"))


#: Ends of the three densities that a table spans.
SPAN = ((-0.1, 2.2), (0.0, 2.4), (0.05, 2.0))


@query(
    f"""SELECT CAST(k % {N} AS INT) AS ir, CAST(k // {N} % {N} AS INT) AS ig, CAST(k // {N * N} AS INT) AS ib, {', '.join(f'round(power(10, -{d}), 8) AS {c}' for c, d in zip(RGB, ('(r * 0.9 + g * 0.1)', '(g * 0.8 + b * 0.2)', '(b * 0.7 + r * 0.3)'), strict=True))}
FROM (SELECT k, {', '.join(f'{lo} + {(hi - lo) / (N - 1)!r} * (k // {N ** n} % {N}) AS {c}' for n, (c, (lo, hi)) in enumerate(zip(RGB, SPAN, strict=True)))} FROM (SELECT unnest(range(0, {N ** 3})) AS k))"""
)
def lut_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of three densities at the points of a table that spans their ranges."""
    df = L.lattice(spark, N).select("ir", "ig", "ib", *((lo + (hi - lo) / (N - 1) * F.col(f"i{c}")).alias(c) for c, (lo, hi) in zip(RGB, SPAN, strict=True)))
    r, g, b = channels()
    dyes = (r * 0.9 + g * 0.1, g * 0.8 + b * 0.2, b * 0.7 + r * 0.3)
    return df.select("ir", "ig", "ib", *rounded(RGB, [F.pow(F.lit(10.0), -d) for d in dyes]))
