"""Composite stages: measure an image with one aggregate, then map its pixels with what was measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specula.functions import colour as C
from specula.plans.colour_queries import LAB, LIN, RGB, channels, f_inverse_sql, f_sql, lin_sql, linear, luma_sql, rounded, row_sql, srgb_sql
from specula.plans.registry import query
from specula.plans.statistics_queries import _ramp_sql, _squeeze_sql, percentile
from specula.sources.shared import written
from specula.sources.tables import PX, pixels

#: Lightness that a style aims at for the 5th, 50th and 95th percentile; the least luminance; the gain's limit in stops.
AIMS, LEAST, LIMIT = (10.8, 58.8, 93.7), 1e-6, 3.0


def _aims() -> tuple[float, float, float]:
    """Luminance of the aims, which keep apart by 2 %."""
    low, mid, high = (((x + 16) / 116) ** 3 if x > 8 else x / (24389 / 27) for x in AIMS)
    return min(low, mid * 0.98), mid, max(high, mid * 1.02)


_QUANTILES = "y AS (SELECT *, {y} AS y FROM {of}), q AS (SELECT image, " + ", ".join(f"greatest(quantile_cont(greatest(y, 0.0), {p}), {LEAST}) AS q{n}" for n, p in ((5, 0.05), (50, 0.5), (95, 0.95))) + " FROM y GROUP BY image)"
_T = "log2(greatest(y, 1e-6))"


def _curve_sql(t5: str, t50: str, t95: str) -> str:
    """Output over input of the curve through the ends and three points, between stops; knots that meet are pushed apart."""
    xs = [f"log2({LEAST})", "(log2(q5) + 1e-7)", "(log2(q50) + 2e-7)", "(log2(q95) + 3e-7)"]
    ys = [f"log2({LEAST})", f"log2({t5})", f"log2({t50})", f"log2({t95})"]
    parts = " ".join(f"WHEN {_T} < {xs[k + 1]} THEN {ys[k]} + ({_T} - {xs[k]}) * (({ys[k + 1]} - {ys[k]}) / ({xs[k + 1]} - {xs[k]}))" for k in range(3))
    return f"power(2, CASE {parts} ELSE {ys[3]} END) / greatest(y, {LEAST})"


def quantiles(df: DataFrame, of: dict[str, tuple[str, float]]) -> DataFrame:
    """image and, under each name, an exact quantile of a column without nulls, to the bit that of ``percentile``.

    Values are sorted and numbered within images, and those at the places are picked; that spills, where ``percentile`` holds
    a map of an image's values, whose making and merging took most of a step's time.
    """
    columns, agg, picked = sorted({c for c, _ in of.values()}), [], []
    df = df.select("image", *columns)
    for c in columns:
        by = Window.partitionBy("image").orderBy(F.col(c).asc_nulls_last())
        df = df.withColumns({f"{c}_n": F.count(c).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), f"{c}_k": F.row_number().over(by)})
    for name, (c, p) in of.items():
        place = (F.col(f"{c}_n") - 1) * F.lit(float(p))
        low, high = F.floor(place), F.ceil(place)
        agg += [F.max(F.when(F.col(f"{c}_k") - 1 == at, F.col(c))).alias(f"{name}_{k}") for k, at in enumerate((low, high))] + [F.first(place).alias(f"{name}_p")]
        x, y, at = (F.col(f"{name}_{k}") for k in "01p")
        picked.append(F.when(x == y, x).otherwise((F.ceil(at) - at) * x + (at - F.floor(at)) * y).alias(name))
    return df.groupBy("image").agg(*agg).select("image", *picked)


def measured(df: DataFrame, y: Column) -> DataFrame:
    """q5, q50 and q95 of each image's luminance, exact; a row an image."""
    p = F.percentile(F.greatest(y, F.lit(0.0)), F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return df.groupBy("image").agg(p.alias("p")).select("image", *(F.greatest(F.get("p", F.lit(k)), F.lit(LEAST)).alias(f"q{n}") for k, n in enumerate((5, 50, 95))))


def curve_gain(y: Column, aims) -> Column:
    """Output over input of a curve through the ends and three points, between stops; knots that meet are pushed apart."""
    least = F.log2(F.lit(LEAST))
    xs = [least, *(F.log2(F.col(f"q{n}")) + k * 1e-7 for k, n in ((1, 5), (2, 50), (3, 95)))]
    ys = [least, *(F.log2(a) for a in aims)]
    t = F.log2(F.greatest(y, F.lit(LEAST)))
    part = lambda k: ys[k] + (t - xs[k]) * ((ys[k + 1] - ys[k]) / (xs[k + 1] - xs[k]))
    out = F.when(t < xs[1], part(0)).when(t < xs[2], part(1)).when(t < xs[3], part(2)).otherwise(ys[3])
    return F.pow(F.lit(2.0), out) / F.greatest(y, F.lit(LEAST))


@query(
    f"""WITH {LIN}, {_QUANTILES.format(y=luma_sql(), of='lin')} SELECT image, {', '.join(f"round(116 * {f_sql(f'q{n}')} - 16, 6) AS l{n}" for n in (5, 50, 95))}, {', '.join(f'round({a!r}, 8) AS aim{n}' for a, n in zip(_aims(), (5, 50, 95), strict=True))}, round(log2({_aims()[1]!r} / q50), 6) AS ev FROM q"""
)
def tone_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each image's dark, middle and bright percentiles lie, where a style wants them, and the stops between the middles."""
    q = measured(pixels(spark, sf_dir), C.luma(*linear()))
    aims = (F.round(F.lit(a), 8).alias(f"aim{n}") for a, n in zip(_aims(), (5, 50, 95), strict=True))
    return q.select("image", *(F.round(C.lightness(F.col(f"q{n}")), 6).alias(f"l{n}") for n in (5, 50, 95)), *aims, F.round(F.log2(F.lit(_aims()[1]) / F.col("q50")), 6).alias("ev"))


@query(
    f"""WITH {LIN}, {_QUANTILES.format(y=luma_sql(), of='lin')}, k AS (SELECT image, r, g, b, least(greatest({_curve_sql(*map(repr, _aims()))}, {2**-LIMIT}), {2**LIMIT}) AS k FROM y JOIN q USING (image)), o AS (SELECT image, r * k AS r, g * k AS g, b * k AS b FROM k), w AS (SELECT *, {luma_sql()} AS y, greatest(r, g, b) AS m FROM o),
f AS (SELECT *, CASE WHEN m > 1 AND m > y THEN (1 - least(y, 1.0)) / (m - least(y, 1.0)) ELSE 1.0 END AS f FROM w) SELECT image, {', '.join(f'round(greatest(y + ({c} - y) * f, 0.0), 7) AS {c}' for c in RGB)} FROM f"""
)
def tone_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image's three percentiles brought to a style's, hues kept: one gain a pixel, then into the gamut."""
    lin = pixels(spark, sf_dir).select("image", *(c.alias(n) for c, n in zip(linear(), RGB, strict=True))).withColumn("y", C.luma(*channels()))
    df = lin.join(measured(lin, F.col("y")), "image")
    df = df.withColumn("k", F.least(F.greatest(curve_gain(F.col("y"), [F.lit(a) for a in _aims()]), F.lit(2**-LIMIT)), F.lit(2**LIMIT)))
    df = df.select("image", *((c * F.col("k")).alias(n) for c, n in zip(channels(), RGB, strict=True)))
    return df.select("image", *rounded(RGB, [F.greatest(c, F.lit(0.0)) for c in C.fit_gamut(*channels())], 7))


#: A style's most for darker blacks; the shapes (distance to the middle) and floors of both ends; the most for whites.
BLACK_DOWN, BLACK_SHAPE, BLACK_FLOOR, WHITE_SHAPE, WHITE_FLOOR, WHITE_MOST = 11.0, -53.1, 4.0, 31.8, 78.0, 8.0


@query(
    f"""WITH {PX}, d AS (SELECT image, r AS dr, g AS dg, b AS db, {luma_sql()} * 255 AS grey FROM px), h AS (SELECT image, avg(CAST(grey <= 3 AS INT)) AS le3, avg(CAST(grey <= 10 AS INT)) AS le10, avg(CAST(grey >= 252 AS INT)) AS ge252, avg(CAST(grey >= 245 AS INT)) AS ge245 FROM d GROUP BY image), lin AS (SELECT image, {', '.join(f'{lin_sql(c)} AS {c}' for c in RGB)} FROM px),
{_QUANTILES.format(y=luma_sql(), of='lin')}, l AS (SELECT q.*, {_squeeze_sql('le3', 'le10')} AS k_lo, {_squeeze_sql('ge252', 'ge245')} AS k_hi, {', '.join(f"116 * {f_sql(f'q{n}')} - 16 AS l{n}" for n in (5, 50, 95))} FROM q JOIN h USING (image)),
s AS (SELECT *, l5 - greatest(least({BLACK_DOWN}, greatest(0.0, l5 - l50 - ({BLACK_SHAPE})), l5 - {BLACK_FLOOR}) * k_lo, -30.0) AS a5, l95 - greatest(least(greatest(0.0, l95 - l50 - {WHITE_SHAPE}), {WHITE_MOST}, l95 - {WHITE_FLOOR}) * k_hi, 0.0) AS a95 FROM l),
a AS (SELECT *, least(greatest({f_inverse_sql('((a5 + 16) / 116)')}, {LEAST}), q50 * 0.98) AS t5, greatest({f_inverse_sql('((a95 + 16) / 116)')}, q50 * 1.02) AS t95 FROM s), k AS (SELECT image, r, g, b, {_curve_sql('t5', 'q50', 't95')} AS k FROM y JOIN a USING (image))
SELECT image, {', '.join(f"round(least({srgb_sql(f'({c} * k)')}, 1.0), 6) AS {c}" for c in RGB)} FROM k"""
)
def settle_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finished image's ends drawn to a shape round its own middle, down only, and less where an end has already lost detail."""
    df = pixels(spark, sf_dir).select("image", (C.luma(*channels()) * 255).alias("grey"), *(c.alias(n) for c, n in zip(linear(), RGB, strict=True))).withColumn("y", C.luma(*channels()))
    share = lambda test: F.avg(test.cast("int"))
    grey, zero = F.col("grey"), F.lit(0.0)
    h = df.groupBy("image").agg(share(grey <= 3).alias("le3"), share(grey <= 10).alias("le10"), share(grey >= 252).alias("ge252"), share(grey >= 245).alias("ge245"))
    squeeze = lambda clip, pile: F.round(F.when((F.col(clip) <= 1e-4) & (F.col(pile) <= 0.03), 1.0).otherwise(F.greatest(zero, 1 - F.col(pile) / 0.03 * 0.6)), 6)
    q = measured(df, F.col("y")).join(h, "image").withColumns({f"l{n}": C.lightness(F.col(f"q{n}")) for n in (5, 50, 95)})
    l5, l50, l95 = (F.col(f"l{n}") for n in (5, 50, 95))
    dark = F.least(F.lit(BLACK_DOWN), F.greatest(zero, l5 - l50 - BLACK_SHAPE), l5 - BLACK_FLOOR) * squeeze("le3", "le10")
    bright = F.least(F.greatest(zero, l95 - l50 - WHITE_SHAPE), F.lit(WHITE_MOST), l95 - WHITE_FLOOR) * squeeze("ge252", "ge245")
    q = q.withColumns({"a5": l5 - F.greatest(dark, F.lit(-30.0)), "a95": l95 - F.greatest(bright, zero)})
    t5 = F.least(F.greatest(C.from_lightness(F.col("a5")), F.lit(LEAST)), F.col("q50") * 0.98)
    q = q.select("image", "q5", "q50", "q95", t5.alias("t5"), F.greatest(C.from_lightness(F.col("a95")), F.col("q50") * 1.02).alias("t95"))
    df = df.select("image", "y", *RGB).join(q, "image").withColumn("k", curve_gain(F.col("y"), [F.col("t5"), F.col("q50"), F.col("t95")]))
    return df.select("image", *rounded(RGB, [F.least(C.linear_to_srgb(c * F.col("k")), F.lit(1.0)) for c in channels()], 6))


def _hue_sql() -> str:
    return "(CASE WHEN degrees(atan2(round(b, 9), round(a, 9))) < 0 THEN degrees(atan2(round(b, 9), round(a, 9))) + 360 ELSE degrees(atan2(round(b, 9), round(a, 9))) END)"


#: a* and b* of shadows, middle and highlights of a style, each against the image's medians; what the
#: deepest shadows get; the most that a part is moved; and the weight from which on the middle counts wholly.
SHADOWS, MIDDLE, HIGHLIGHTS, DEEPEST, MOVE, WHOLE = (-1.48, 0.75), (0.77, 4.81), (0.77, 0.23), (1.9, 1.0), 2.5, 0.70
#: Centres, half widths, changes of chroma and of lightness of ten bands of hue, the style's own changes of
#: chroma for them, the chroma about which colours begin to count, and the most by which bands together raise it.
BANDS = ((15.0, 34.0, -0.08, 3.0), (45.0, 34.0, 0.20, 2.0), (75.0, 34.0, -0.05, 0.0), (105.0, 34.0, -0.18, -3.0), (135.0, 34.0, 0.0, 0.0), (165.0, 34.0, 0.0, 3.0), (255.0, 34.0, -0.14, 3.0), (285.0, 34.0, -0.03, 6.0), (315.0, 34.0, -0.32, 4.0), (345.0, 34.0, -0.24, 4.0))
OWN, VIVID, MOST = (0.0, 0.0, 0.0, -0.247, -0.236, 0.0, 0.0, -0.229, -0.334, -0.193), 12.0, 0.45


def _lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image and l, a, b to nine digits, so that what lies on an image's own percentile does so on any machine."""
    lab = pixels(spark, sf_dir).select("image", *[c.alias(n) for n, c in zip("lab", C.linear_to_lab(*linear()), strict=True)])
    return _nine(lab)


_LAB9 = f"{LAB}, p AS (SELECT image, round(l, 9) AS l, round(a, 9) AS a, round(b, 9) AS b FROM lab)"


def _moved_sql(c: str, k: int) -> str:
    part = lambda sel, to: f"least(greatest({to[k]} - (avg({c}) FILTER (WHERE {sel}) - any_value(m{c})), {-MOVE}), {MOVE})"
    return f"{part('l <= p25', SHADOWS)} AS sh_{c}, {part('l >= p90', HIGHLIGHTS)} AS hi_{c}, {part('l >= p25 AND l <= p75', MIDDLE)} AS mid_{c}"


def _split_sql(of: str, to: str) -> str:
    """Tables that end with ``to``: the step of :func:`split` over the table ``of``; names in between start with ``to``."""
    q, d, w, m = (f"{to}_{n}" for n in "qdwm")
    return f"""{q} AS (SELECT image, round(quantile_cont(l, 0.10), 9) AS p10, round(quantile_cont(l, 0.25), 9) AS p25, round(quantile_cont(l, 0.75), 9) AS p75, round(quantile_cont(l, 0.90), 9) AS p90, median(a) AS ma, median(b) AS mb FROM {of} GROUP BY image),
{d} AS (SELECT image, {_moved_sql('a', 0)}, {_moved_sql('b', 1)} FROM {of} JOIN {q} USING (image) GROUP BY image),
{w} AS (SELECT {of}.*, {d}.* EXCLUDE (image), 1 - {_ramp_sql('l', 'p25', 'p25 + 0.75 * greatest(p75 - p25, 1.0)')} AS ws, {_ramp_sql('l', 'p75 - 0.75 * greatest(p75 - p25, 1.0)', 'p75')} AS wh, 1 - {_ramp_sql('l', 'p10', 'p10 + 0.25 * greatest(p75 - p25, 1.0)')} AS wd FROM {of} JOIN {q} USING (image) JOIN {d} USING (image)),
{m} AS (SELECT *, least(least(greatest(1 - ws - wh, 0.0), 1.0) / {WHOLE}, 1.0) AS wm FROM {w}),
{to} AS (SELECT image, l, {', '.join(f'{c} + sh_{c} * ws + hi_{c} * wh + {DEEPEST[k]} * wd + mid_{c} * wm AS {c}' for k, c in enumerate('ab'))} FROM {m})"""


def _six_sql(of: str) -> str:
    return f"SELECT image, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in 'lab')} FROM {of}"


def _six(lab: DataFrame) -> DataFrame:
    return lab.select("image", *[(F.round(c, 6) + 0.0).alias(c) for c in "lab"])


def split(lab: DataFrame) -> DataFrame:
    """Shadows, middle and highlights of each image taken to a style's colours, by soft weights and within a limit.

    Two aggregates, percentiles and the parts' means, are joined back as a row an image.
    """
    q = quantiles(lab, {f"p{n}": ("l", n / 100) for n in (10, 25, 75, 90)} | {f"m{c}": (c, 0.5) for c in "ab"})
    q = q.select("image", "ma", "mb", *[F.round(n, 9).alias(n) for n in ("p10", "p25", "p75", "p90")])
    parts = {"sh": (F.col("l") <= F.col("p25"), SHADOWS), "hi": (F.col("l") >= F.col("p90"), HIGHLIGHTS), "mid": ((F.col("l") >= F.col("p25")) & (F.col("l") <= F.col("p75")), MIDDLE)}
    lack = lambda sel, c, to: F.least(F.greatest(to - (F.avg(F.when(sel, F.col(c))) - F.first(f"m{c}")), F.lit(-MOVE)), F.lit(MOVE))
    d = lab.join(q, "image").groupBy("image").agg(*[F.first(n).alias(n) for n in ("p10", "p25", "p75")], *[lack(sel, c, to[k]).alias(f"{n}_{c}") for n, (sel, to) in parts.items() for k, c in enumerate("ab")])
    df = lab.join(d.withColumn("span", F.greatest(F.col("p75") - F.col("p25"), F.lit(1.0))), "image")
    ramp = lambda lo, hi: C.smoothstep(F.col("l"), lo, hi)
    p10, p25, p75, span = (F.col(c) for c in ("p10", "p25", "p75", "span"))
    df = df.withColumns({"ws": 1 - ramp(p25, p25 + 0.75 * span), "wh": ramp(p75 - 0.75 * span, p75), "wd": 1 - ramp(p10, p10 + 0.25 * span)})
    df = df.withColumn("wm", F.least(F.least(F.greatest(1 - F.col("ws") - F.col("wh"), F.lit(0.0)), F.lit(1.0)) / WHOLE, F.lit(1.0)))
    new = lambda k, c: (F.col(c) + F.col(f"sh_{c}") * F.col("ws") + F.col(f"hi_{c}") * F.col("wh") + DEEPEST[k] * F.col("wd") + F.col(f"mid_{c}") * F.col("wm")).alias(c)
    return df.select("image", "l", *[new(k, c) for k, c in enumerate("ab")])


@query(f"WITH {_LAB9}, {_split_sql('p', 'sp')} {_six_sql('sp')}")
def grade_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(split(_lab(spark, sf_dir)))


def _band_sql(centre: float, half: float) -> str:
    t = f"least(greatest(1 - ((CASE WHEN abs(h - {centre}) > 180 THEN 360 - abs(h - {centre}) ELSE abs(h - {centre}) END) - {half * 0.35!r}) / {half * 0.65!r}, 0.0), 1.0)"
    return f"({t} * {t} * (3 - 2 * {t}))"


def _mix_sql(of: str, to: str) -> str:
    """Tables that end with ``to``: the step of :func:`mix` over the table ``of``."""
    h, v, k, s, n, q, f = (f"{to}_{x}" for x in "hvksnqf")
    return f"""{h} AS (SELECT *, sqrt(a * a + b * b) AS c, {_hue_sql()} AS h FROM {of}), {v} AS (SELECT *, {_ramp_sql('c', repr(VIVID * 0.6), repr(VIVID * 1.4))} AS live FROM {h}),
{k} AS (SELECT *, live * ({' + '.join(f'{_band_sql(c, w)} * {k + o!r}' for (c, w, k, _), o in zip(BANDS, OWN, strict=True))}) AS k, live * ({' + '.join(f'{_band_sql(c, w)} * {d!r}' for c, w, _, d in BANDS)}) AS d FROM {v}),
{s} AS (SELECT *, CASE WHEN k > {MOST} THEN {MOST} / k ELSE 1.0 END AS s FROM {k}), {n} AS (SELECT *, c * greatest(1 + k * s, 0.0) AS now FROM {s}), {q} AS (SELECT image, median(c) AS m0, median(now) AS m1 FROM {n} GROUP BY image),
{f} AS (SELECT {n}.*, (CASE WHEN m1 > 1e-6 THEN m0 / m1 ELSE 1.0 END) * now / greatest(c, 1e-6) AS f FROM {n} JOIN {q} USING (image)),
{to} AS (SELECT image, least(greatest(l + least(greatest(d * s, -6.0), 8.0) * live, 0.0), 100.0) AS l, a * f AS a, b * f AS b FROM {f})"""


def mix(lab: DataFrame) -> DataFrame:
    """Chroma, and some lightness, by ten bands of hue; greys stay, gains are capped, the image's median chroma is kept."""
    df = lab.withColumns({"c": C.chroma(F.col("a"), F.col("b")), "h": C.hue_degrees(F.col("a"), F.col("b"))})
    df = df.withColumn("live", C.smoothstep(F.col("c"), VIVID * 0.6, VIVID * 1.4))
    weight = [C.hue_weight(F.col("h"), c, w) for c, w, _, _ in BANDS]
    df = df.withColumns({"k": F.col("live") * sum(w * (k + o) for w, (_, _, k, _), o in zip(weight, BANDS, OWN, strict=True)), "d": F.col("live") * sum(w * d for w, (_, _, _, d) in zip(weight, BANDS, strict=True))})
    df = df.withColumn("s", F.when(F.col("k") > MOST, MOST / F.col("k")).otherwise(1.0)).withColumn("now", F.col("c") * F.greatest(1 + F.col("k") * F.col("s"), F.lit(0.0)))
    q = quantiles(df, {"m0": ("c", 0.5), "m1": ("now", 0.5)})
    df = df.join(q, "image").withColumn("f", F.when(F.col("m1") > 1e-6, F.col("m0") / F.col("m1")).otherwise(1.0) * F.col("now") / F.greatest("c", F.lit(1e-6)))
    light = F.least(F.greatest(F.col("l") + F.least(F.greatest(F.col("d") * F.col("s"), F.lit(-6.0)), F.lit(8.0)) * F.col("live"), F.lit(0.0)), F.lit(100.0))
    return df.select("image", light.alias("l"), *[(F.col(c) * F.col("f")).alias(c) for c in "ab"])


@query(f"WITH {_LAB9}, {_mix_sql('p', 'mx')} {_six_sql('mx')}")
def grade_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(mix(_lab(spark, sf_dir)))


#: Lightness, chroma and hue that a style gives skin, the most that each is moved (in L*, as a share, in
#: degrees), the gain of contrast round skin's own median, and the weight from which on a pixel counts wholly.
SKIN, SKIN_MOVE, SKIN_CONTRAST, SKIN_WHOLE = (67.47, 22.81, 54.0), (12.0, 0.6, 50.0), 1.45, 0.70
#: Centre and half width of skin's window of hue, and the weight at its centre.
SKIN_HUE, SKIN_PEAK = (35.0, 26.0), 0.6


def _skin_sql(of: str, to: str) -> str:
    """Tables that end with ``to``: the step of :func:`skin` over the table ``of``."""
    h, w, q, d, t = (f"{to}_{n}" for n in "hwqdt")
    limited = lambda x, most: f"least(greatest({x}, {-most}), {most})"
    turn = f"({SKIN[2]} - degrees(atan2(sb, sa)) + 540.0)"
    return f"""{h} AS (SELECT *, sqrt(a * a + b * b) AS c, {_hue_sql()} AS h FROM {of}), {w} AS (SELECT *, round({_band_sql(*SKIN_HUE)} * {_ramp_sql('c', repr(VIVID * 0.6), repr(VIVID * 1.4))} * {SKIN_PEAK}, 9) AS w FROM {h}),
{q} AS (SELECT image, median(l) AS sl, median(c) AS sc, median(a) AS sa, median(b) AS sb FROM {w} WHERE w > 0.5 GROUP BY image),
{d} AS (SELECT image, sl, {limited(f'{SKIN[0]} - sl', SKIN_MOVE[0])} AS dl, {limited(f'{SKIN[1]} / greatest(sc, 1e-6) - 1', SKIN_MOVE[1])} AS dc, {limited(f'{turn} - 360 * floor({turn} / 360) - 180', SKIN_MOVE[2])} AS dh FROM {q}),
{t} AS (SELECT image, l, a, b, sl, dl, CASE WHEN sl IS NULL THEN 0.0 ELSE least(w / {SKIN_WHOLE}, 1.0) END AS n, coalesce(dc, 0.0) AS dc, radians(coalesce(dh, 0.0)) AS dh FROM {w} LEFT JOIN {d} USING (image)),
{to} AS (SELECT image, CASE WHEN sl IS NULL THEN l ELSE least(greatest(least(greatest(l + (l - sl) * {SKIN_CONTRAST - 1!r} * n, 0.0), 100.0) + dl * n, 0.0), 100.0) END AS l, (1 + dc * n) * (a * cos(dh * n) - b * sin(dh * n)) AS a, (1 + dc * n) * (a * sin(dh * n) + b * cos(dh * n)) AS b FROM {t})"""


def skin(lab: DataFrame) -> DataFrame:
    """Skin, by a soft window of hue and chroma, taken to a style's lightness, chroma and hue, each within its limit.

    Its medians are one aggregate, a row an image; images without a pixel in the window's middle stay as they are.
    """
    df = lab.withColumns({"c": C.chroma(F.col("a"), F.col("b")), "h": C.hue_degrees(F.col("a"), F.col("b"))})
    w = C.hue_weight(F.col("h"), *SKIN_HUE) * C.smoothstep(F.col("c"), VIVID * 0.6, VIVID * 1.4) * SKIN_PEAK
    df = df.withColumn("w", w).withColumn("w", C.rounded(F.col("w"), 9))
    # conditional aggregates: a filter would be pushed below the projections and carry all their expressions in one
    q = df.groupBy("image").agg(*[percentile(f"CASE WHEN w > 0.5 THEN {c} END", 0.5)[0].alias(f"s{c}") for c in "lcab"])
    limited = lambda x, k: F.least(F.greatest(x, F.lit(-SKIN_MOVE[k])), F.lit(SKIN_MOVE[k]))
    turn = F.pmod(SKIN[2] - F.degrees(F.atan2("sb", "sa")) + 540.0, F.lit(360.0)) - 180
    d = q.select("image", "sl", limited(SKIN[0] - F.col("sl"), 0).alias("dl"), limited(SKIN[1] / F.greatest("sc", F.lit(1e-6)) - 1, 1).alias("dc"), F.radians(limited(turn, 2)).alias("dh"))
    df = df.join(d, "image", "left").withColumn("n", F.when(F.col("sl").isNull(), 0.0).otherwise(F.least(F.col("w") / SKIN_WHOLE, F.lit(1.0))))
    light = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(100.0))
    df = df.withColumns({"k": 1 + F.coalesce("dc", F.lit(0.0)) * F.col("n"), "t": F.coalesce("dh", F.lit(0.0)) * F.col("n")})
    new = F.when(F.col("sl").isNull(), F.col("l")).otherwise(light(light(F.col("l") + (F.col("l") - F.col("sl")) * (SKIN_CONTRAST - 1) * F.col("n")) + F.col("dl") * F.col("n")))
    a, b, cos, sin = F.col("a"), F.col("b"), F.cos("t"), F.sin("t")
    return df.select("image", new.alias("l"), (F.col("k") * (a * cos - b * sin)).alias("a"), (F.col("k") * (a * sin + b * cos)).alias("b"))


@query(f"WITH {_LAB9}, {_skin_sql('p', 'sk')} {_six_sql('sk')}")
def grade_skin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(skin(_lab(spark, sf_dir)))


#: Rounds in which a colour that doesn't come back from the gamut loses chroma, what is left of it, and how far off it may be.
ROUNDS, LEFT, OFF = 5, 0.8, 0.5
UNIT = ("u_r", "u_g", "u_b")  # channels on the way; b is taken


def _unit_sql(l: str, a: str, b: str) -> str:  # noqa: E741
    """u_r, u_g and u_b of colours, cut to 0 to 1."""
    x, y, z = f"({f_inverse_sql(f'(({l} + 16) / 116 + {a} / 500)')} * {C.WHITE[0]!r})", f_inverse_sql(f"(({l} + 16) / 116)"), f"({f_inverse_sql(f'(({l} + 16) / 116 - {b} / 200)')} * {C.WHITE[2]!r})"
    return ", ".join(f"least(greatest({row_sql(row, x, y, z)}, 0.0), 1.0) AS u_{n}" for row, n in zip(C.XYZ_TO_RGB, RGB, strict=True))


def _gamut_sql(of: str, to: str) -> str:
    """Tables that end with ``to``: r, g, b of the table ``of``, brought into the gamut."""
    out, at = [], of
    for k in range(ROUNDS):
        u, f, n = f"{to}_u{k}", f"{to}_f{k}", f"{to}_n{k}"
        out.append(f"{u} AS (SELECT image, l, a, b, {_unit_sql('l', 'a', 'b')} FROM {at})")
        out.append(f"{f} AS (SELECT image, l, a, b, {', '.join(f_sql(f'({row_sql(row, *UNIT)} / {w!r})') + f' AS f{i}' for i, (row, w) in enumerate(zip(C.RGB_TO_XYZ, C.WHITE, strict=True)))} FROM {u})")
        out.append(f"{n} AS (SELECT image, l, {', '.join(f'{c} * CASE WHEN abs(500 * (f0 - f1) - a) > {OFF} OR abs(200 * (f1 - f2) - b) > {OFF} THEN {LEFT} ELSE 1.0 END AS {c}' for c in 'ab')} FROM {f})")
        at = n
    return ", ".join([*out, f"{to}_u AS (SELECT image, {_unit_sql('l', 'a', 'b')} FROM {at})", f"{to} AS (SELECT image, {', '.join(f'{srgb_sql(u)} AS {c}' for u, c in zip(UNIT, RGB, strict=True))} FROM {to}_u)"])


def into_gamut(lab: DataFrame) -> DataFrame:
    """image, r, g, b in 0 to 1: colours outside keep lightness and hue and lose chroma in rounds until they come back unchanged."""
    unit = lambda: dict(zip(UNIT, [F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) for c in C.lab_to_linear(*map(F.col, "lab"))], strict=True))
    df = lab
    for _ in range(ROUNDS):
        _, a, b = C.linear_to_lab(*map(F.col, UNIT))
        df = df.withColumns(unit()).withColumns({"a_": a, "b_": b})
        k = F.when((F.abs(F.col("a_") - F.col("a")) > OFF) | (F.abs(F.col("b_") - F.col("b")) > OFF), LEFT).otherwise(1.0)
        df = df.select("image", "l", *[(F.col(c) * k).alias(c) for c in "ab"])
    return df.withColumns(unit()).select("image", *[C.linear_to_srgb(F.col(c)).alias(n) for c, n in zip(UNIT, RGB, strict=True)])


def _nine_sql(of: str, to: str) -> str:
    return f"{to} AS (SELECT image, {', '.join(f'round({c}, 9) AS {c}' for c in 'lab')} FROM {of})"


def _nine(lab: DataFrame) -> DataFrame:
    return lab.select("image", *[C.rounded(F.col(c), 9).alias(c) for c in "lab"])


@query(f"WITH {_LAB9}, {_split_sql('p', 'sp')}, {_nine_sql('sp', 'sp9')}, {_mix_sql('sp9', 'mx')}, {_nine_sql('mx', 'mx9')}, {_skin_sql('mx9', 'sk')}, {_gamut_sql('sk', 'o')} SELECT image, {', '.join(f'round({c}, 5) + 0.0 AS {c}' for c in RGB)} FROM o")
def grade_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps of grading in their order, each measuring what the one before left: parts, bands of hue, skin, gamut.

    A step reads its input two or three times, to measure it and to map it, so what goes into each is written once.
    """
    out = _lab(spark, sf_dir)
    for step in (split, mix):
        out = _nine(step(written(out, "grading")))
    out = into_gamut(skin(written(out, "grading")))
    return out.select("image", *[C.rounded(F.col(c), 5).alias(c) for c in RGB])
