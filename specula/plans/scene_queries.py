"""What an image's light is like, and white balance by rounds: selections that depend on earlier measures of the image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specula.functions import colour as C
from specula.functions import curves
from specula.plans.colour_queries import RGB, channels, f_sql, lin_sql, luma_sql, row_sql, srgb_sql
from specula.plans.frame_queries import _gate_sql
from specula.plans.registry import query
from specula.sources.shared import written, written_by
from specula.sources.tables import FULL, HEIGHT, PX, SPEC, WIDTH, full_frames, pixels, spectra, table

#: a* and b* that skin is taken to, the share of skin from which on it is, the most that a gain leaves 1,
#: deviations that are left alone, the rounds, how far a round goes, and the deviation that ends them.
SKIN_A, SKIN_B, COVER, CAP, DEAD, ROUNDS, STEP, ENOUGH = 16.3, 18.5, 0.008, 0.12, 3.0, 6, 0.45, 0.08
#: Pixels that a selection needs. Images of the given tables are small; 200 for photographs.
LEAST = 20


def _skin(h: Column, c: Column, light: Column) -> Column:
    up = C.smoothstep
    # as rounded to nine digits and above 0.5; rounding itself goes by decimals and is slow
    return up(h, 2, 14) * (1 - up(h, 46, 66)) * up(c, 5, 13) * (1 - up(c, 70, 95)) * up(light, 12, 22) * (1 - up(light, 86, 95)) >= 0.5000000005


def _measured(cells: DataFrame, least: int) -> DataFrame:
    """image, gains and what they lead to: how (skin or neutral), da and db, the medians' distance to skin's aim.

    ``cells`` has an image's different colours with how often they occur (n) and its gains; medians are weighted. What
    several columns need is a column of its own, and hues are measured only where a* and b* come near to skin's.
    """
    linear = [F.least(F.greatest(F.col(c) * F.col(f"g{c}"), F.lit(0.0)), F.lit(1.0)) for c in RGB]
    df = cells.withColumns({f"_lit_{c}": v for c, v in zip(RGB, linear, strict=True)})
    lit = [F.col(f"_lit_{c}") for c in RGB]
    df = df.withColumns({f"_f{k}": C.lab_curve(v / w) for k, v, w in zip("xyz", C.matrix(C.RGB_TO_XYZ, *lit), C.WHITE, strict=True)} | {f"_s{c}": C.linear_to_srgb(v) for c, v in zip(RGB, lit, strict=True)})
    x, y, z = (F.col(f"_f{k}") for k in "xyz")
    shown = [F.col(f"_s{c}") for c in RGB]
    df = df.withColumns({"_l": 116 * y - 16, "_u": 500 * (x - y), "_v": 200 * (y - z), "_y": C.luma(*shown), "_sat": C.saturation(*shown)})
    light, u, v = (F.col(c) for c in ("_l", "_u", "_v"))
    near = (light > 12) & (light < 95) & (v > 0.03 * u) & (v < 2.3 * u) & (u * u + v * v > 24.9)
    df = df.withColumns({"_near": near, "neutral": (F.col("_sat") < 0.2199999995) & (F.col("_y") >= 0.0500000005) & (F.col("_y") < 0.9499999995)})
    df = df.withColumns({n: F.when(F.col("_near") | F.col("neutral"), F.round(c, 9)) for n, c in (("_a", u), ("_b", v))})
    df = df.withColumn("_h", F.when(F.col("_near"), F.degrees(F.atan2("_b", "_a")))).withColumn("_c", C.chroma(F.col("_a"), F.col("_b")))
    df = df.withColumn("skin", F.when(F.col("_near"), _skin(F.col("_h"), F.col("_c"), F.col("_l"))).otherwise(False))
    median = lambda v, sel: F.expr(f"percentile(CASE WHEN {sel} THEN {v} END, 0.5, n)")
    count = lambda sel: F.sum(F.when(F.col(sel), F.col("n")).otherwise(0))
    got = df.groupBy("image").agg(*[F.first(f"g{c}").alias(f"g{c}") for c in RGB], F.sum("n").alias("all"), *[count(s).alias(f"n_{s}") for s in ("skin", "neutral")], *[median(f"_{v}", s).alias(f"{s}_{v}") for s in ("skin", "neutral") for v in "ab"])
    is_skin = F.col("n_skin") / F.col("all") >= COVER
    of = lambda v: F.when(is_skin & (F.col("n_skin") >= least), F.col(f"skin_{v}")).when(~is_skin & (F.col("n_neutral") >= least), F.col(f"neutral_{v}"))
    return got.select("image", *[f"g{c}" for c in RGB], is_skin.alias("skin"), (of("a") - SKIN_A).alias("da"), (of("b") - SKIN_B).alias("db"))


def white_balance(linear: DataFrame, least: int = 200) -> DataFrame:
    """image, gains (gr, gg, gb), how, and da, db after them, of images given as linear colours.

    Each round measures anew which pixels are skin and turns the gains by a part of what their median a* and b* lack. An
    image is read once: rounds go over its written histogram of different colours, which lies in buckets of images, so
    that rounds move no colours. Images without enough skin keep 1.
    """
    cells = written_by(linear.groupBy("image", *RGB).agg(F.count(F.lit(1)).alias("n")), "colours", "image")
    now = _measured(cells.withColumns({f"g{c}": F.lit(1.0) for c in RGB}), least)
    now = now.withColumn("how", F.when(F.col("da").isNull(), "none").when(F.col("skin"), "skin").otherwise("no target"))
    how = written(now.select("image", "how"), "balance-how")
    for _ in range(ROUNDS):
        dead = lambda d: F.when(F.abs(d) <= DEAD, 0.0).otherwise(F.col(d))
        da, db = dead("da"), dead("db")
        on = F.coalesce((F.greatest(F.abs(da), F.abs(db)) >= ENOUGH) & F.col("da").isNotNull(), F.lit(False)) & (F.col("how") == "skin")
        # red and green follow a*, blue follows b*
        turn = {"r": 1 - da * STEP * 0.02, "g": 1 + da * STEP * 0.01, "b": 1 + db * STEP * 0.02}
        gains = now.select("image", *[F.when(on, F.least(F.greatest(F.col(f"g{c}") * t, F.lit(1 - CAP)), F.lit(1 + CAP))).otherwise(F.col(f"g{c}")).alias(f"g{c}") for c, t in turn.items()])
        now = written(_measured(cells.join(gains.hint("shuffle_hash"), "image"), least), "balance").join(how, "image")
    return now.select("image", *[f"g{c}" for c in RGB], "how", "da", "db")


def _round_sql(k: int) -> str:
    g = {c: f"least(greatest({c} * g{c}, 0.0), 1.0)" for c in RGB}
    xyz = ", ".join(f"{f_sql(f'({row_sql(row, *(g[c] for c in RGB))} / {w!r})')} AS f{n}" for row, w, n in zip(C.RGB_TO_XYZ, C.WHITE, "xyz", strict=True))
    hue = "CASE WHEN degrees(atan2(b, a)) < 0 THEN degrees(atan2(b, a)) + 360 ELSE degrees(atan2(b, a)) END"
    skin = f"round({_gate_sql('h', 2, 14)} * (1 - {_gate_sql('h', 46, 66)}) * {_gate_sql('c', 5, 13)} * (1 - {_gate_sql('c', 70, 95)}) * {_gate_sql('l', 12, 22)} * (1 - {_gate_sql('l', 86, 95)}), 9) > 0.5"
    off = lambda d: f"(CASE WHEN abs({d}) <= {DEAD} THEN 0.0 ELSE {d} END)"
    turn = {"r": f"1 - {off('da')} * {STEP * 0.02!r}", "g": f"1 + {off('da')} * {STEP * 0.01!r}", "b": f"1 + {off('db')} * {STEP * 0.02!r}"}
    on = f"how = 'skin' AND da IS NOT NULL AND greatest(abs({off('da')}), abs({off('db')})) >= {ENOUGH}"
    gains = "SELECT image, 1.0::DOUBLE AS gr, 1.0::DOUBLE AS gg, 1.0::DOUBLE AS gb FROM (SELECT DISTINCT image FROM lin)" if k == 0 else f"SELECT image, {', '.join(f'CASE WHEN {on} THEN least(greatest(g{c} * ({t}), {1 - CAP!r}), {1 + CAP!r}) ELSE g{c} END AS g{c}' for c, t in turn.items())} FROM m{k - 1}"
    how = "CASE WHEN a IS NULL THEN 'none' WHEN skin THEN 'skin' ELSE 'no target' END" if k == 0 else "(SELECT how FROM m0 WHERE m0.image = t.image)"
    return f"""g{k} AS ({gains}), p{k} AS (SELECT lin.image, gr, gg, gb, {xyz}, {', '.join(f'{srgb_sql(g[c])} AS s{c}' for c in RGB)} FROM lin JOIN g{k} USING (image)),
q{k} AS (SELECT *, 116 * fy - 16 AS l, round(500 * (fx - fy), 9) AS a, round(200 * (fy - fz), 9) AS b FROM p{k}), h{k} AS (SELECT *, sqrt(a * a + b * b) AS c, {hue} AS h FROM q{k}),
s{k} AS (SELECT *, {skin} AS skin, round(CASE WHEN greatest(sr, sg, sb) > 0 THEN (greatest(sr, sg, sb) - least(sr, sg, sb)) / greatest(sr, sg, sb) ELSE 0.0 END, 9) < 0.22 AND round({luma_sql('sr', 'sg', 'sb')}, 9) > 0.05 AND round({luma_sql('sr', 'sg', 'sb')}, 9) < 0.95 AS neutral FROM h{k}),
c{k} AS (SELECT image, any_value(gr) AS gr, any_value(gg) AS gg, any_value(gb) AS gb, count(*) AS n, count(*) FILTER (WHERE skin) AS ns, count(*) FILTER (WHERE neutral) AS nn, quantile_cont(a, 0.5) FILTER (WHERE skin) AS sa, quantile_cont(b, 0.5) FILTER (WHERE skin) AS sb, quantile_cont(a, 0.5) FILTER (WHERE neutral) AS na, quantile_cont(b, 0.5) FILTER (WHERE neutral) AS nb FROM s{k} GROUP BY image),
t{k} AS (SELECT image, gr, gg, gb, ns / n >= {COVER} AS skin, CASE WHEN ns / n >= {COVER} THEN CASE WHEN ns >= {LEAST} THEN sa END WHEN nn >= {LEAST} THEN na END AS a, CASE WHEN ns / n >= {COVER} THEN CASE WHEN ns >= {LEAST} THEN sb END WHEN nn >= {LEAST} THEN nb END AS b FROM c{k}),
m{k} AS (SELECT image, gr, gg, gb, a - {SKIN_A} AS da, b - {SKIN_B} AS db, {how} AS how FROM t{k} t)"""


@query(f"WITH {PX}, lin AS MATERIALIZED (SELECT image, {', '.join(f'{lin_sql(c)} AS {c}' for c in RGB)} FROM px), {', '.join(_round_sql(k) for k in range(ROUNDS + 1))} SELECT image, round(gr, 6) AS gain_r, round(gg, 6) AS gain_g, round(gb, 6) AS gain_b, how, round(da, 5) AS da, round(db, 5) AS db FROM m{ROUNDS}")
def wb_iter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains that bring skin to its aim in damped rounds."""
    linear = pixels(spark, sf_dir).select("image", *[C.srgb_to_linear(v).alias(c) for c, v in zip(RGB, channels(), strict=True)])
    out = white_balance(linear, LEAST)
    return out.select("image", *[F.round(f"g{c}", 6).alias(f"gain_{c}") for c in RGB], "how", F.round("da", 5).alias("da"), F.round("db", 5).alias("db"))


#: From front, from behind, from behind at a side; the share of the brightest part that lies on the subject
#: and the lightness by which it exceeds the subject, and how far aside of the subject it may be and still be behind it.
FRONT, BEHIND, ASIDE = "顺平光", "正逆光", "侧逆光"
ON_SUBJECT, GAP, TOLERANCE = 0.15, 18.0, 0.18


def light_position(frames: DataFrame, height: int, width: int, least_subject: int = 800, least_ground: int = 500, least_bright: int = 50) -> DataFrame:
    """image, label and its measures from image, y, x, l (lightness), person and ground (masks) and clipped.

    The brightest twentieth of an image is compared with its subject: is it the subject, how much brighter is it, and how
    far aside. Two aggregates, the second over pixels with their image's percentile. Too small a part gives no label.
    """
    top = frames.groupBy("image").agg(F.expr("percentile(l, 0.95)").alias("top"))
    df = frames.join(top, "image").withColumns({"bright": F.col("l") >= F.col("top"), "sub": F.col("person") > 0.5, "back": F.col("ground") > 0.5})
    median = lambda v, sel: F.expr(f"percentile(CASE WHEN {sel} THEN {v} END, 0.5)")
    got = df.groupBy("image").agg(
        *[F.count_if(s).alias(f"n_{s}") for s in ("bright", "sub", "back")], F.count_if(F.expr("bright AND sub")).alias("both"), F.count_if("clipped").alias("n_clipped"), F.count_if(F.expr("clipped AND back")).alias("clipped_back"),
        median("l", "bright").alias("l_bright"), median("l", "sub").alias("l_sub"), median("l", "back").alias("l_back"), median("x", "bright").alias("x_bright"), median("y", "bright").alias("y_bright"), median("x", "sub").alias("x_sub"),
    )
    seen = (F.col("n_sub") >= least_subject) & (F.col("n_back") >= least_ground)
    enough = seen & (F.col("n_bright") >= least_bright)
    across, down = max(width - 1, 1), max(height - 1, 1)
    m = {
        "bg_sub": F.when(seen, F.col("l_back") - F.col("l_sub")),
        "hi_cy": F.when(enough, F.col("y_bright") / down),
        "hi_cx": F.when(enough, F.col("x_bright") / across),
        "hi_gap": F.when(enough, F.col("l_bright") - F.col("l_sub")),
        "hi_on_sub": F.when(enough, F.col("both") / F.col("n_bright")),
        "clip_bg_pct": F.when(enough & (F.col("n_clipped") > 0), 100 * F.col("clipped_back") / F.col("n_clipped")),
    }
    m = {c: F.round(v, 8) for c, v in m.items()}
    out = got.select("image", *[v.alias(c) for c, v in m.items()], "x_sub")
    aside = F.round(F.abs(F.col("hi_cx") - F.col("x_sub") / across), 8)
    label = F.when(F.col("hi_on_sub").isNull(), None).when((F.col("hi_on_sub") > ON_SUBJECT) | (F.col("hi_gap") < GAP), FRONT).when(aside <= TOLERANCE, BEHIND).otherwise(ASIDE)
    return out.select("image", label.alias("label"), *m)


#: Frames of the given tables have 217 pixels.
_LEAST = (15, 10, 5)
_MASKS = "masked AS (SELECT l_suppkey AS image, l_linenumber - 1 AS y, CAST(l_partkey % 31 AS INT) AS x, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS person FROM lineitem GROUP BY 1, 2, 3)"


@query(
    f"""WITH {FULL}, {_MASKS}, f AS (SELECT w.image, w.y, w.x, 100 * w.v AS l, coalesce(m.person, 0.0) AS person, w.v >= 0.8 AS clipped FROM whole w LEFT JOIN masked m ON m.image = w.image AND m.y = w.y AND m.x = w.x),
t AS (SELECT image, quantile_cont(l, 0.95) AS top FROM f GROUP BY image), b AS (SELECT f.*, l >= top AS bright, person > 0.5 AS sub, 1 - person > 0.5 AS back FROM f JOIN t USING (image)),
a AS (SELECT image, count(*) FILTER (WHERE bright) AS nb, count(*) FILTER (WHERE sub) AS ns, count(*) FILTER (WHERE back) AS ng, count(*) FILTER (WHERE bright AND sub) AS joint, count(*) FILTER (WHERE clipped) AS nc, count(*) FILTER (WHERE clipped AND back) AS cb,
median(l) FILTER (WHERE bright) AS lb, median(l) FILTER (WHERE sub) AS ls, median(l) FILTER (WHERE back) AS lg, median(x) FILTER (WHERE bright) AS xb, median(y) FILTER (WHERE bright) AS yb, median(x) FILTER (WHERE sub) AS xs FROM b GROUP BY image),
r AS (SELECT image, xs, ns >= {_LEAST[0]} AND ng >= {_LEAST[1]} AS seen, nb >= {_LEAST[2]} AS bright, * EXCLUDE (image, xs) FROM a),
m AS (SELECT image, xs, round(CASE WHEN seen THEN lg - ls END, 8) AS bg_sub, round(CASE WHEN seen AND bright THEN yb / {HEIGHT - 1} END, 8) AS hi_cy, round(CASE WHEN seen AND bright THEN xb / {WIDTH - 1} END, 8) AS hi_cx, round(CASE WHEN seen AND bright THEN lb - ls END, 8) AS hi_gap, round(CASE WHEN seen AND bright THEN joint / nb END, 8) AS hi_on_sub, round(CASE WHEN seen AND bright AND nc > 0 THEN 100 * cb / nc END, 8) AS clip_bg_pct FROM r)
SELECT image, CASE WHEN hi_on_sub IS NULL THEN NULL WHEN hi_on_sub > {ON_SUBJECT} OR hi_gap < {GAP} THEN '{FRONT}' WHEN round(abs(hi_cx - xs / {WIDTH - 1}), 8) <= {TOLERANCE} THEN '{BEHIND}' ELSE '{ASIDE}' END AS label, bg_sub, hi_cy, hi_cx, hi_gap, hi_on_sub, clip_bg_pct FROM m"""
)
def light_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the light comes from the front, from behind or from behind at a side."""
    person = F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("person")
    masks = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("image"), (F.col("l_linenumber") - 1).alias("y"), F.pmod("l_partkey", F.lit(WIDTH)).cast("int").alias("x")).agg(person)
    df = full_frames(spark, sf_dir).join(masks, ["image", "y", "x"], "left").withColumn("person", F.coalesce("person", F.lit(0.0)))
    return light_position(df.select("image", "y", "x", (100 * F.col("v")).alias("l"), "person", (1 - F.col("person")).alias("ground"), (F.col("v") >= 0.8).alias("clipped")), HEIGHT, WIDTH, *_LEAST)


#: Amplitudes, places and widths of a band pass; edges and widths of dichroic filters, in nanometres.
LOW, HIGH = (0.9, 410.0, 8.0), (1.0, 675.0, 15.0)
EDGES, WIDTHS = (516.0, 500.0, 610.0, 607.0), (12.0, 8.0, 8.0, 8.0)


@query(
    f"""WITH {SPEC}, wl AS (SELECT k, 380 + 5 * k AS wl FROM (SELECT unnest(range(0, 64)) AS k)),
edge AS (SELECT * FROM (VALUES ('uv', {LOW[1]}, {LOW[2]}), ('ir', {HIGH[1]}, {-HIGH[2]}), {', '.join(f"('e{k}', {e}, {w})" for k, (e, w) in enumerate(zip(EDGES, WIDTHS, strict=True)))}) t(name, place, width)),
x AS (SELECT wl, name, (wl - place) / width AS x FROM wl, edge),
i AS (SELECT wl, name, least(greatest(x, -6.0), 6.0) AS x FROM x),
e AS (SELECT wl, name, list_sum([(CASE WHEN n IN (0, 4000) THEN 1 WHEN n % 2 = 1 THEN 4 ELSE 2 END) * exp(-power(x * n / 4000, 2)) FOR n IN range(0, 4001)]) * x / 12000 / sqrt(pi()) + 0.5 AS s FROM i),
p AS (PIVOT e ON name IN ('uv', 'ir', 'e0', 'e1', 'e2', 'e3') USING max(s) GROUP BY wl),
t AS (SELECT wl, (1 - {LOW[0]} + {LOW[0]} * uv) * (1 - {HIGH[0]} + {HIGH[0]} * ir) AS pass, 1 - e3 AS c, CASE WHEN wl <= 550 THEN 1 - e1 ELSE e2 END AS m, e0 AS y FROM p),
b AS (SELECT name, family, unnest(bands) AS v, generate_subscripts(bands, 1) * 5 + 375 AS wl FROM spec)
SELECT name, any_value(family) AS family, {', '.join(f'round(sum(abs(v) * {c}) / sum(abs(v)), 6) AS {c}' for c in ('pass', 'c', 'm', 'y'))} FROM b JOIN t USING (wl) GROUP BY name"""
)
def erf_sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of each spectrum that a band pass and three dichroic filters with error-function edges let through.

    The filters are curves over 64 bands, a small table beside the spectra's bands.
    """
    at = spark.range(64).select(F.col("id").cast("int").alias("band"), (F.col("id") * 5 + 380).cast("double").alias("wl"))
    c, m, y = curves.dichroic(F.col("wl"), EDGES, WIDTHS)
    table_ = at.select("band", curves.band_pass(F.col("wl"), LOW, HIGH).alias("pass"), c.alias("c"), m.alias("m"), y.alias("y"))
    b = spectra(spark, sf_dir).select("name", "family", F.posexplode("bands").alias("band", "v")).join(F.broadcast(table_), "band")  # 64 rows
    share = lambda n: F.round(F.sum(F.abs("v") * F.col(n)) / F.sum(F.abs("v")), 6).alias(n)
    return b.groupBy("name").agg(F.first("family").alias("family"), *map(share, ("pass", "c", "m", "y")))
