"""Measures of images and signals: exact percentiles, masked and weighted aggregates, histograms, metering.

Each is one grouped aggregate with partial combination; exact percentiles hold the counts of distinct values of a
group, not its rows. Where a measure is put back on rows the small aggregate is joined, not the rows shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from specula.functions import colour as C
from specula.plans.colour_queries import LAB, LIN, RGB, channels, f_sql, lin_sql, linear, luma_sql, row_sql
from specula.plans.registry import query
from specula.sources.tables import FRAME, HEIGHT, PX, SIG, WIDTH, frames, pixels, signal, table


def percentile(column: str, *points: float):
    return F.expr(f"percentile({column}, array({', '.join(map(str, points))}))")


@query(f"WITH {SIG} SELECT image, round(quantile_cont(x, 0.05), 8) AS p5, round(quantile_cont(x, 0.5), 8) AS p50, round(quantile_cont(x, 0.95), 8) AS p95 FROM sig GROUP BY image")
def pct_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = signal(spark, sf_dir).groupBy("image").agg(percentile("x", 0.05, 0.5, 0.95).alias("p"))
    return got.select("image", *(F.round(F.col("p")[k], 8).alias(n) for k, n in enumerate(("p5", "p50", "p95"))))


@query(f"WITH {SIG} SELECT image, round(max(x), 8) AS top, round(quantile_cont(x, 0.99), 8) AS p99, round(quantile_cont(x, 0.95), 8) AS p95, round(quantile_cont(x, 0.5), 8) AS p50, round(avg(x), 8) AS mean FROM sig GROUP BY image")
def summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = signal(spark, sf_dir).groupBy("image").agg(percentile("x", 0.99, 0.95, 0.5).alias("p"), F.max("x").alias("top"), F.avg("x").alias("mean"))
    return got.select("image", F.round("top", 8).alias("top"), *(F.round(F.col("p")[k], 8).alias(n) for k, n in enumerate(("p99", "p95", "p50"))), F.round("mean", 8).alias("mean"))


def _squeeze_sql(clip: str, pile: str) -> str:
    return f"round(CASE WHEN {clip} <= 1e-4 AND {pile} <= 0.03 THEN 1.0 ELSE greatest(0.0, 1 - {pile} / 0.03 * 0.6) END, 6)"


@query(
    f"""WITH {PX}, l AS (SELECT image, {luma_sql()} * 255 AS y FROM px), h AS (SELECT image, avg(CAST(y <= 3 AS INT)) AS le3, avg(CAST(y <= 10 AS INT)) AS le10, avg(CAST(y >= 252 AS INT)) AS ge252, avg(CAST(y >= 245 AS INT)) AS ge245 FROM l GROUP BY image)
SELECT image, {', '.join(f'round({c}, 8) AS {c}' for c in ('le3', 'le10', 'ge252', 'ge245'))}, {_squeeze_sql('le3', 'le10')} AS squeeze_lo, {_squeeze_sql('ge252', 'ge245')} AS squeeze_hi FROM h"""
)
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of pixels at and near either end, and how much that end may still be pressed."""
    y = C.luma(*channels()) * 255
    share = lambda test, name: F.avg(test.cast("int")).alias(name)
    h = pixels(spark, sf_dir).groupBy("image").agg(share(y <= 3, "le3"), share(y <= 10, "le10"), share(y >= 252, "ge252"), share(y >= 245, "ge245"))
    squeeze = lambda clip, pile: F.round(F.when((F.col(clip) <= 1e-4) & (F.col(pile) <= 0.03), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col(pile) / 0.03 * 0.6)), 6)
    return h.select("image", *(F.round(c, 8).alias(c) for c in ("le3", "le10", "ge252", "ge245")), squeeze("le3", "le10").alias("squeeze_lo"), squeeze("ge252", "ge245").alias("squeeze_hi"))


#: The share of an image that fills a bar, and the bars' power.
FULL_BAR, BAR_POWER = 0.07, 0.45


@query(
    f"""WITH {PX}, c AS (SELECT image, 'y' AS channel, CAST(floor({luma_sql()} * 255) AS INT) AS bin FROM px UNION ALL {' UNION ALL '.join(f"SELECT image, '{c}', CAST(round_even({c} * 255, 0) AS INT) FROM px" for c in RGB)}),
n AS (SELECT image, channel, bin, count(*) AS n FROM c GROUP BY 1, 2, 3), t AS (SELECT image, channel, sum(n) AS total, coalesce(sum(n) FILTER (WHERE bin = 0), 0) AS low, coalesce(sum(n) FILTER (WHERE bin = 255), 0) AS high FROM n GROUP BY 1, 2)
SELECT t.image, t.channel, CAST(g.bin AS INT) AS bin, round(power(least(coalesce(n.n, 0) / (total * {FULL_BAR}), 1.0), {BAR_POWER}), 6) AS height, round(low / total, 8) AS low, round(high / total, 8) AS high
FROM t CROSS JOIN (SELECT unnest(generate_series(0, 255)) AS bin) g LEFT JOIN n ON n.image = t.image AND n.channel = t.channel AND n.bin = g.bin"""
)
def histogram256(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of luma, red, green and blue, all 256 bins, and the shares of the first and last: filled from each channel's own counts."""
    r, g, b = channels()
    bins = F.array(F.struct(F.lit("y").alias("channel"), F.floor(C.luma(r, g, b) * 255).cast("int").alias("bin")), *(F.struct(F.lit(n).alias("channel"), C.to_byte(c).alias("bin")) for n, c in zip(RGB, (r, g, b), strict=True)))
    n = pixels(spark, sf_dir).select("image", F.explode(bins).alias("c")).groupBy("image", "c.channel", "c.bin").agg(F.count(F.lit(1)).alias("n"))
    counts = n.groupBy("image", "channel").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), F.sum("n").alias("total"))  # 256 entries at most
    of = lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0))
    rows = counts.select("image", "channel", "m", "total", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("bin"))
    height = F.pow(F.least(of(F.col("bin")) / (F.col("total") * FULL_BAR), F.lit(1.0)), F.lit(BAR_POWER))
    return rows.select("image", "channel", "bin", F.round(height, 6).alias("height"), F.round(of(F.lit(0)) / F.col("total"), 8).alias("low"), F.round(of(F.lit(255)) / F.col("total"), 8).alias("high"))


@query(f"WITH {LIN} SELECT image, round(log2(greatest(quantile_cont({luma_sql()}, 0.5), 1e-9) / 0.18), 8) AS ev FROM lin GROUP BY image")
def exposure_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = pixels(spark, sf_dir).select("image", C.luma(*linear()).alias("y"))
    return y.groupBy("image").agg(F.round(F.log2(F.greatest(F.expr("percentile(y, 0.5)"), F.lit(1e-9)) / 0.18), 8).alias("ev"))


@query(f"WITH {PX} SELECT image, round(100 * avg(CAST(greatest(r, g, b) >= 1 AS INT)), 8) AS pct, 100 * avg(CAST(greatest(r, g, b) >= 1 AS INT)) > 10 AS blown FROM px GROUP BY image")
def blown_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    pct = 100 * F.avg((F.greatest(*channels()) >= 1).cast("int"))
    return pixels(spark, sf_dir).groupBy("image").agg(F.round(pct, 8).alias("pct"), (pct > 10).alias("blown"))


@query(f"WITH {LAB} SELECT image, CASE WHEN count(*) FILTER (WHERE l > 50) >= 200 THEN round(quantile_cont(a, 0.5) FILTER (WHERE l > 50), 6) END AS a, CASE WHEN count(*) FILTER (WHERE l > 50) >= 200 THEN round(quantile_cont(b, 0.5) FILTER (WHERE l > 50), 6) END AS b FROM lab GROUP BY image")
def min_count_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of a selection; null where it has fewer than 200 pixels."""
    light, a, b = C.linear_to_lab(*linear())
    lab = pixels(spark, sf_dir).select("image", light.alias("l"), a.alias("a"), b.alias("b"))
    median = lambda c: F.when(F.count_if(F.col("l") > 50) >= 200, F.round(F.expr(f"percentile({c}, 0.5) FILTER (WHERE l > 50)"), 6)).alias(c)
    return lab.groupBy("image").agg(median("a"), median("b"))


@query(f"WITH {PX} SELECT image, round(exp(avg(ln(greatest(r, 1e-6)))), 8) AS r, round(exp(avg(ln(greatest(g, 1e-6)))), 8) AS g, round(1 / exp(avg(ln(greatest(b, 1e-6)))), 6) AS b_factor FROM px GROUP BY image")
def geo_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = lambda c: F.exp(F.avg(F.ln(F.greatest(F.col(c), F.lit(1e-6)))))
    return pixels(spark, sf_dir).groupBy("image").agg(F.round(mean("r"), 8).alias("r"), F.round(mean("g"), 8).alias("g"), F.round(1 / mean("b"), 6).alias("b_factor"))


def _gain_sql(c: str) -> str:
    m = "greatest(m{c}, 1e-6)"
    return f"CASE WHEN cover >= 0.02 THEN round(least(greatest((({m.format(c='r')} + {m.format(c='g')} + {m.format(c='b')}) / 3) / {m.format(c=c)}, 0.75), 1.25), 6) ELSE 1.0 END"


@query(
    f"""WITH {PX}, s AS (SELECT *, (CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0.0 END) < 0.22 AND {luma_sql()} > 0.05 AND {luma_sql()} < 0.95 AS sel FROM px),
m AS (SELECT image, {', '.join(f'avg({lin_sql(c)}) FILTER (WHERE sel) AS m{c}' for c in RGB)}, avg(CAST(sel AS INT)) AS cover FROM s GROUP BY image)
SELECT image, round(cover, 8) AS cover, {', '.join(f'{_gain_sql(c)} AS gain_{c}' for c in RGB)} FROM m"""
)
def grey_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains of at most a quarter that make the mean light of unsaturated middle greys grey; 1 where they are under a fiftieth."""
    r, g, b = channels()
    y = C.luma(r, g, b)
    df = pixels(spark, sf_dir).withColumn("sel", (C.saturation(r, g, b) < 0.22) & (y > 0.05) & (y < 0.95))
    means = df.groupBy("image").agg(*(F.avg(F.when(F.col("sel"), C.srgb_to_linear(F.col(c)))).alias(f"m{c}") for c in RGB), F.avg(F.col("sel").cast("int")).alias("cover"))
    m = {c: F.greatest(F.col(f"m{c}"), F.lit(1e-6)) for c in RGB}
    gain = lambda c: F.when(F.col("cover") >= 0.02, F.round(F.least(F.greatest(((m["r"] + m["g"] + m["b"]) / 3) / m[c], F.lit(0.75)), F.lit(1.25)), 6)).otherwise(1.0)
    return means.select("image", F.round("cover", 8).alias("cover"), *(gain(c).alias(f"gain_{c}") for c in RGB))


@query(f"WITH {PX} SELECT image, {', '.join(f'ceil(round(max({c}) * 1.05 * 10000, 6)) / 10000 AS top_{c}' for c in RGB)}, floor(round((min(r) - 0.1) * 10000, 6)) / 10000 AS low FROM px GROUP BY image")
def wire_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel maxima with a margin of 5 %, rounded outward to four digits."""
    top = lambda c: (F.ceil(F.round(F.max(c) * 1.05 * 10000, 6)) / 10000).alias(f"top_{c}")
    return pixels(spark, sf_dir).groupBy("image").agg(*map(top, RGB), (F.floor(F.round((F.min("r") - 0.1) * 10000, 6)) / 10000).alias("low"))


@query("WITH t AS (SELECT event_type AS stage, sum(value) AS spent FROM events GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY spent DESC, stage) AS rank FROM t) SELECT stage, round(100 * spent / sum(spent) OVER (), 6) AS pct, CAST(rank AS INT) AS rank, rank <= 3 AS flagged FROM p")
def pct_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each stage in the total, the three largest flagged. Windows run over the aggregate, a row a stage."""
    t = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage")).agg(F.sum("value").alias("spent"))
    rank = F.row_number().over(Window.orderBy(F.desc("spent"), "stage"))
    return t.select("stage", F.round(100 * F.col("spent") / F.sum("spent").over(Window.partitionBy()), 6).alias("pct"), rank.alias("rank"), (rank <= 3).alias("flagged"))


X, Y = f"(x / {WIDTH}.0 - 0.5)", f"((y / {HEIGHT}.0 - 0.5) * ({HEIGHT} / {WIDTH}.0))"
RADIUS = f"sqrt({X} * {X} + {Y} * {Y})"


def _ev(exposure) -> F:
    """The correction that brings a measured exposure to middle grey, in stops."""
    return F.round(F.when(exposure > 0, -F.log2(exposure / 0.184)).otherwise(0.0), 6).alias("ev")


def _ev_sql(exposure: str) -> str:
    return f"round(CASE WHEN {exposure} > 0 THEN -log2({exposure} / 0.184) ELSE 0.0 END, 6) AS ev"


def radial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with d, a pixel's distance from the middle, the long edge being 1. Geometry is known, so no window is needed."""
    x, y = F.col("x") / float(WIDTH) - 0.5, (F.col("y") / float(HEIGHT) - 0.5) * (HEIGHT / WIDTH)
    return frames(spark, sf_dir).withColumn("d", F.sqrt(x * x + y * y))


@query(f"WITH {SIG} SELECT image, round(-log2(greatest(avg(x), 1e-9) / 0.184), 6) AS ev FROM sig GROUP BY image")
def meter_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal(spark, sf_dir).groupBy("image").agg(F.round(-F.log2(F.greatest(F.avg("x"), F.lit(1e-9)) / 0.184), 6).alias("ev"))


@query(f"WITH {SIG} SELECT image, round(-log2(greatest(quantile_cont(x, 0.5), 1e-9) / 0.184), 6) AS ev FROM sig GROUP BY image")
def meter_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal(spark, sf_dir).groupBy("image").agg(F.round(-F.log2(F.greatest(F.expr("percentile(x, 0.5)"), F.lit(1e-9)) / 0.184), 6).alias("ev"))


@query(f"WITH {FRAME}, m AS (SELECT image, v, exp(-({X} * {X} + {Y} * {Y}) / 0.08) AS w FROM frame), e AS (SELECT image, sum(v * w) / sum(w) AS e FROM m GROUP BY image) SELECT image, {_ev_sql('e')} FROM e")
def meter_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights fall off from the middle as a Gaussian of 0.2 of the long edge."""
    w = F.exp(-F.col("d") * F.col("d") / (2 * 0.2 * 0.2))
    return radial(spark, sf_dir).groupBy("image").agg(_ev(F.sum(F.col("v") * w) / F.sum(w)))


@query(f"WITH {FRAME}, e AS (SELECT image, coalesce(avg(v) FILTER (WHERE {RADIUS} < 0.15), avg(v)) AS e FROM frame GROUP BY image) SELECT image, {_ev_sql('e')} FROM e")
def meter_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels within 0.15 of the long edge; all, where there are none."""
    return radial(spark, sf_dir).groupBy("image").agg(_ev(F.coalesce(F.avg(F.when(F.col("d") < 0.15, F.col("v"))), F.avg("v"))))


RINGS = ((0.0, 0.05, 0.5), (0.05, 0.25, 0.3), (0.25, 0.5, 0.2))


@query(
    f"""WITH {FRAME}, m AS (SELECT image, avg(v) AS a, {', '.join(f'avg(v) FILTER (WHERE {RADIUS} >= {lo} AND {RADIUS} < {hi}) AS m{k}' for k, (lo, hi, _) in enumerate(RINGS))} FROM frame GROUP BY image),
e AS (SELECT image, coalesce(({' + '.join(f'coalesce(m{k} * {w}, 0)' for k, (_, _, w) in enumerate(RINGS))}) / nullif({' + '.join(f'(CASE WHEN m{k} IS NULL THEN 0.0 ELSE {w} END)' for k, (_, _, w) in enumerate(RINGS))}, 0), a) AS e FROM m) SELECT image, {_ev_sql('e')} FROM e"""
)
def meter_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of three rings, weighted 0.5, 0.3 and 0.2; an empty ring drops out."""
    d = F.col("d")
    means = [F.avg(F.when((d >= lo) & (d < hi), F.col("v"))) for lo, hi, _ in RINGS]
    total = sum(F.coalesce(m * w, F.lit(0.0)) for m, (_, _, w) in zip(means, RINGS, strict=True))
    weight = sum(F.when(m.isNull(), 0.0).otherwise(w) for m, (_, _, w) in zip(means, RINGS, strict=True))
    return radial(spark, sf_dir).groupBy("image").agg(_ev(F.coalesce(F.try_divide(total, weight), F.avg("v"))))


@query(f"WITH {SIG} SELECT image, round(-log2(greatest(CASE WHEN sum(x * x) < 1e-12 THEN avg(x) ELSE sum(x * x * x) / nullif(sum(x * x), 0) END, 1e-9) / 0.184), 6) AS ev FROM sig GROUP BY image")
def meter_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return signal(spark, sf_dir).groupBy("image").agg(F.round(-F.log2(F.greatest(F.when(F.sum(x * x) < 1e-12, F.avg(x)).otherwise(F.try_divide(F.sum(x * x * x), F.sum(x * x))), F.lit(1e-9)) / 0.184), 6).alias("ev"))


@query(
    f"""WITH {FRAME}, z AS (SELECT image, y // {HEIGHT // 5} AS zy, x // {WIDTH // 5} AS zx, avg(v) AS m FROM frame WHERE y < {HEIGHT // 5 * 5} AND x < {WIDTH // 5 * 5} GROUP BY 1, 2, 3),
w AS (SELECT image, m, 0.5 * (1 + cos(pi() * sqrt(power((zx - 2) / 2.0, 2) + power((zy - 2) / 2.0, 2)) / sqrt(2.0))) AS w FROM z), e AS (SELECT image, sum(w * m) / sum(w) AS e FROM w GROUP BY image) SELECT image, {_ev_sql('e')} FROM e"""
)
def meter_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of 5 x 5 cells, weighted by a raised cosine of their distance from the middle one."""
    h, w = HEIGHT // 5, WIDTH // 5
    zy, zx = F.call_function("div", F.col("y"), F.lit(h)), F.call_function("div", F.col("x"), F.lit(w))
    cells = frames(spark, sf_dir).where((F.col("y") < 5 * h) & (F.col("x") < 5 * w)).groupBy("image", zy.alias("zy"), zx.alias("zx")).agg(F.avg("v").alias("m"))
    apart = F.sqrt(F.pow((F.col("zx") - 2) / 2.0, F.lit(2.0)) + F.pow((F.col("zy") - 2) / 2.0, F.lit(2.0))) / (2.0**0.5)
    weight = 0.5 * (1 + F.cos(apart * 3.141592653589793))
    return cells.groupBy("image").agg(_ev(F.sum(F.col("m") * weight) / F.sum(weight)))


def _ramp_sql(x: str, lo: str, hi: str) -> str:
    t = f"least(greatest(({x} - ({lo})) / nullif(({hi}) - ({lo}), 0), 0.0), 1.0)"
    return f"coalesce({t} * {t} * (3 - 2 * {t}), 0.0)"


@query(
    f"""WITH {LAB}, q AS (SELECT image, quantile_cont(l, 0.10) AS p10, quantile_cont(l, 0.25) AS p25, quantile_cont(l, 0.75) AS p75, greatest(quantile_cont(l, 0.75) - quantile_cont(l, 0.25), 1.0) AS span FROM lab GROUP BY image)
SELECT q.image, round(avg(1 - {_ramp_sql('l', 'p25', 'p25 + 0.75 * span')}), 6) AS shadow, round(avg({_ramp_sql('l', 'p75 - 0.75 * span', 'p75')}), 6) AS high, round(avg(1 - {_ramp_sql('l', 'p10', 'p10 + 0.25 * span')}), 6) AS deep FROM lab JOIN q USING (image) GROUP BY q.image"""
)
def soft_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean soft weights of shadows, highlights and the deepest shadows, anchored at each image's own percentiles."""
    lab = pixels(spark, sf_dir).select("image", C.linear_to_lab(*linear())[0].alias("l"))
    q = lab.groupBy("image").agg(percentile("l", 0.10, 0.25, 0.75).alias("p"))
    q = q.select("image", *(F.col("p")[k].alias(n) for k, n in enumerate(("p10", "p25", "p75"))), F.greatest(F.col("p")[2] - F.col("p")[1], F.lit(1.0)).alias("span"))
    p10, p25, p75, span = (F.col(c) for c in ("p10", "p25", "p75", "span"))
    ramp = lambda lo, hi: C.smoothstep(F.col("l"), lo, hi)
    mean = lambda w, name: F.round(F.avg(w), 6).alias(name)
    return lab.join(q, "image").groupBy("image").agg(mean(1 - ramp(p25, p25 + 0.75 * span), "shadow"), mean(ramp(p75 - 0.75 * span, p75), "high"), mean(1 - ramp(p10, p10 + 0.25 * span), "deep"))


@query(
    f"""WITH {LAB}, s AS (SELECT image, round(quantile_cont(l, 0.5), 8) AS l50, round(quantile_cont(l, 0.95) - quantile_cont(l, 0.05), 8) AS span, avg(CAST(l > 95 AS INT)) AS bright, avg(CAST(l < 5 AS INT)) AS dark FROM lab GROUP BY image)
SELECT image, CASE WHEN l50 >= 60 THEN 'high' WHEN l50 >= 35 THEN 'mid' ELSE 'low' END AS key_tone, CASE WHEN span >= 80 THEN 'hard' WHEN span >= 50 THEN 'normal' ELSE 'flat' END AS contrast,
concat_ws('|', CASE WHEN l50 >= 60 THEN 'high' WHEN l50 >= 35 THEN 'mid' ELSE 'low' END, CASE WHEN span >= 80 THEN 'hard' WHEN span >= 50 THEN 'normal' ELSE 'flat' END, CASE WHEN bright > 0.1 THEN 'blown' END, CASE WHEN dark > 0.1 THEN 'crushed' END) AS scene FROM s"""
)
def scene_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes of a scene from one grouped aggregate, and their composite key without the absent ones."""
    lab = pixels(spark, sf_dir).select("image", C.linear_to_lab(*linear())[0].alias("l"))
    s = lab.groupBy("image").agg(percentile("l", 0.5, 0.95, 0.05).alias("p"), F.avg((F.col("l") > 95).cast("int")).alias("bright"), F.avg((F.col("l") < 5).cast("int")).alias("dark"))
    mid, span = F.round(F.col("p")[0], 8), F.round(F.col("p")[1] - F.col("p")[2], 8)
    tone = F.when(mid >= 60, "high").when(mid >= 35, "mid").otherwise("low")
    contrast = F.when(span >= 80, "hard").when(span >= 50, "normal").otherwise("flat")
    return s.select("image", tone.alias("key_tone"), contrast.alias("contrast"), F.concat_ws("|", tone, contrast, F.when(F.col("bright") > 0.1, "blown"), F.when(F.col("dark") > 0.1, "crushed")).alias("scene"))


@query(
    f"""WITH {LAB}, h AS (SELECT image, sqrt(a * a + b * b) AS c, degrees(atan2(round(b, 9), round(a, 9))) AS h, degrees(atan2(round(b * 0.9 + 1, 9), round(a, 9))) AS h2 FROM lab), d AS (SELECT image, least(CAST(floor(c / 20) AS INT), 5) AS band, abs(h - h2) AS d FROM h)
SELECT image, band, round(max(CASE WHEN d > 180 THEN 360 - d ELSE d END), 5) AS turned FROM d GROUP BY image, band"""
)
def hue_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest turn of hue in each band of chroma between an image and a shifted copy; empty bands have no row."""
    _, a, b = C.linear_to_lab(*linear())
    lab = pixels(spark, sf_dir).select("image", a.alias("a"), b.alias("b"))
    angle = lambda y: F.degrees(F.atan2(F.round(y, 9), F.round("a", 9)))
    d = F.abs(angle(F.col("b")) - angle(F.col("b") * 0.9 + 1))
    band = F.least(F.floor(C.chroma(F.col("a"), F.col("b")) / 20), F.lit(5)).cast("int")
    return lab.groupBy("image", band.alias("band")).agg(F.round(F.max(F.when(d > 180, 360 - d).otherwise(d)), 5).alias("turned"))


#: The light of display value 254/255, above which a pixel counts as clipped.
CLIPPED = ((254 / 255 + 0.055) / 1.055) ** 2.4


@query(
    f"""WITH {LIN}, y AS (SELECT image, {luma_sql()} * 1.7 AS y FROM lin), o AS (SELECT image, y, row_number() OVER (PARTITION BY image ORDER BY y DESC) AS k, count(*) OVER (PARTITION BY image) AS n FROM y)
SELECT image, round(greatest(0.6, least(1.0, CASE WHEN max(y) > 0 THEN {CLIPPED!r} / max(y) ELSE 1.0 END)), 6) AS gain FROM o WHERE k > floor(n * 0.03) GROUP BY image"""
)
def clip_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest gain, 0.6 to 1, that leaves the luma of at most 3 % of pixels clipped: an order statistic instead of a search.

    The value at a rank comes from each image's counts of values, not from its sorted rows.
    """
    v = pixels(spark, sf_dir).select("image", (C.luma(*linear()) * 1.7).alias("m")).groupBy("image", "m").agg(F.count(F.lit(1)).alias("c"))
    down = Window.partitionBy("image").orderBy(F.desc("m"))
    ranked = v.withColumn("upto", F.sum("c").over(down)).withColumn("n", F.sum("c").over(Window.partitionBy("image")))
    edge = ranked.where(F.col("upto") > F.floor(F.col("n") * 0.03)).groupBy("image").agg(F.max("m").alias("m"))
    return edge.select("image", F.round(F.greatest(F.lit(0.6), F.least(F.lit(1.0), F.when(F.col("m") > 0, CLIPPED / F.col("m")).otherwise(1.0))), 6).alias("gain"))


#: What one style's images are measured against; only span and skin count.
TARGETS = {"span": 82.6, "skin_l": 67.47, "skin_c": 22.81, "skin_h": 54.0}
_H = "(CASE WHEN degrees(atan2(sb, sa)) < 0 THEN degrees(atan2(sb, sa)) + 360 ELSE degrees(atan2(sb, sa)) END)"


@query(
    f"""WITH {PX.replace('px AS (SELECT', "px AS (SELECT l_returnflag = 'R' AS face,")}, lin AS (SELECT face, image, r AS dr, g AS dg, b AS db, {', '.join(f'{lin_sql(c)} AS {c}' for c in RGB)} FROM px),
xyz AS (SELECT face, image, least(dr, dg, db) AS low, {', '.join(f"{row_sql(row, 'r', 'g', 'b')} / {w!r} AS {n}" for row, w, n in zip(C.RGB_TO_XYZ, C.WHITE, 'xyz', strict=True))} FROM lin), f AS (SELECT face, image, low, {', '.join(f'{f_sql(n)} AS {n}' for n in 'xyz')} FROM xyz),
lab AS (SELECT face, image, low, 116 * y - 16 AS l, 500 * (x - y) AS a, 200 * (y - z) AS b, sqrt(power(500 * (x - y), 2) + power(200 * (y - z), 2)) AS c FROM f),
q AS (SELECT image, quantile_cont(l, 0.5) AS l50, quantile_cont(l, 0.95) - quantile_cont(l, 0.05) AS span, quantile_cont(c, 0.5) AS c50, quantile_cont(c, 0.9) AS c90, quantile_cont(l, 0.25) AS p25, quantile_cont(l, 0.75) AS p75, quantile_cont(b, 0.5) AS b50,
100 * avg(CAST(low >= {254 / 255!r} AS INT)) AS clip, count(*) FILTER (WHERE face) AS skin_n, quantile_cont(l, 0.5) FILTER (WHERE face) AS sl, quantile_cont(c, 0.5) FILTER (WHERE face) AS sc, quantile_cont(a, 0.5) FILTER (WHERE face) AS sa, quantile_cont(b, 0.5) FILTER (WHERE face) AS sb FROM lab GROUP BY image),
m AS (SELECT q.image, avg(b - b50) AS mid_db FROM lab JOIN q USING (image) WHERE l >= p25 AND l <= p75 GROUP BY q.image)
SELECT image, round(l50, 6) AS l50, round(span, 6) AS span, round(c50, 6) AS c50, round(c90, 6) AS c90, round(mid_db, 5) AS mid_db, round(clip, 6) AS clip, skin_n,
round(abs(span - {TARGETS['span']}) + CASE WHEN skin_n > 200 THEN abs(sl - {TARGETS['skin_l']}) + abs(sc - {TARGETS['skin_c']}) + abs({_H} - {TARGETS['skin_h']}) ELSE 0.0 END, 5) AS score FROM q JOIN m USING (image)"""
)
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image's measures, and how far its span and, where it has skin enough, its skin are from their targets.

    The skin mask is a column here (rows returned), where an image tool would have a segmentation's.
    """
    light, a, b = C.linear_to_lab(*linear())
    face = (F.col("l_returnflag") == "R").alias("face")
    lab = pixels(spark, sf_dir, face).select("image", "face", F.least(*channels()).alias("low"), light.alias("l"), a.alias("a"), b.alias("b"), C.chroma(a, b).alias("c"))
    skin = lambda c: F.expr(f"percentile({c}, 0.5) FILTER (WHERE face)").alias(f"s{c}")
    q = lab.groupBy("image").agg(percentile("l", 0.5, 0.95, 0.05, 0.25, 0.75).alias("pl"), percentile("c", 0.5, 0.9).alias("pc"), percentile("b", 0.5).alias("pb"), (100 * F.avg((F.col("low") >= 254 / 255).cast("int"))).alias("clip"), F.count_if("face").alias("skin_n"), *map(skin, "lcab"))
    q = q.select("image", F.col("pl")[0].alias("l50"), (F.col("pl")[1] - F.col("pl")[2]).alias("span"), F.col("pl")[3].alias("p25"), F.col("pl")[4].alias("p75"), F.col("pc")[0].alias("c50"), F.col("pc")[1].alias("c90"), F.col("pb")[0].alias("b50"), "clip", "skin_n", "sl", "sc", "sa", "sb")
    mid = lab.select("image", "l", "b").join(q.select("image", "p25", "p75", "b50"), "image").where("l between p25 and p75").groupBy("image").agg(F.avg(F.col("b") - F.col("b50")).alias("mid_db"))
    off = lambda v, name: F.abs(v - TARGETS[name])
    skin_off = off(F.col("sl"), "skin_l") + off(F.col("sc"), "skin_c") + off(C.hue_degrees(F.col("sa"), F.col("sb")), "skin_h")
    score = off(F.col("span"), "span") + F.when(F.col("skin_n") > 200, skin_off).otherwise(0.0)
    return q.join(mid, "image").select("image", *(F.round(c, 6).alias(c) for c in ("l50", "span", "c50", "c90")), F.round("mid_db", 5).alias("mid_db"), F.round("clip", 6).alias("clip"), "skin_n", F.round(score, 5).alias("score"))
