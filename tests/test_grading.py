"""Skin's step and the way into the gamut, against plain loops over an image."""

import math
import random
import statistics

from pyspark.sql import functions as F

from specula.plans import stage_queries as s


def plain_skin(rows):
    def ramp(x, lo, hi):
        t = min(max((x - lo) / (hi - lo), 0), 1)
        return t * t * (3 - 2 * t)

    def weight(a, b):
        off = abs((math.degrees(math.atan2(b, a)) - 35 + 180) % 360 - 180)
        t = min(max(1 - (off - 26 * 0.35) / (26 * 0.65), 0), 1)
        return t * t * (3 - 2 * t) * ramp(math.hypot(a, b), 7.2, 16.8) * 0.6

    w = [weight(a, b) for _, a, b in rows]
    own = [x for x, k in zip(rows, w, strict=True) if k > 0.5]
    if not own:
        return rows
    ml, ma, mb = (statistics.median(x[k] for x in own) for k in range(3))
    cut = lambda x, most: min(max(x, -most), most)
    dl, dc = cut(67.47 - ml, 12), cut(22.81 / statistics.median(math.hypot(x[1], x[2]) for x in own) - 1, 0.6)
    dh = cut((54 - math.degrees(math.atan2(mb, ma)) + 180) % 360 - 180, 50)
    out = []
    for (l, a, b), k in zip(rows, w, strict=True):  # noqa: E741
        n = min(k / 0.7, 1)
        l = min(max(l + (l - ml) * 0.45 * n, 0), 100)  # noqa: E741
        t, m = math.radians(dh * n), 1 + dc * n
        out.append((min(max(l + dl * n, 0), 100), m * (a * math.cos(t) - b * math.sin(t)), m * (a * math.sin(t) + b * math.cos(t))))
    return out


def test_skin(spark):
    r = random.Random(4)
    skin = [(r.uniform(30, 70), r.uniform(10, 30), r.uniform(5, 20)) for _ in range(40)]
    cold = [(r.uniform(0, 100), r.uniform(-40, 0), r.uniform(-40, 0)) for _ in range(40)]
    images = {1: skin + cold, 2: cold, 3: [(98.0, 30.0, 21.0)], 4: [(5.0, 60.0, 42.0)] * 3}
    df = spark.createDataFrame([(k, *x) for k, rows in images.items() for x in rows], "image int, l double, a double, b double")
    got = {}
    for x in s.skin(df).collect():
        got.setdefault(x["image"], []).append((x["l"], x["a"], x["b"]))
    for k, rows in images.items():
        want = sorted(plain_skin(rows))
        assert all(abs(u - v) < 1e-6 for g, w in zip(sorted(got[k]), want, strict=True) for u, v in zip(g, w, strict=True)), k
    assert sorted(got[2]) == sorted(cold)
    assert s.skin(df.where("image > 9")).count() == 0


def test_into_gamut(spark):
    df = spark.createDataFrame([(1, 50.0, 0.0, 0.0), (2, 50.0, 20.0, 10.0), (3, 60.0, 120.0, -90.0), (4, 100.0, 60.0, 0.0), (5, 0.0, 0.0, 0.0)], "image int, l double, a double, b double")
    got = {x["image"]: (x["r"], x["g"], x["b"]) for x in s.into_gamut(df).collect()}
    assert all(0 <= c <= 1 for x in got.values() for c in x)
    assert max(got[1]) - min(got[1]) < 1e-3 and max(got[5]) < 1e-6
    assert got[2][0] > got[2][1]  # a colour inside stays itself
    r, g, b = got[3]
    assert r > g and b > g  # the hue of one outside stays


def test_rounded_and_quantiles_are_sparks_to_the_bit(spark):
    """Rounding makes no decimal number but near halves; quantiles sort an image's values and hold no map of them."""
    r = random.Random(8)
    odd = [0.0, -0.0, 5e-10, -5e-10, 1.0000000005, 2.5e-9, -1e-12, 1e3 + 5e-10, 123456.1234567895, 1e13, -3e300, float("inf"), float("nan"), None]
    xs = odd + [r.uniform(-200, 200) for _ in range(3000)] + [round(r.uniform(-9, 9), 9) + 5e-10 for _ in range(1000)]
    df = spark.createDataFrame([(k % 7, x) for k, x in enumerate(xs)], "image int, l double")
    for digits in (5, 9):
        got = df.select(F.hash(s.C.rounded(F.col("l"), digits)).alias("a"), F.hash(F.round("l", digits)).alias("b"), "l").where("a <> b").collect()
        assert not got, got[:3]
    some = df.where("not isnan(l) and abs(l) < 1e12").union(spark.createDataFrame([(8, 2.0), (9, 1.0), (9, 1.0), (9, 4.0)], df.schema))
    got = s.quantiles(some, {f"p{k}": ("l", k / 100) for k in (10, 50, 90)})
    want = some.groupBy("image").agg(*[F.expr(f"percentile(l, {k / 100})").alias(f"p{k}") for k in (10, 50, 90)])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "ObjectHashAggregate" not in got._jdf.queryExecution().executedPlan().toString()
