"""White balance by rounds, light position and error-function curves against plain computations."""

import math

import numpy as np
from pyspark.sql import functions as F

from specula.functions import colour, curves
from specula.plans import scene_queries as S


def to_linear(v):
    return np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)


def to_shown(v):
    return np.where(v <= 0.0031308, v * 12.92, 1.055 * np.maximum(v, 0.0031308) ** (1 / 2.4) - 0.055)


def lab(linear):
    x = linear @ np.array(colour.RGB_TO_XYZ).T / np.array(colour.WHITE)
    f = np.where(x > 216 / 24389, np.cbrt(x), (x * 24389 / 27 + 16) / 116)
    return 116 * f[:, 1] - 16, 500 * (f[:, 0] - f[:, 1]), 200 * (f[:, 1] - f[:, 2])


def step(x, low, high):
    t = np.clip((x - low) / (high - low), 0, 1)
    return t * t * (3 - 2 * t)


def plain_balance(image, least):
    gain = np.ones(3)

    def measured():
        seen = np.clip(image * gain, 0, 1)
        light, a, b = lab(seen)
        h, c = np.degrees(np.arctan2(b, a)) % 360, np.hypot(a, b)
        skin = step(h, 2, 14) * (1 - step(h, 46, 66)) * step(c, 5, 13) * (1 - step(c, 70, 95)) * step(light, 12, 22) * (1 - step(light, 86, 95)) > 0.5
        if skin.mean() >= 0.008:
            how, sel = "skin", skin
        else:
            d = to_shown(seen)
            y = d @ np.array(colour.LUMA)
            how, sel = "neutral", ((d.max(1) - d.min(1)) / np.maximum(d.max(1), 1e-12) < 0.22) & (y > 0.05) & (y < 0.95)
        return (None if sel.sum() < least else (np.median(a[sel]) - 16.3, np.median(b[sel]) - 18.5)), how

    now, how = measured()
    if now is None or how != "skin":
        return gain, "none" if now is None else "no target"
    for _ in range(6):
        now, _ = measured()
        if now is None:
            break
        da, db = (0.0 if abs(d) <= 3 else d for d in now)
        if max(abs(da), abs(db)) < 0.08:
            break
        gain = np.clip(gain * [1 - da * 0.009, 1 + da * 0.0045, 1 + db * 0.009], 0.88, 1.12)
    return gain, "skin"


def test_white_balance(spark):
    r = np.random.default_rng(1)
    images = {}
    for k in range(14):
        skin = np.array([[0.82, 0.56, 0.40], [0.70, 0.58, 0.50], [0.85, 0.55, 0.45], [0.66, 0.52, 0.38]][k % 7]) if k % 7 < 4 else np.array([0.5, 0.5, 0.5])
        shown = np.clip(skin + r.normal(0, 0.02, (120, 3)), 0, 1)
        images[k] = to_linear(np.concatenate([shown, r.random((60, 3))]) if k % 2 else shown)
    images[20] = to_linear(np.full((40, 3), 0.99))
    images[21] = to_linear(np.full((5, 3), [0.8, 0.55, 0.42]))
    rows = [(k, *map(float, p)) for k, x in images.items() for p in x]
    got = {x["image"]: x for x in S.white_balance(spark.createDataFrame(rows, "image int, r double, g double, b double"), 30).collect()}
    moved = 0
    for k, x in images.items():
        gain, how = plain_balance(x, 30)
        assert got[k]["how"] == how, k
        assert np.allclose([got[k][c] for c in ("gr", "gg", "gb")], gain, atol=1e-9), k
        moved += bool((gain != 1).any() and (np.abs(gain - 1) < 0.12).any())
    assert moved >= 3 and {x["how"] for x in got.values()} == {"skin", "none", "no target"}


def test_light_position(spark):
    r = np.random.default_rng(2)
    rows, want = [], {}
    for k in range(24):
        h, w = 12, 20
        light = r.integers(0, 40, (h, w)).astype(float)
        sub = np.zeros((h, w), bool)
        sub[4:12, 8:13] = k % 8 > 0
        at = [(0, 9), (0, 0), (5, 9)][k % 3]
        light[at[0] : at[0] + 4, at[1] : at[1] + 4] = 60 + 2 * k
        rows += [(k, y, x, float(light[y, x]), float(sub[y, x]), float(not sub[y, x]), bool(light[y, x] > 90)) for y in range(h) for x in range(w)]
        if sub.sum() < 20:
            want[k] = None
            continue
        hi = light >= np.percentile(light, 95)
        gap, on = np.median(light[hi]) - np.median(light[sub]), (hi & sub).sum() / hi.sum()
        aside = abs(np.median(np.nonzero(hi)[1]) - np.median(np.nonzero(sub)[1])) / (w - 1)
        want[k] = S.FRONT if on > 0.15 or gap < 18 else S.BEHIND if aside <= 0.18 else S.ASIDE
    df = spark.createDataFrame(rows, "image int, y int, x int, l double, person double, ground double, clipped boolean")
    got = {x["image"]: x["label"] for x in S.light_position(df, 12, 20, 20, 10, 5).collect()}
    assert got == want and set(want.values()) == {None, S.FRONT, S.BEHIND, S.ASIDE}


def test_error_function(spark):
    xs = [k / 37 for k in range(-260, 261)] + [1e-9, -1e-9, 30.0, -1e6, 0.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", curves.erf(F.col("x")).alias("y"), curves.erf_step(F.col("x"), 1.0, -2.0).alias("s")).collect()
    assert all(abs(r["y"] - math.erf(r["x"])) < 2e-12 and abs(r["s"] - (0.5 + 0.5 * math.erf((1 - r["x"]) / 2))) < 2e-12 for r in got)


def test_rounds_move_no_colours(spark, monkeypatch):
    """Rounds join and group colours where they lie: only gains, a row an image, are sent round."""
    plans, was = [], S.written
    monkeypatch.setattr(S, "written", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or was(df, name))
    rows = [(k % 9, 0.6 + k % 7 / 100, 0.3, 0.2 + k % 5 / 100) for k in range(900)]
    assert S.white_balance(spark.createDataFrame(rows, "image int, r double, g double, b double"), 20).count() == 9
    assert sum(name == "balance" for name, _ in plans) == S.ROUNDS
    for _, plan in plans:
        for part in plan.split("Exchange ")[1:]:
            assert "percentile" not in part and "colours" not in part.split("FileScan")[1]
