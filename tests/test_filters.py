"""Signals in blocks, frames in tiles and tables of cubics against plain loops, at sizes where blocks and tiles end everywhere."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from specula.operators import frames, lookup_tables, ranges

LENGTHS = [1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 70]


def signals(spark, step=1, seed=0):
    r = np.random.default_rng(seed)
    sig = {k: r.random(n) for k, n in enumerate(LENGTHS)}
    rows = [(k, step * i - 5, float(v)) for k, x in sig.items() for i, v in enumerate(x)]
    random.Random(seed).shuffle(rows)
    return sig, spark.createDataFrame(rows, "image int, at bigint, x double").repartition(3)


def by_signal(df, value):
    out = {}
    for r in df.orderBy("image", "at").collect():
        out.setdefault(r["image"], []).append(r[value])
    return out


@pytest.mark.parametrize("step,chunk,fan", [(1, 4, 2), (5, 16, 3)])
def test_numbering(spark, monkeypatch, step, chunk, fan):
    monkeypatch.setattr(ranges, "CHUNK", chunk)
    monkeypatch.setattr(ranges, "FAN", fan)
    sig, df = signals(spark, step)
    df = df.union(spark.createDataFrame([(None, 1, 0.5), (3, None, 0.5)], df.schema))
    got = ranges.numbered(df, ["image"], "at")
    assert by_signal(got, "k") == {k: list(range(len(x))) for k, x in sig.items()}
    assert {r["image"]: r["n"] for r in got.select("image", "n").distinct().collect()} == {k: len(x) for k, x in sig.items()}


def mirrored(x, at):
    at %= 2 * len(x)
    return x[2 * len(x) - 1 - at] if at >= len(x) else x[at]


def test_halos_of_each_sample(spark):
    sig, df = signals(spark)
    numbered = ranges.numbered(df, ["image"], "at")
    for reach, size in ((2, 4), (9, 8)):
        made = ranges.blocks(numbered, ["image"], ["at", "x"], reach, size=size)
        assert made.agg(F.max(F.size("s"))).first()[0] <= size + 2 * reach
        value = {"y": lambda x, k, n: sum(x(d)["x"] * (d + 3) for d in range(-reach, reach + 1)), "end": lambda x, k, n: n - k}  # noqa: B023
        got = ranges.per_sample(made, ["image"], ["at"], value, size)
        want = {k: [sum(mirrored(x, i + d) * (d + 3) for d in range(-reach, reach + 1)) for i in range(len(x))] for k, x in sig.items()}
        y = by_signal(got, "y")
        assert all(np.allclose(y[k], want[k]) for k in want) and by_signal(got, "end") == {k: list(range(len(x), 0, -1)) for k, x in sig.items()}
        bare = ranges.per_sample(ranges.blocks(numbered, ["image"], ["at", "x"], reach, False, size), ["image"], ["at"], {"d": lambda x, k, n: x(1)["x"] - x(-1)["x"]}, size)
        assert all(d[0] is None and d[-1] is None and np.allclose(d[1:-1], sig[k][2:] - sig[k][:-2]) for k, d in by_signal(bare, "d").items())


def test_carried(spark, monkeypatch):
    monkeypatch.setattr(ranges, "FAN", 4)
    rows = [(k, i, (i * 7 + k) % 5) for k in (1, 2) for i in range(0, 41, k)]
    got = ranges.carried(spark.createDataFrame(rows, "s int, o bigint, v int").withColumn("m", F.col("v")), ["s"], "o", {"v": (F.sum, lambda a, b: a + b, 0), "m": (F.max, F.greatest, None)})
    want = {(k, i): (sum(v for s, j, v in rows if s == k and j < i), max((v for s, j, v in rows if s == k and j < i), default=None)) for k, i, _ in rows}
    assert {(r["s"], r["o"]): (r["v"], r["m"]) for r in got.collect()} == want


@pytest.mark.parametrize("sigma,size,fan", [(0.7, 4, 2), (12.0, 8, 3)])
def test_recursive_gaussian(spark, sigma, size, fan):
    sig, df = signals(spark, 3)
    gain, w = ranges.young_van_vliet(sigma)

    def sweep(x):
        out = [x[0]] * 3
        for v in x:
            out.append(gain * v + w[0] * out[-1] + w[1] * out[-2] + w[2] * out[-3])
        return out[3:]

    got = by_signal(ranges.recursive_gaussian(df, ["image"], "at", "x", "y", sigma, size=size, fan=fan), "y")
    for k, x in sig.items():
        assert np.allclose(got[k], sweep(sweep(x)[::-1])[::-1], atol=1e-9)
    assert ranges.recursive_gaussian(df.where("false"), ["image"], "at", "x", "y", sigma).count() == 0


def test_recursive_gaussian_is_nearly_one(spark):
    x = np.zeros(401)
    x[200] = 1.0
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "image int, at bigint, x double")
    got = by_signal(ranges.recursive_gaussian(df, ["image"], "at", "x", "y", 6.0, length=401), "y")[1]
    want = np.exp(-((np.arange(401) - 200) ** 2) / 72) / np.sqrt(72 * np.pi)
    assert abs(np.array(got) - want).max() < 2e-3 and abs(sum(got) - 1) < 1e-6


def frame(spark, h, w, seed=1):
    v = np.random.default_rng(seed).random((2, h, w))
    return v, spark.createDataFrame([(i, y, x, float(v[i, y, x])) for i in range(2) for y in range(h) for x in range(w)], "image int, y int, x int, v double").repartition(3)


def as_array(df, h, w, c="v"):
    out = np.full((2, h, w), np.nan)
    rows = df.collect()
    for r in rows:
        out[r["image"], r["y"], r["x"]] = r[c]
    assert len(rows) == out.size
    return out


@pytest.mark.parametrize("h,w,radius,size", [(7, 9, 2, 4), (3, 5, 7, 2), (1, 6, 2, 32), (20, 17, 3, 8)])
def test_filters_over_tiles(spark, h, w, radius, size):
    v, df = frame(spark, h, w)
    r = np.random.default_rng(2)
    kernels = [(0.25, list(r.random(2 * radius + 1))), (0.75, [0.0, *r.random(2 * radius - 1), 0.0])]
    made = frames.tiles(df, "image", "v", h, w, radius, size)
    got = as_array(frames.convolved(made, "image", kernels, h, w, {"v": lambda own, out: out + own}, size), h, w)
    at = lambda a, n: [min(k % (2 * n), 2 * n - 1 - k % (2 * n)) for k in range(a - radius, a + radius + 1)]
    want = np.array([[[sum(s * np.array(k) @ v[i][np.ix_(at(y, h), at(x, w))] @ np.array(k) for s, k in kernels) for x in range(w)] for y in range(h)] for i in range(2)]) + v
    assert np.allclose(got, want)


@pytest.mark.parametrize("h,w,longest", [(7, 31, 12), (5, 4, 40), (10, 7, 9)])
def test_area_downscale(spark, h, w, longest):
    v, df = frame(spark, h, w)
    s = min(longest / max(h, w), 1)
    nh, nw = (round(n * s) if s < 1 else n for n in (h, w))

    def shares(old, new):
        return np.array([[max(0, min((c + 1) * old / new, a + 1) - max(c * old / new, a)) for a in range(old)] for c in range(new)]) * new / old

    got = as_array(frames.area_downscale(df, "image", "v", h, w, longest), nh, nw)
    assert np.allclose(got, shares(h, nh) @ v @ shares(w, nw).T)
    assert np.allclose(got.mean((1, 2)), v.mean((1, 2)))


@pytest.mark.parametrize("h,w,sigma,truncate", [(5, 8, 0.7, 7.0), (6, 9, 1.5, 4.0), (1, 4, 1.0, 3.0)])
def test_fourier_gaussian(spark, h, w, sigma, truncate):
    v, df = frame(spark, h, w)
    pad = int(truncate * sigma + 0.5)
    got = as_array(frames.fourier_gaussian(df, "image", "v", h, w, sigma, truncate), h, w)
    for i in range(2):
        p = np.pad(v[i], [(pad, pad), (pad, pad)], "reflect" if h > 1 else "edge") if h > 1 else np.repeat(np.pad(v[i], [(0, 0), (pad, pad)], "reflect"), 2 * pad + 1, 0)
        f = np.add.outer(np.fft.fftfreq(p.shape[0]) ** 2, np.fft.fftfreq(p.shape[1]) ** 2)
        want = np.real(np.fft.ifft2(np.fft.fft2(p) * np.exp(-2 * np.pi**2 * sigma**2 * f)))[pad : pad + h, pad : pad + w]
        assert np.allclose(got[i], want)


def plain_slopes(v):
    n, d = len(v), [b - a for a, b in zip(v, v[1:], strict=False)]
    if n < 3:
        return [d[0] if d else 0.0] * n
    out = [0.0 if a * b <= 0 else 2 * a * b / (a + b) for a, b in zip(d, d[1:], strict=False)]

    def end(a, b):
        m = (3 * a - b) / 2
        return 0.0 if m * a <= 0 else 3 * a if a * b < 0 and abs(m) > abs(3 * a) else m

    return [end(d[0], d[1]), *out, end(d[-1], d[-2])]


@pytest.mark.parametrize("n", [2, 3, 5])
def test_monotone_cubic(spark, n):
    r = np.random.default_rng(n)
    cube = r.random((n, n, n))  # blue, green, red
    slopes = [np.apply_along_axis(plain_slopes, a, cube) for a in (2, 1, 0)]
    assert all(np.allclose(s, lookup_tables.limited_slopes(cube, a)) for s, a in zip(slopes, (2, 1, 0), strict=True))
    colours = [*map(tuple, r.uniform(-0.2, 1.2, (60, 3)).tolist()), (0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (0.5, 0.5, 1.0)]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(colours)], "k int, r double, g double, b double")
    got = {x["k"]: x["t_out"] for x in lookup_tables.monotone_cubic(df, n, {"t": cube.ravel().tolist()}).collect()}
    h = lambda a, b, p, q, t: a * (2 * t**3 - 3 * t**2 + 1) + p * (t**3 - 2 * t**2 + t) + b * (3 * t**2 - 2 * t**3) + q * (t**3 - t**2)
    for k, c in enumerate(colours):
        at = [min(max(x, 0.0), 1.0) * (n - 1) for x in c]
        i, j, m = (min(int(x), n - 2) for x in at)
        tr, tg, tb = (x - y for x, y in zip(at, (i, j, m), strict=True))
        sr, sg, sb = slopes
        face = []
        for z in (m, m + 1):
            row = [h(cube[z, y, i], cube[z, y, i + 1], sr[z, y, i], sr[z, y, i + 1], tr) for y in (j, j + 1)]
            s = [sg[z, y, i] * (1 - tr) + sg[z, y, i + 1] * tr for y in (j, j + 1)]
            t = [sb[z, y, i] * (1 - tr) + sb[z, y, i + 1] * tr for y in (j, j + 1)]
            face.append((h(row[0], row[1], s[0], s[1], tg), t[0] * (1 - tg) + t[1] * tg))
        cell = cube[m : m + 2, j : j + 2, i : i + 2]
        want = min(max(h(face[0][0], face[1][0], face[0][1], face[1][1], tb), cell.min()), cell.max())
        assert abs(got[k] - want) < 1e-12


def test_no_whole_signal_in_plans(spark, sf):
    from specula.plans import registry

    for name in ("gauss_fir_1d", "unsharp", "exp_mixture", "pchip_slopes", "second_derivative", "dynamic_range", "monotonicity", "running_max"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        gathered = [line for line in plan.splitlines() if "collect_list" in line]
        assert all("block" in line for line in gathered), name


def test_a_long_line_through_frequencies_in_bounded_time(spark):
    import time

    n, sigma, pad = 1000, 2.0, 14
    v = np.random.default_rng(4).random(n)
    df = spark.createDataFrame([(0, 0, k, float(x)) for k, x in enumerate(v)], "image int, y int, x int, v double")
    begin = time.time()
    got = {r["x"]: r["v"] for r in frames.fourier_gaussian(df, "image", "v", 1, n, sigma).collect()}
    took = time.time() - begin
    line = np.pad(v, pad, mode="reflect")
    response = np.exp(-2 * (np.pi * sigma * np.fft.rfftfreq(len(line))) ** 2)
    want = np.fft.irfft(np.fft.rfft(line) * response, len(line))[pad:-pad]
    assert np.allclose([got[k] for k in range(n)], want) and took < 60  # minutes if its transform is made anew for each pixel


def test_table_cubic_has_no_lambdas(spark, sf):
    from specula.plans.measure_queries import lut_cubic

    assert "lambda" not in lut_cubic(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
