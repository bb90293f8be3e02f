"""Column functions against plain Python, and the edges that the queries' tables lack."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from specula.functions import colour as C
from specula.operators import lookup_tables as L
from specula.operators import ranges
from specula.plans.measure_queries import cubic_weights, eigenvalues
from specula.plans.signal_queries import interpolated, kernel


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} double" for k in values))
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("x", [0.0, 0.04045, 0.04046, 0.5, 1.0])
def test_srgb_round_trip(spark, x):
    assert one(spark, C.linear_to_srgb(C.srgb_to_linear(F.col("x"))), x=x) == pytest.approx(x, abs=1e-7)


def test_lab_of_white_and_black(spark):
    for v, light in ((1.0, 100.0), (0.0, 0.0)):
        lab = [one(spark, c, r=v, g=v, b=v) for c in C.linear_to_lab(F.col("r"), F.col("g"), F.col("b"))]
        assert lab[0] == pytest.approx(light, abs=1e-4) and abs(lab[1]) < 0.02 and abs(lab[2]) < 0.02


def test_hue_is_between_0_and_360(spark):
    for a, b, h in ((1.0, 0.0, 0.0), (0.0, -1.0, 270.0), (-1.0, 0.0, 180.0)):
        assert one(spark, C.hue_degrees(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(h)


def test_black_stays_black(spark):
    assert one(spark, C.retone(F.col("r"), F.col("g"), F.col("b"), F.lit(0.5))[0], r=0.0, g=0.0, b=0.0) == 0.0


def test_interpolation_on_knots_and_beyond(spark):
    knots = [(0.0, 1.0), (1.0, 3.0), (2.0, 2.0)]
    for x, y in ((-5.0, 1.0), (0.0, 1.0), (0.5, 2.0), (1.0, 3.0), (2.0, 2.0), (9.0, 2.0)):
        assert one(spark, interpolated(F.col("x"), knots), x=x) == pytest.approx(y)


@pytest.mark.parametrize("n", [1, 2, 3, 10])
def test_filter_reflects_at_ends(spark, n):
    w, x = kernel(1.4), [math.sin(k) for k in range(n)]
    r = len(w) // 2
    at = lambda k: x[(k if (k := k % (2 * n)) < n else 2 * n - 1 - k)]
    want = [sum(w[d + r] * at(k + d) for d in range(-r, r + 1)) for k in range(n)]
    df = spark.createDataFrame([("i", k, v) for k, v in enumerate(x)], "image string, id long, x double")
    made = ranges.blocks(ranges.numbered(df, ["image"], "id"), ["image"], ["id", "x"], r)
    y = lambda v, k, n: sum(v(d)["x"] * w[d + r] for d in range(-r, r + 1))
    got = [row["y"] for row in ranges.per_sample(made, ["image"], ["id"], {"y": y}).orderBy("id").collect()]
    assert got == pytest.approx(want, abs=1e-7)


def test_cubic_weights(spark):
    for t in (0.0, 0.3, 1.0):
        w = [one(spark, c, t=t) for c in cubic_weights(F.col("t"))]
        assert sum(w) == pytest.approx(1) and sum(k * v for k, v in enumerate(w)) == pytest.approx(1 + t)


def test_eigenvalues(spark):
    for m in ([[2.0, 0.5, 0.1], [0.5, 1.0, 0.2], [0.1, 0.2, 3.0]], [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]):
        cells = [m[0][0], m[1][1], m[2][2], m[0][1], m[0][2], m[1][2]]
        want = np.linalg.eigvalsh(np.array(m))
        assert [one(spark, c, x=0.0) for c in eigenvalues(*map(F.lit, cells))] == pytest.approx([want[-1], want[0]])


def test_identity_table(spark):
    tables = L.baked(5, lambda r, g, b: (r, g, b))
    for rgb in ((0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (0.3, 0.77, 0.5), (0.25, 0.25, 0.9)):
        df = spark.createDataFrame([rgb], "r double, g double, b double")
        for row in (
            df.select(*(L.trilinear(t, 5, F.col("r"), F.col("g"), F.col("b")).alias(f"c{k}") for k, t in enumerate(tables))).first(),
            L.with_tetrahedra(df, 5).select(*(L.tetrahedral(t).alias(f"c{k}") for k, t in enumerate(tables))).first(),
        ):
            assert list(row) == pytest.approx(rgb)
