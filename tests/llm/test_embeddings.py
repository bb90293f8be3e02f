"""Near-duplicate embeddings against all pairs."""

import numpy as np
import pytest
from conftest import same_rows

from specula.llm import embedding_dedup, queries


def test_registered(spark, sf, duck):
    same_rows(queries.QUERIES["op11_embedding_dedup"](spark, sf), duck.execute(queries.ORACLE_SQL["op11_embedding_dedup"]).df())


def test_rotation_keeps_distances_and_rows_apart():
    x = np.random.default_rng(1).normal(size=(40, 21))
    r = embedding_dedup.rotated(x)
    assert np.allclose(x @ x.T, r @ r.T)
    assert (embedding_dedup.rotated(x[7:9]) == r[7:9]).all()


def rows_of(seed, n=260, dims=24):
    """Clusters of near copies at all distances around the threshold, copies, and rows that can't link."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dims))
    for k in range(n // 3, n):  # a third stands alone, the others hang on an earlier one
        other = x[r.integers(0, k)] if k % 2 else x[0]
        x[k] = (other + r.normal(size=dims) * np.linalg.norm(other) / np.sqrt(dims) * r.choice([0.0, 0.02, 0.1, 0.18, 0.2, 0.22])) * r.choice([1.0, 3.0])
    rows = [(int(k), [float(v) for v in x[k]], int(r.choice([1, 1, 1, 2])) if k % 9 else None) for k in range(n)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * dims, [nan] * dims, [inf] + [1.0] * (dims - 1), [None] + [1.0] * (dims - 1), [1.0], [2.0], [-1.0], [1.0, 1.0, 0.1]]
    rows += [(1000 + k, v, 1) for k, v in enumerate(odd)]
    return rows + rows[:40:4] + [(None, rows[0][1], rows[0][2]), (None, rows[1][1], rows[1][2]), (None, [5.0, 6.0], 1)] + [(5000 + k, rows[3][1], rows[3][2]) for k in range(30)]


def brute(rows, threshold):
    n, good = len(rows), [v is not None and all(z is not None and np.isfinite(z) for z in v) and any(v) and lab is not None for _, v, lab in rows]
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and good[i] and good[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                link[i, j] = a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold
    part = np.arange(n)
    while (new := np.where(link, part[None], part[:, None]).min(1)).tolist() != part.tolist():
        part = np.minimum(new, new[new])
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if part[j] == part[i] and rows[j][0] is not None]
        out.append((rows[i][0], int(link[i].sum()), min(ids) if ids else None, rows[i][0] == (min(ids) if ids else None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("kind,target,heavy", [("double", 3, 8192), ("float", 20, 16)])
def test_all_pairs(spark, kind, target, heavy):
    rows = rows_of(target)
    if kind == "float":
        rows = [(k, None if v is None else [None if z is None else float(np.float32(z)) for z in v], lab) for k, v, lab in rows]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], f"vec_id bigint, embedding array<{kind}>, label int, n int, node string").repartition(3)
    got = sorted((tuple(r) for r in embedding_dedup.near_duplicates(df, 0.98, target, heavy).collect()), key=str)
    assert got == brute(rows, 0.98) and sum(r[1] > 0 for r in got) > 100
    assert embedding_dedup.near_duplicates(df.where("false"), 0.98).count() == 0


def test_neighbours_of_vectors_of_every_length(spark):
    from pyspark.sql import functions as F

    from specula.llm import neighbours

    r = np.random.default_rng(3)
    rows = [(k, r.normal(size=(8, 16, 3)[k % 3 if k % 7 else 0]).tolist()) for k in range(150)] + [(500, [1.0]), (501, None), (510, [0.0] * 8), (520, [2.0])]
    got = {}
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for x in neighbours.neighbours(df, F.col("vec_id") % 10 == 0, 4).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append(x["vec_id"])
    vec = {k: np.array(v) for k, v in rows if v and any(v)}
    hits = total = 0
    for q in (k for k in vec if k % 10 == 0):
        near = sorted((-(vec[q] @ v) / np.linalg.norm(vec[q]) / np.linalg.norm(v), k) for k, v in vec.items() if k != q and len(v) == len(vec[q]))[:4]
        assert len(got.get(q, [])) == len(near)
        hits, total = hits + len({k for _, k in near} & set(got.get(q, []))), total + len(near)
    assert hits >= 0.9 * total and got[500] == [520] and 510 not in got


@pytest.mark.parametrize("kind", ["apart", "sparse"])
def test_recall_where_queries_lie_elsewhere_than_rows(spark, kind):
    from pyspark.sql import functions as F

    from specula.llm import neighbours

    r = np.random.default_rng(8)
    n, d = 8000, 64
    if kind == "apart":  # rows in clusters, queries in none
        x = r.normal(size=(400, d))[r.integers(0, 400, n)] + 0.1 * r.normal(size=(n, d))
        x[::50] = r.normal(size=(n // 50, d))
    else:
        x = np.where(r.random((n, d)) < 0.05, r.random((n, d)), 0.0)
        x[~x.any(1), 0] = 1.0
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = neighbours.neighbours(df, F.col("vec_id") % 50 == 0).collect()
    s = neighbours.unit(x[::50]) @ neighbours.unit(x).T
    s[np.arange(n // 50), np.arange(0, n, 50)] = -2
    fifth = np.sort(s, axis=1)[:, -5]  # rows of one direction are equally near
    assert len(got) == n // 50 * 5 and np.mean([row["score"] > fifth[row["query_id"] // 50] - 1e-9 for row in got]) >= 0.9
