"""Queries that answer for the whole table, against brute force."""

import random

import pytest

from specula.plans import catalogue_queries, registry


def brute_best(rows):
    """p_partkey -> (best, exact, contains, score) over all pairs."""
    out = {}
    for key, name, brand in rows:
        for other, name2, brand2 in rows:
            if None in (key, name, brand, other, name2, brand2) or brand != brand2 or key == other:
                continue
            a, b = " ".join(name.lower().split()), " ".join(name2.lower().split())
            c, d = ("".join(x for x in y if x.isalnum()) for y in (a, b))
            s = (int(a == b and a != ""), int(bool(c) and c in d), len(set(a.split()) & set(b.split())))
            if s > (0, 0, 0):
                out[key] = max(out.get(key, ((-1,), 0)), (s, -other))
    return {k: (-minus, *s) for k, (s, minus) in out.items()}


def found(df):
    rows = df.collect()
    assert len({r["p_partkey"] for r in rows}) == len(rows)
    return {r["p_partkey"]: (r["best"], r["exact"], r["contains"], r["score"]) for r in rows}


def test_best_matches_of_every_part(spark, sf):
    got = found(registry.QUERIES["fuzzy_best_all"](spark, sf))
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name", "p_brand")
    assert got == brute_best([tuple(r) for r in part.collect()]) and max(got) > 40


@pytest.mark.parametrize("seed", [1, 2])
def test_best_matches_on_awkward_names(spark, seed):
    r = random.Random(seed)
    words = ["red", "Red", "rediron", "iron", "x-1", "x1", "--", "é"]
    rows = [(k, "  ".join(r.choices(words, k=r.randint(0, 4))), r.choice(["A", "B", None])) for k in r.choices(range(90), k=100)]
    rows += [(200, None, "A"), (None, "red", "A"), *((k, "hot name", "C") for k in range(300, 340)), (400, "alone", "D")]
    df = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string")
    assert found(catalogue_queries.best_matches(df)) == brute_best(rows)
    assert catalogue_queries.best_matches(df.where("false")).count() == 0
