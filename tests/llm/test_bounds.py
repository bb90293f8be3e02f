"""Bounds in bytes of what is remembered, rows repeated whole, and plain versions of trees and machines."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from specula.llm import bpe_codec, language_id, pretokens, secrets, sharding


def test_long_pieces_are_not_kept():
    seen = []
    m = pretokens.PieceMap(lambda w: seen.append(w) or w, b"".join)
    long = [",".join(str(k * n) for n in range(2000)) for k in range(1, 5)]
    text = " ".join([*long, "short", *long, "short"])
    assert m.of(text) == text.encode() and set(m.young) == {"short"}
    assert max(map(len, m.words), default=0) <= pretokens.LONGEST


def test_blocks_go_by_bytes():
    texts = ["a" * n for n in (10, 3_000_000, 3_000_000, 9_000_000, 5, 5)] + [None]
    batch = pa.RecordBatch.from_pydict({"t": pa.array(texts)})
    got = list(bpe_codec.blocks([batch], 4, most_bytes=4 << 20))
    assert [t for b in got for t in b.column(0).to_pylist()] == texts
    assert all(b.num_rows == 1 or b.nbytes <= 4 << 20 for b in got) and max(b.num_rows for b in got) > 1


def plain_features(text):
    low = f"\0{text.lower()}\0"
    at = [ord(c) if c.isalpha() else 32 for c in low]
    grams = [(7 * 0, (c * 0x9E3779B1,)) for c in at if c != 32]
    grams += [(7, (a * 0x9E3779B1, b * 0x85EBCA77)) for a, b in zip(at, at[1:], strict=False) if (a, b) != (32, 32)]
    grams += [(13, (a * 0x9E3779B1, b * 0x85EBCA77, c * 0xC2B2AE3D)) for a, b, c in zip(at, at[1:], at[2:], strict=False) if b != 32]
    hashed = [(sum(parts) + more) % 2**32 for more, parts in grams]
    found = collections.Counter((h ^ (h >> 15)) % language_id.PLACES for h in hashed)
    return np.array([found[k] for k in range(language_id.PLACES)])


@pytest.mark.parametrize("size", [1, 2, 5, 1 << 18])
def test_features_in_slices(size, monkeypatch):
    monkeypatch.setattr(language_id, "SLICE", size)
    for text in ["", "a", "7", "ab c", "Die Stra\u00dfe, 12 H\u00e4user!", "  \u4f60\u597d world ", "x" * 11]:
        assert (language_id.features(text) == plain_features(text)).all(), text


def test_machines_vote_as_a_plain_loop_says(spark):
    r = random.Random(5)
    codes = ["en", "de", "fr", "es", *(f"ru-{k}" for k in range(19))]
    words = {c: ["".join(r.choices("abcdefghijklmnop", k=5)) for _ in range(6)] for c in codes}
    rows = [(k, " ".join(r.choices(words[c], k=9)), c) for k, c in enumerate(codes * 6)]
    df = spark.createDataFrame([*rows, (999, "12 34", None), (1000, None, None), (1001, "no such words", None)], "doc_id long, text string, lang string")
    model = language_id.fit(df)
    assert not any(m[0] == "one" for m in model.machines) and max(map(len, model.cuts)) == 19
    columns = {m[:-1]: (model.weights[:, k], model.bias[k], m[-1]) for k, m in enumerate(model.machines)}

    def plain(text):
        x = plain_features(text)
        if not x.sum():
            return "und"
        says = lambda key: columns[key][0] @ x / x.sum() + columns[key][1]
        family = max(model.families, key=lambda f: (columns[("family", f)][2] * says(("family", f)), f))
        left = tuple(model.families[family])
        while len(left) > language_id.CLOSE:
            left = model.cuts[left][0 if says(("cut", left)) > 0 else 1]
        votes = collections.Counter()
        for i, a in enumerate(left):
            for b in left[i + 1 :]:
                votes[a if says(("pair", a, b)) > 0 else b] += 1
        most = max(votes.values(), default=0)
        return {c for c in left if votes[c] == most}

    got = language_id.predict(df, model).collect()
    for x in got:
        assert x["lang_pred"] in plain(x["text"] or "")
    assert sum(x["lang"] == x["lang_pred"] for x in got) >= 0.95 * len(rows)


def plain_tree(rows, dims, shards):
    """Shards of rows (dicts) by sorting: the median of the widest dimension's keys, at the nearer side of the goal."""
    out = {}

    def cut(part, first, k):
        if k == 1 or not part:
            out.update((x["at"], first) for x in part)
            return
        dim = max(dims, key=lambda d: (max(x[d] for x in part) - min(x[d] for x in part), -dims.index(d)))
        by_key = collections.Counter()
        for x in part:
            by_key[x[dim]] += x["size"]
        goal, below = sum(by_key.values()) * (k // 2) / k, 0
        for key in sorted(by_key):
            if below + by_key[key] >= goal:
                break
            below += by_key[key]
        last = key if below + by_key[key] - goal <= goal - below else key - 1
        cut([x for x in part if x[dim] <= last], first, k // 2)
        cut([x for x in part if x[dim] > last], first + k // 2, k - k // 2)

    cut(rows, 0, shards)
    return out


@pytest.mark.parametrize("shards", [3, 8])
def test_shards_of_repeated_rows_are_the_plain_tree_s(spark, shards):
    r = random.Random(3)
    rows = [(7, "the same text of one row, many times", "en")] * 700 + [(None, None, None)] * 40 + [(None, "", "en")] * 3
    rows += [(k, "w " * r.randrange(60) + "x" * r.randrange(9), r.choice(["de", "fr", None])) for k in range(60)]
    dims = ["length", "language", "word_length"]
    df = sharding.scaled(sharding.metadata(spark.createDataFrame(rows, "doc_id long, text string, lang string")), dims).cache()
    keyed = [x.asDict() | {"at": (x["doc_id"], x["copy"], x["text_crc32"], x["language"])} for x in df.withColumns({d: sharding.ordering_key(F.col(d), F.col("tie")) for d in dims}).withColumn("language", F.col("language")).collect()]
    assert len(keyed) == len(rows)
    want = plain_tree(keyed, dims, shards)
    placed = sharding.assign(df.withColumn("key_of", sharding.ordering_key(F.col("language"), F.col("tie"))), dims, "size", "tie", shards)
    got = placed.collect()
    assert {(x["doc_id"], x["copy"], x["text_crc32"], x["key_of"]): x["shard"] for x in got} == want
    total = collections.Counter()
    for x in got:
        total[x["shard"]] += x["size"]
    assert max(total.values()) - min(total[k] for k in range(shards)) <= 4 * max(x["size"] for x in got)
    slots = sharding.slots(placed.select("doc_id", "copy", "text_crc32", "shard"), "shard", ["text_crc32", "doc_id", "copy"], 100).collect()
    for k in range(shards):
        assert sorted(x["slot"] for x in slots if x["shard"] == k) == list(range(sum(x["shard"] == k for x in got)))


def test_repeats_are_numbered_in_runs(spark):
    df = spark.createDataFrame([(1, 5)] * 25 + [(None, 5)] * 3 + [(2, 6)], "doc_id long, text_hash long")
    got = sharding.numbered(df, 10).collect()
    assert sorted((x["doc_id"] or 0, x["copy"]) for x in got) == [(0, 0), (0, 1), (0, 2), *((1, k) for k in range(25)), (2, 0)]


def test_secret_scan_is_native(spark):
    df = spark.createDataFrame([(1, "token=abcdefgh")], "doc_id long, text string")
    plan = secrets.scan(df, [0.0] * len(secrets.ALPHABET) ** 2)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
