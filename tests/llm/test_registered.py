"""The registered queries over whole small tables, against brute force, exact searches and public libraries."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import same_rows
from test_operators import brute_fingerprint, brute_leak
from tokenizers import Tokenizer

from specula.llm import line_dedup, queries, secrets


def run(spark, sf, name):
    return queries.QUERIES[name](spark, sf).toPandas()


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_op1(spark, sf, texts):
    got = run(spark, sf, "op1_simhash").set_index("doc_id")
    prints = {k: brute_fingerprint(t) for k, t in texts.items()}
    assert {k: int(v, 16) for k, v in got.fingerprint.items()} == prints and got.fingerprint.str.fullmatch("[0-9a-f]{16}").all()
    ids = sorted(prints)
    x = np.array([prints[k] for k in ids], np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None]) <= 2
    least = np.array(ids)
    while (new := np.where(near, least[None], 1 << 62).min(1)).tolist() != least.tolist():
        least = new
    assert got.component_id.loc[ids].tolist() == least.tolist()


def test_op2_and_op3(spark, sf, texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    codec, counts = run(spark, sf, "op2_bpe_codec").set_index("doc_id"), run(spark, sf, "op3_token_counts").set_index("doc_id")
    assert len(codec) == len(counts) == len(texts)
    for k, x in texts.items():
        ids = t.encode(x, add_special_tokens=False).ids
        assert tuple(codec.loc[k, ["n_tokens", "ids_sha256", "decoded_sha256"]]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert tuple(counts.loc[k, ["n_bytes", "n_tokens", "over_limit"]]) == (len(x.encode()), len(ids), len(ids) > 1024)


def brute_spans(x):
    kinds = {
        "assign": (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 8),
        "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
        "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    }
    found = [(m.start(), n, m.end(), kind) for n, (kind, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, x, re.ASCII) if ok(m)]
    return [(kind, a, b) for a, _, b, kind in sorted(found)]


def test_op4(spark, sf, texts):
    for x in run(spark, sf, "op4_secret_scan").itertuples():
        want = brute_spans(texts[x.doc_id])
        assert x.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert (x.n_assign, x.n_access, x.n_hex) == tuple(sum(k == kind for k, *_ in want) for kind in ("assign", "access", "hex"))
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in x.spans.split(",") if s)]
        assert [s for s in spans if s[0] != "markov"] == want and spans == sorted(spans, key=lambda s: s[1])
        assert all(b <= s[1] or s[2] <= a for s in spans if s[0] == "markov" for _, a, b in want)


def test_spans_of_a_long_list_of_secrets(spark):
    n = 30_000
    body = " ".join(hashlib.sha256(str(k).encode()).hexdigest()[:40] if k % 2 else f"Zx9qL2vT7pWk4RbN8s{k:06d}Yc" for k in range(n))
    df = secrets.scan(spark.createDataFrame([(1, body)], "doc_id long, text string"), [1.0] * 67 * 67, 0.5)
    row = df.selectExpr("size(base) as b", "size(spans) as s", "spans[1].end as e").first()
    assert (row.b, row.s, row.e) == (n // 2, n, 26 + 1 + 40)


def test_op5(spark, sf, duck):
    same_rows(queries.QUERIES["op5_line_dedup"](spark, sf), duck.execute(line_dedup.SQL).df())


def test_op6(spark, sf, texts):
    t, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    got = run(spark, sf, "op6_token_files").set_index("doc_id")
    for k in sorted(texts):
        ids = [*t.encode(texts[k], add_special_tokens=False).ids, 1]
        assert tuple(got.loc[k, ["start", "n_tokens", "ids_crc32"]]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op7(spark, sf):
    got = run(spark, sf, "op7_language_id")
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert (got.held_out == got.doc_id.map(lambda k: zlib.crc32(str(k).encode()) % 4 == 2)).all()
    held = got[got.held_out & got.doc_id.map(lambda k: truth[k] is not None) & (got.lang_pred != "und")]
    assert (held.lang_pred == held.doc_id.map(truth)).mean() >= 0.95 and got.score.between(0, 1).all()


def test_op8(spark, sf):
    got = run(spark, sf, "op8_neighbours")
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    ids, x = np.array([k for k, _ in rows]), np.array([v for _, v in rows], float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for q in ids[ids % 50 == 0]:
        s = unit @ unit[ids == q][0]
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, len(order) + 1))
        assert np.allclose(mine.score, [s[ids == k][0] for k in mine.vec_id], atol=1e-12)
        hits, total = hits + len(set(mine.vec_id) & set(ids[order])), total + len(order)
    assert hits >= 0.9 * total


def test_op9(spark, sf, texts):
    got = run(spark, sf, "op9_kd_sharding")
    assert set(got.law) == {"bytes"} and got.grown_shard.isna().all() and sorted(got.doc_id) == sorted(texts)
    for x in got.itertuples():
        assert (x.size, x.text_crc32) == (len(texts[x.doc_id].encode()) + 8, zlib.crc32(texts[x.doc_id].encode()))
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    sizes = got.groupby("shard")["size"].sum().reindex(range(24), fill_value=0)
    assert (abs(sizes - sizes.mean()) <= 2 * got["size"].max()).all()


def test_op10(spark, sf, texts):
    got = {(r.doc_id, r.item_id): r.n_edits for r in run(spark, sf, "op10_decontamination").itertuples()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    some = dict(list(items.items())[:12])
    want = {(k, i): e for k, t in texts.items() for i, y in some.items() if (e := brute_leak(t[:6000], y)) is not None and len(t) <= 6000}
    mine = {k: e for k, e in got.items() if k[1] in some and len(texts[k[0]]) <= 6000}
    assert set(mine) <= set(want) and len(mine) >= 0.93 * len(want) and all(k in mine for k, e in want.items() if e == 0)
