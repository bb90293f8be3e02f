"""Benchmark items of any length, and edit shares that walks can't serve, against the whole table of distances."""

import random

import numpy as np
import pytest
from test_operators import brute_leak, docs

from specula.llm import decontamination


def edited(r, words, edits, vocabulary):
    out = list(words)
    for _ in range(edits):
        at, how = r.randrange(len(out)), r.randrange(3)
        out[at : at + (how != 0)] = [r.choice(vocabulary)] if how != 2 else []
    return out


def test_nearest_window_is_the_least_of_all():
    r = random.Random(1)
    for _ in range(300):
        item = [r.randint(1, 4) for _ in range(r.randint(1, 9))]
        text = [r.randint(1, 4) for _ in range(r.randint(0, 14))]
        d, at = decontamination.nearest_window(np.array(item), np.array(text, int))
        name = lambda x: " ".join(f"w{k}" for k in x)
        assert d == brute_leak(name(text), name(item), 1.0)
        starts = [s for s in range(len(text) + 1) if min(plain(item, text[s:e]) for e in range(s, len(text) + 1)) == d]
        assert at == starts[0]


def plain(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(d[j] + 1, new[-1] + 1, d[j - 1] + (x != y)))
        d = new
    return d[-1]


def test_items_of_every_length(spark):
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)]
    sizes = [1, 3, 5, 12, 30, 60, 61, 99, 120, 250, 600, 2000]
    items = {k: [r.choice(vocabulary) for _ in range(n)] for k, n in enumerate(sizes)}
    items[0] = ["onlyhere"]
    noise = lambda n: [r.choice(vocabulary) for _ in range(n)]
    texts, planted = [], {}
    for k, w in items.items():
        bound = int(len(w) * 0.2 + 1e-9)
        for edits in sorted({0, bound // 2, bound} | ({bound} if len(w) < 100 else set())):
            for _ in range(3 if len(w) < 1000 else 1):
                planted[len(texts)] = k, edits
                texts.append(" ".join(noise(r.randint(0, 40)) + edited(r, w, edits, vocabulary) + noise(r.randint(0, 40))))
    texts += [" ".join(noise(500)), " ".join(items[9] + noise(30) + items[9]), None, ""]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id bigint, text string")
    got = {(x["doc_id"], x["item_id"]): (x["n_edits"], x["item_words"], x["first_word"]) for x in decontamination.leaks(docs(spark, texts), bench).collect()}
    for (doc, item), (d, n, at) in got.items():
        w = items[item]
        assert n == len(w) and d <= int(len(w) * 0.2 + 1e-9)
        if len(w) > 60:
            assert d == brute_leak(texts[doc], " ".join(w)) and at >= 0
    found = [doc for doc, (k, _) in planted.items() if (doc, k) in got]
    assert len(found) >= 0.95 * len(planted)
    assert all((doc, k) in got for doc, (k, edits) in planted.items() if edits == 0 or len(items[k]) > 60)
    assert got[len(texts) - 3, 9] == (0, 250, 0)


@pytest.mark.parametrize("share", [0.5, 0.7])
def test_shares_that_walks_do_not_reach(share):
    r = random.Random(2)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(n))) for k, n in enumerate([4, 20, 45, 80])]
    fitted = decontamination.Index(items, share, 0.95, 1).repetitions
    assert -1 in fitted
    index = decontamination.Index(items, share, 0.95, 1, fitted)
    assert index.repetitions == fitted
    texts = [" ".join([r.choice(vocabulary) for _ in range(15)] + edited(r, t.split(), int(len(t.split()) * share * f), vocabulary) + ["tail"] * 5) for _, t in items for f in (0.5, 1.0)]
    want = {(k, i): d for k, t in enumerate(texts) for i, x in items if len(x.split()) > 10 and (d := brute_leak(t, x, share)) is not None}
    got = {(k, i): d for k, i, d, *_ in index.search(texts)}
    assert {k: v for k, v in got.items() if k[1]} == want and len(want) >= 6
