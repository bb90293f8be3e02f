"""Layers of documents against plain dictionaries."""

import json
import random

from specula.plans import target_queries as T


def plain(docs, name, scene):
    good = {}
    for k, body in docs:
        try:
            d = json.loads(body)
        except (TypeError, ValueError):
            continue
        if isinstance(d, dict):
            good[k] = d
    numbers = lambda d, only=T.NUMBERS: {k: float(v) for k, v in d.items() if k in only and v is not None}
    own = good.get(name, {})
    out = numbers(good.get(T.DEFAULT, {})) | numbers(own)
    if not own.get("skin_own"):
        out |= numbers(good.get(T.SHARED, {}), T.SKIN)
    hits = []
    for axis in T.AXES:
        if scene.get(axis) is not None:
            for v in (scene[axis], "*"):
                if (k := f"{axis}={v}") and f"{T.SCENE}/{k}" in good:
                    out |= numbers(good[f"{T.SCENE}/{k}"])
                    hits.append(k)
    return out, name in good, hits


def test_layers(spark):
    r = random.Random(3)
    docs = [(T.DEFAULT, json.dumps({"sat": 1, "hi_shape": 30.5, "skin_l": 9, "sh": [1, 2], "unknown": {"a": 1}}, indent=2)), (T.SHARED, '{"skin_l": 4,\n "sat": 7}')]
    for k in range(12):
        body = {f: r.choice([None, k + 0.5]) for f in r.sample(T.NUMBERS, 4)} | ({"skin_own": r.random() < 0.5} if k % 3 else {})
        docs.append((f"s{k}", json.dumps(body, indent=1) if k % 4 else json.dumps(body)[:-3]))
    docs += [("broken", "{"), ("null", None), ("text", "nothing"), *((f"{T.SCENE}/{a}={v}", json.dumps({r.choice(T.NUMBERS): i})) for i, (a, v) in enumerate([("exp", "x"), ("exp", "*"), ("shot", "far"), ("face", "*")]))]
    requests = [(k, r.choice([f"s{r.randint(0, 13)}", "broken", "null", "text", None]), r.choice(["x", "y", None]), r.choice(["far", None]), r.choice(["no", None])) for k in range(80)]
    df = spark.createDataFrame(requests, "request int, name string, exp string, shot string, face string")
    body = spark.createDataFrame(docs, "name string, body string")
    got = {x["request"]: (x["fields"], x["own"], x["hits"]) for x in T.resolved(df, body, ["exp", "shot", "face"]).collect()}
    want = {k: plain(docs, name, {"exp": e, "shot": s, "face": f}) for k, name, e, s, f in requests}
    assert got == want
    assert T.resolved(df, body.where("false"), ["exp"]).count() == len(requests) and T.resolved(df.where("false"), body, ["exp"]).count() == 0
    bad = {x["name"] for x in T.parsed(body).where("_bad IS NOT NULL").collect()}
    assert bad == {"s0", "s4", "s8", "broken", "text"}
