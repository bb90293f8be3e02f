"""Training-data operators do the whole job: one test for each place where they once did less."""

import random

import pytest

from pyspark.sql import functions as F

from specula.llm import decontamination, language_id, secrets


@pytest.mark.parametrize("kind", ["head", "middle", "tail", "anywhere"])
def test_decontamination_recall_at_the_bound(kind):
    r = random.Random(3)
    names = [f"w{k}" for k in range(600)]
    items = [(k, " ".join(r.choices(names, k=n))) for k, n in enumerate(r.choices(range(5, 45), k=120))]
    fitted = decontamination.Index(items, 0.2, 0.95, 5).repetitions
    index = decontamination.Index(items, 0.2, 0.95, 5, fitted)
    texts = []
    for k in range(600):
        w = items[k % len(items)][1].split()
        bound = len(w) // 5
        first = {"head": 0, "middle": (len(w) - bound) // 2, "tail": len(w) - bound}.get(kind)
        for e in reversed(range(bound)):
            at = r.randrange(len(w)) if first is None else first + e
            w[at : at + 1] = ["odd"] if kind == "head" else r.choice([[], ["odd"], ["odd", w[at]]])
        texts.append(" ".join([*r.choices(names, k=8), *w, *r.choices(names, k=8)]))
    got = {(t, i): d for t, i, d, _, _ in index.search(texts)}
    met = [(k, k % len(items)) in got for k in range(len(texts))]
    assert sum(met) >= 0.93 * len(met)
    assert all(d <= len(items[i][1].split()) // 5 for (_, i), d in got.items())


def test_decontamination_says_if_recall_is_out_of_reach():
    items = [(k, " ".join(f"w{(k * 7 + j) % 90}" for j in range(20))) for k in range(30)]
    words = [decontamination.words(t) for _, t in items]
    code = {w: k + 1 for k, w in enumerate(sorted({x for w in words for x in w}))}
    coded = [decontamination.np.array([code[x] for x in w]) for w in words]
    with pytest.raises(ValueError, match="recall"):
        decontamination.SizeClass(coded, list(range(30)), 0.2, 0.95, len(code), 7, most_repetitions=1)


def test_secrets_of_each_alphabet(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model, threshold = secrets.fit(docs)
    new = secrets.random_strings(spark, 300, 50_000).where("length(s) >= 20").select("alphabet", F.substring("s", 1, 20).alias("text"))
    hits = secrets.scan(new, model, threshold).groupBy("alphabet").agg(F.avg((F.size("spans") > 0).cast("int")).alias("recall"))
    recall = {r["alphabet"]: r["recall"] for r in hits.collect()}
    assert len(recall) == 10 and min(recall.values()) >= 0.93, recall
    ordinary = secrets.identifiers(docs.where(secrets.held_for_threshold())).union(secrets.rules(spark, 1)).where("length(s) >= 20").select(F.col("s").alias("text"))
    wrong = secrets.scan(ordinary, model, threshold).agg(F.avg((F.size("spans") > 0).cast("int"))).first()[0]
    assert wrong <= 0.002


def test_every_language_is_learned(spark):
    r = random.Random(12)
    codes = ["en", "de", *(f"x{k}" for k in range(70)), *(f"ru-{k}" for k in range(30))]
    words = {c: ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(6)] for c in codes}
    rows = [(None, " ".join(r.choices(words[c], k=12)), c) for c in codes for _ in range(1 if c == "x3" else 5)]
    df = spark.createDataFrame([*rows, *[rows[0]] * 900, (1, "no label", None)], "doc_id long, text string, lang string")
    model = language_id.fit(df)
    assert model.languages == sorted(codes) and len(model.machines) < 200
    got = language_id.predict(df.where("lang is not null").distinct(), model).collect()
    assert sum(x["lang"] == x["lang_pred"] for x in got) >= 0.97 * len(got)
    assert next(x for x in got if x["lang"] == "x3")["lang_pred"] == "x3"


def test_language_stage_keeps_what_has_letters(spark, sf):
    import corpus_pipeline

    df = spark.createDataFrame([(1, "a text", None), (None, "another", None), (2, "12 + 4", None), (3, None, None)], "doc_id long, text string, lang string")
    assert {x["text"] for x in corpus_pipeline.identify_language(spark, df, sf).collect()} == {"a text", "another"}


def test_stages_with_null_and_repeated_ids(spark, sf):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string"
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 60").first()["text"]
    clean = [" ".join(random.Random(k).choices(["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"], k=30)) for k in range(4)]
    run = lambda stage, rows: sorted(((x["doc_id"], x["text"]) for x in stage(spark, spark.createDataFrame([(i, t, "en") for i, t in rows], schema), sf).collect()), key=str)
    want = lambda *rows: sorted(rows, key=str)
    got = run(corpus_pipeline.identify_language, [(None, clean[0]), (1, clean[1]), (1, "123")])
    assert got == want((None, clean[0]), (1, clean[1]))
    leaked = f"{clean[2]} {item} {clean[3]}"
    assert run(corpus_pipeline.drop_leaks, [(None, leaked), (1, leaked), (1, clean[0]), (None, clean[1])]) == want((1, clean[0]), (None, clean[1]))
    rows = [(None, clean[0]), (None, clean[0]), (1, clean[0]), (1, clean[1]), (2, clean[2]), (2, clean[2]), (None, clean[3]), (None, clean[3])]
    assert run(corpus_pipeline.keep_one_of_near_copies, rows) == want((1, clean[0]), (1, clean[1]), (2, clean[2]), (None, clean[3]))
    rows = [(None, f"{clean[0]}\n{clean[1]}"), (5, clean[0]), (5, clean[2]), (None, clean[2])]
    docs = spark.createDataFrame([(i, t, "en", 1) for i, t in rows], schema + ", n_chars long")
    got = sorted(((x["doc_id"], x["text"]) for x in corpus_pipeline.drop_repeated_lines(spark, docs, sf).collect()), key=str)
    assert got == want((None, clean[1]), (5, clean[0]), (5, clean[2]))
