"""Fill-in-the-middle and collocations against plain computations over awkward texts."""

import hashlib
import random
import re
from collections import Counter

import pytest
from conftest import same_rows

from specula.llm import collocations, fill_in_middle, queries

SCHEMA = "doc_id bigint, text string, lang string, n string, form string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("name", ["op12_fill_in_middle", "op13_collocations"])
def test_registered(spark, sf, duck, name):
    same_rows(queries.QUERIES[name](spark, sf), duck.execute(queries.ORACLE_SQL[name]).df())


PATTERNS = {"line": r"[^\n]*\n|[^\n]+", "sentence": r"[^\n.!?]*[\n.!?]|[^\n.!?]+", "piece": r"[^\n.!?,;:]*[\n.!?,;:]|[^\n.!?,;:]+", "word": r"[^\n \t]*[\n \t]|[^\n \t]+"}


@pytest.mark.parametrize("unit", PATTERNS)
def test_units_are_the_patterns(unit):
    r = random.Random(5)
    for size in [0, 1, 2, 3, 63, 64, 65, 127, 128, 129, 900] * 20:
        x = "".join(r.choice("ab\n\n. ,;é😀<P") for _ in range(size))
        units, want = fill_in_middle.Units(x, unit), re.findall(PATTERNS[unit], x)
        assert units.count == len(want)
        assert [units.cut(k) for k in range(len(want) + 1)] == [len("".join(want[:k])) for k in range(len(want) + 1)]


def plain_fim(doc_id, text, unit="line", rate=100, spm=50):
    text = text or ""
    units = re.findall(PATTERNS[unit], text)
    h = [int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[k : k + 8], 16) for k in range(0, 32, 8)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, None)))
    form = "spm" if h[3] % 100 < spm else "psm"
    return len(units), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


AWKWARD = [(1, None), (2, ""), (3, "\n"), (4, "\n\n\n"), (5, "no end"), (6, "a\r\nb\n"), (7, "has <S> inside\nx"), (8, "ends <\nS>\n<P"), (None, "no id\nat\nall"), (9, "日本\n😀\n" * 40), (9, "日本\n😀\n" * 40), (9, "again\n\nby one id"), (10, "one. two, three! four\n" * 3)]


@pytest.mark.parametrize("unit,rate,spm", [("line", 100, 50), ("piece", 50, 100), ("word", 100, 0)])
def test_fill_in_middle(spark, unit, rate, spm):
    rows = [(k, t, "en") for k, t in AWKWARD]
    out = fill_in_middle.fill_in_middle(frame(spark, rows), unit, rate, spm).withColumn("again", fill_in_middle.restored())
    assert out.columns[:3] == ["doc_id", "text", "lang"]
    got = Counter((r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["again"]) for r in out.collect())
    assert got == Counter((k, t, *plain_fim(k, t, unit, rate, spm), t or "") for k, t in AWKWARD)
    assert fill_in_middle.fill_in_middle(frame(spark, []), unit).count() == 0


def test_a_long_text_in_the_middle(spark):
    x = ("é line of words\n" * 700_000)[:-1]  # 11 MB
    r = fill_in_middle.fill_in_middle(spark.createDataFrame([(3, x)], "doc_id long, text string")).withColumn("again", fill_in_middle.restored()).first()
    assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_fim(3, x) and r["again"] == x


def plain_collocations(rows, least, inside, longest):
    f, n = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, count in f.items():
        cands = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        parts = {}
        for p, a in cands.items():
            for i in range(len(p)):
                for j in range(i + 1, len(p) + 1):
                    if j - i < len(p):
                        parts[p[i:j]] = max(parts.get(p[i:j], 0), a)
        for p, a in cands.items():
            if 100 * parts.get(p, -1) >= inside * a:
                continue
            score, _, lf, rf = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            out.add((lang, " ".join(p), a, lf, rf, n[lang], score))
    return out


def texts(seed):
    r = random.Random(seed)
    words = [*"abcdefgh", "Über", "Zoo", "zoo", "日本", "\x85x", "-"]
    long = "one two three four five six seven eight"
    rows = [(k, "".join(r.choice([*words, long, "x y"]) + r.choice([" ", " ", " ", "\t ", ". ", "\n", ",", "!?"]) for _ in range(r.randint(0, 60))), r.choice(["en", "de", None, ""])) for k in range(150)]
    return rows + [(1, None, "en"), (2, "", "en"), (3, " ... ", "xx"), (4, "a a a a a a a a a", "en"), (None, long, "en"), *[(7, long + " " + long, "en")] * 20]


@pytest.mark.parametrize("least,longest", [(3, 4), (5, 3)])
def test_collocations(spark, least, longest, monkeypatch):
    rows = texts(least)
    got = {(r["lang"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in collocations.collocations(frame(spark, rows), least, 80, longest=longest).collect()}
    assert got == plain_collocations(rows, least, 80, longest) and len(got) > 20
    assert collocations.collocations(frame(spark, []), least).count() == 0


def test_words_counted_in_small_parts(monkeypatch):
    import pyarrow as pa

    rows = texts(1)
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t, _ in rows]), pa.array([x or "und" for *_, x in rows])], names=["text", "lang"])

    def counts():
        out = Counter()
        for lang, ids, words, starts in collocations._counted([batch]):
            ahead = [*ids.tolist(), 0, 0, 0]
            for k in range(starts):
                gram = ahead[k : k + 4]
                out[lang, tuple(words[i] for i in (gram[: gram.index(0)] if 0 in gram else gram))] += 1
        return Counter({k: v for k, v in out.items() if k[1]})

    whole = counts()
    monkeypatch.setattr(collocations, "SLICE", 40)
    monkeypatch.setattr(collocations, "COUNTED", 30)
    assert counts() == whole


def test_unary_paths_and_top(spark):
    rows = [(k, "p q r s t u v. p q r x" if k % 2 else "p q r s t u v", "en") for k in range(20)]
    df = frame(spark, rows)
    graph = collocations.edges(df, 5)
    flows = collocations.flows(graph)
    paths = {(tuple(r["words"]), r["f"]) for r in collocations.unary_paths(flows[3], flows[2]).collect()}
    assert paths == {(tuple("pqrstuv"), 20), (tuple("pqrx"), 10)}
    top = collocations.first_of_each(spark.createDataFrame([("en", f"w{k:03d}", 5, k % 7) for k in range(100)], "lang string, phrase string, a long, score long"), 9).orderBy("rank").collect()
    assert [(r["rank"], r["phrase"]) for r in top] == [(i + 1, f"w{6 + 7 * i:03d}") for i in range(9)]
