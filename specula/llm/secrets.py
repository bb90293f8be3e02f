"""Secret scans of whole texts: three patterns, and character Markov models for what patterns miss.

Spans are found with regular expressions on the JVM: the parts between matches and the matches themselves, whose
lengths add up to positions in code points. A pattern that a cheap look shows to be absent isn't run.

Models: the text's unbroken runs of at least ``min_chars`` characters of ``[A-Za-z0-9+/_=-]`` are candidates. Two
first-order Markov chains over the 67 characters, one of random strings and one of ordinary identifiers, are
trained from labelled samples by counting character pairs with one added to each; a candidate is a secret if the
log-likelihood ratio per character is above ``threshold``, whatever its characters. The table of 67 x 67 ratios is a literal of the plan, so
scoring is one fold over a candidate's characters. Candidates inside a pattern's span aren't given twice.

Labelled samples: random strings are digests of a counter in ten alphabets; ordinary ones are identifiers made from
the words of a bounded sample of documents (``sample_docs``, chosen by hash of doc_id), joined as programs join them,
and rules of one character. ``fit_threshold`` sets the threshold on samples held out of training.

Only DataFrame functions; a map without a shuffle but for training. Defined results: a null or empty text has no
spans; equal rows give equal rows; text without candidates costs the three looks only; an empty table gives no
rows and is never trained on (identifiers then count as uniform).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specula.llm.common import table, text_or_empty, with_running

#: The patterns that define the kinds, and the least length of what counts.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # [0-9a-f]+ of 32 or more: the same spans, as runs are taken whole
LEAST = {"assign": 8, "access": 16, "hex": 32}
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
KINDS = ("assign", "access", "hex", "markov")


def _with_spans(df: DataFrame, text: str, kind: str, pattern: str, look: Column, counts, to: str) -> DataFrame:
    """``df`` with the spans of a pattern in ``to``: array of (begin, kind, end, match); ``counts`` says of a match whether it does.

    Where matches begin are running sums of lengths; the steps grow as the number of matches to the power 1.5.
    """
    none, order = F.array().cast("array<string>"), KINDS.index(kind)
    out = df.withColumn("_found", F.when(look, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    out = out.withColumn("_between", F.when(look, F.split(text, pattern)).otherwise(none))
    ahead = F.transform("_found", lambda m, k: F.length(F.get("_between", k)) + F.coalesce(F.length(F.get("_found", k - 1)), F.lit(0)))
    out = with_running(out.withColumn("_ahead", ahead), "_ahead", "_begins", F.lit(0), lambda a, b: a + b)
    span = lambda m, at: F.struct(at.alias("begin"), F.lit(order).alias("kind"), (at + F.length(m)).alias("end"), m.alias("match"))
    return out.withColumn(to, F.filter(F.zip_with("_found", "_begins", span), lambda x: counts(x["match"]))).drop("_found", "_between", "_ahead", "_begins")


def with_base_spans(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``base``: spans of the three patterns, by begin, then kind."""
    t = F.col(text)
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST["assign"]
    long_enough = lambda kind: lambda m: F.length(m) >= LEAST[kind]
    out = _with_spans(df, text, "assign", ASSIGN, t.rlike(r"(?i)(?:passw|secret|token|api_?key)"), value, "_assign")
    out = _with_spans(out, text, "access", ACCESS, F.contains(t, F.lit("AKIA")), long_enough("access"), "_access")
    out = _with_spans(out, text, "hex", HEX, t.rlike(HEX), long_enough("hex"), "_hex")
    return out.withColumn("base", F.array_sort(F.concat("_assign", "_access", "_hex"))).drop("_assign", "_access", "_hex")


def _pair_counts(samples: DataFrame) -> DataFrame:
    """Counts of neighbouring characters in ``s``."""
    s = samples.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda k: F.call_function("substring", F.col("s"), k, F.lit(2)))).alias("pair"))
    return s.groupBy("pair").count()


def random_strings(spark: SparkSession, n: int = 3000, start: int = 0) -> DataFrame:
    """alphabet and s: digests of a counter from ``start`` on, in ten alphabets."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    base = F.base64(F.unhex(digest))
    plain = F.regexp_replace(base, "[+/=]", "")
    letters = F.regexp_replace(plain, "[0-9]", "")
    kinds = {
        "hex": digest,
        "base64": base,
        "base64url": F.translate(base, "+/", "-_"),
        "base62": plain,
        "upper and digits": F.upper(plain),
        "letters": letters,
        "lower": F.lower(letters),
        "upper": F.upper(letters),
        "upper hex": F.upper(digest),
        "digits": F.regexp_replace(digest, "[a-f]", ""),
    }
    each = F.array(*(F.struct(F.lit(k).alias("alphabet"), v.alias("s")) for k, v in kinds.items()))
    return spark.range(start, start + n).select(F.explode(each).alias("x")).select("x.alphabet", "x.s")


def rules(spark: SparkSession, n: int = 1000) -> DataFrame:
    """Runs of one character, as separators and fillers have them."""
    return spark.range(n).select(F.explode(F.transform(F.split(F.lit(ALPHABET), ""), lambda c: F.repeat(c, F.lit(40)))).alias("s"))


def identifiers(docs: DataFrame, sample_docs: int = 500) -> DataFrame:
    """Words of a bounded sample of documents, three at a time, joined in the ways of programs."""
    lot = F.xxhash64("doc_id")
    edge = docs.where("text is not null").select(lot.alias("lot")).orderBy("lot").limit(sample_docs).agg(F.max("lot")).first()[0]
    some = docs.where("text is not null").where(lot <= F.lit(edge).cast("bigint"))
    words = some.select(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,12}"), F.lit(0)).alias("w")).where("size(w) >= 3")
    three = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda k: F.slice("w", k, 3))).alias("t"))
    lower = F.transform("t", lambda w: F.lower(w))
    camel = F.concat(F.element_at(lower, 1), F.array_join(F.transform(F.slice("t", 2, 2), lambda w: F.initcap(w)), ""))
    numbered = F.concat(F.array_join(lower, "_"), F.lit("_"), F.pmod(F.xxhash64("t"), F.lit(100)).cast("string"))
    return three.select(F.explode(F.array(F.array_join(lower, "_"), F.array_join(lower, "-"), F.array_join(lower, "/"), F.upper(F.array_join(lower, "_")), camel, numbered)).alias("s"))


def train(random: DataFrame, ordinary: DataFrame) -> list[float]:
    """Log-likelihood ratios of all pairs of characters, random over ordinary; 67 x 67 numbers, whatever the samples."""
    tables = []
    for samples in (random, ordinary):
        counts = {r["pair"]: r["count"] for r in _pair_counts(samples.where("length(s) > 1")).where(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$")).collect()}
        rows = []
        for a in ALPHABET:
            row = [counts.get(a + b, 0) + 1 for b in ALPHABET]
            rows += [math.log(x / sum(row)) for x in row]
        tables.append(rows)
    return [round(a - b, 6) for a, b in zip(*tables, strict=True)]


def held_for_threshold() -> Column:
    """Which documents the identifiers of the threshold are from; the model's are from the others."""
    return F.pmod(F.xxhash64(F.lit("threshold"), "doc_id"), F.lit(4)) == 0


def fit_threshold(model: list[float], random: DataFrame, ordinary: DataFrame, min_chars: int = 20) -> float:
    """Halfway between what 99.9 % of ordinary samples stay below and what 95 % of each alphabet's random ones exceed.

    Random samples (alphabet, s) are cut to the shortest candidate, which is the hardest.
    """
    enough = F.length("s") >= min_chars
    ratios = F.array(*map(F.lit, model))
    scored = lambda df, *names: df.where(enough).withColumn("_ratios", ratios).select(*names, score(F.col("s")).alias("x"))
    low = scored(ordinary).agg(F.expr("percentile(x, 0.999)")).first()[0]
    cut = random.withColumn("s", F.when(enough, F.substring("s", 1, min_chars)).otherwise(F.col("s")))
    high = scored(cut, "alphabet").groupBy("alphabet").agg(F.expr("percentile(x, 0.05)").alias("x")).agg(F.min("x")).first()[0]
    return round((low + high) / 2, 6)


def score(m: Column) -> Column:
    """The log-likelihood ratio per character of ``m``; the model is in column _ratios."""
    size = len(ALPHABET)
    at = F.transform(F.split(m, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c))
    cell = F.zip_with(F.slice(at, F.lit(1), F.size(at) - 1), F.slice(at, F.lit(2), F.size(at) - 1), lambda a, b: F.get("_ratios", (a - 1) * size + b - 1))
    return F.aggregate(cell, F.lit(0.0), lambda acc, x: acc + x) / (F.length(m) - 1)


def _apart(spans: str, others: str, block: int = 256) -> Column:
    """Those of ``spans`` (by begin) that overlap none of ``others``; a block of them is compared with the others near it only."""
    overlap = lambda m, b: (b["begin"] < m["end"]) & (m["begin"] < b["end"])

    def of_block(k):
        own = F.slice(spans, k, F.lit(block))
        first, last = F.get(own, F.lit(0)), F.get(own, F.size(own) - 1)
        near = F.filter(others, lambda b: (b["begin"] < last["end"]) & (first["begin"] < b["end"]))
        return F.get(F.transform(F.array(near), lambda n: F.filter(own, lambda m: ~F.exists(n, lambda b: overlap(m, b)))), F.lit(0))

    begins = F.when(F.size(spans) > 0, F.sequence(F.lit(1), F.size(spans), F.lit(block))).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(others) == 0, F.col(spans)).otherwise(F.flatten(F.transform(begins, of_block)))


def scan(docs: DataFrame, model: list[float], threshold: float = 2.0, min_chars: int = 20, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (begin, kind, end, match), spans with those of the models.

    Columns of these names are replaced; names with an underscore in front are used on the way.
    """
    pattern = CANDIDATE % min_chars
    df = with_base_spans(docs.withColumn("_body", F.coalesce(F.col(text), F.lit(""))), "_body").withColumn("_ratios", F.array(*map(F.lit, model)))
    df = _with_spans(df, "_body", "markov", pattern, F.col("_body").rlike(pattern), lambda m: score(m) > threshold, "_markov")
    return df.withColumn("spans", F.array_sort(F.concat("base", _apart("_markov", "base")))).drop("_ratios", "_body", "_markov")


def fit(docs: DataFrame) -> tuple[list[float], float]:
    """Model and threshold, from documents (doc_id, text) that share none."""
    spark, held = docs.sparkSession, F.coalesce(held_for_threshold(), F.lit(False))
    model = train(random_strings(spark), identifiers(docs.where(~held)).union(rules(spark)))
    return model, fit_threshold(model, random_strings(spark, 600, 3000), identifiers(docs.where(held)).union(rules(spark, 1)))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["begin"].cast("string"), s["end"].cast("string"))), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, threshold = fit(docs)
    found = scan(docs.select("doc_id", text_or_empty().alias("text")), model, threshold)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
