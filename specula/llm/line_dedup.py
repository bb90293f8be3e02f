"""Line dedup over a corpus: of lines that are equal or one word apart, the earliest stays.

A line is compared in lower case, with runs of blanks as one space; blank lines are left alone. It goes if an
earlier one (by doc_id, then place) equals it, or is one word edit away (a word put in, taken out or changed) with a
similarity of 0.8 or more, 1 - edits / words of the shorter line. Both lines have five words or more then; this is
one rule for lines of all lengths, of which ``min_words`` is the other form.

Exact copies come first: one row a distinct line, with its earliest place. Near copies are found among distinct
lines by a deletion-neighbourhood join: each line is put out as the hash of itself and of itself without each of
its words. Lines that share a variant without the word at one place differ in that word only, and a line equal to
another's variant lacks one word. So what a line needs is the earliest line of each of its variants, an aggregate
that Spark combines before the shuffle; no pairs are made however many lines share a variant. The edit distance to
the earliest partner is then verified on the words. Variants are only made for lines that share their first or
their last half with another distinct line, as two lines one edit apart must: that keeps the neighbourhoods small.
A variant's hash is the exclusive or of its words' hashes with their places, so that all variants of a line follow
from one running fold over its words.

Only DataFrame functions. Lines are normalized and hashed once, into a table of keys. Before a join a sieve of fixed
size (``specula.llm.common.sieve``) lets through the rows whose key can be among the wanted ones, so that texts of
lines without a near copy and of documents that lose no line aren't shuffled; joins decide. Where wanted keys are
more than the sieve tells apart, it lets all rows through and the joins get them all. Keys are two XXH64 with
different seeds, 128 bits.

Defined results: a null text stays null with no lines; an empty one stays empty; lines equal inside one document
count too; rows that repeat a doc_id and its text share their fate, those of another text are documents of their own,
in the order of a hash; one without a doc_id takes no part and passes unchanged; an empty table gives no rows; further
columns pass through, those named n_lines, n_exact or n_near are replaced.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specula.llm.common import drop_written, may_be_in, sieve, table, with_running, written

BLANKS = "\t\r\x0b\x0c"


def with_normal(df: DataFrame) -> DataFrame:
    """``df`` with ``_normal``: the text with each line in the form in which it is compared. Most texts need lower case only.

    A column a step, as Spark then works each out once.
    """
    has = lambda c, *parts: functools.reduce(lambda x, y: x | y, (F.contains(c, F.lit(p)) for p in parts))
    out = df.withColumn("_low", F.lower("text"))
    out = out.withColumn("_flat", F.when(has("_low", *BLANKS), F.translate("_low", BLANKS, " " * len(BLANKS))).otherwise(F.col("_low")))
    out = out.withColumn("_single", F.when(has("_flat", "  "), F.regexp_replace("_flat", " +", " ")).otherwise(F.col("_flat")))
    out = out.withColumn("_normal", F.trim(F.when(has("_single", " \n", "\n "), F.regexp_replace("_single", " ?\n ?", "\n")).otherwise(F.col("_single"))))
    return out.drop("_low", "_flat", "_single")


def _key(*parts) -> list[Column]:
    return [F.xxhash64(F.lit(seed), *parts).alias(f"k{seed}") for seed in (1, 2)]


def _exploded(docs: DataFrame) -> DataFrame:
    """Lines that aren't blank: doc_id, h (of the text), line_no, norm."""
    df = with_normal(docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("h"), "text"))
    return df.select("doc_id", "h", F.posexplode(F.split("_normal", "\n")).alias("line_no", "norm")).where("norm <> ''")


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, h, line_no, the two hashes of the line, and its halves if long enough."""
    n = (F.octet_length("norm") - F.octet_length(F.replace(F.col("norm"), F.lit(" "))) + 1).alias("n")
    df = _exploded(docs).select("doc_id", "h", "line_no", "norm", n)
    return df.select("doc_id", "h", "line_no", *_key("norm"), F.when(F.col("n") >= min_words, _halves()).alias("halves"))


def _halves() -> Column:
    """Hashes of what a line one edit apart shares: the first or last half of the words of the shorter of both.

    A line of n words stands for itself among lines as long or longer, and for n - 1 words among shorter ones.
    """
    n, keys = F.col("n"), []
    for length in (n, n - 1):
        cut = F.floor(length / 2).cast("int")
        for name, k in (("first", cut), ("last", cut - length)):
            keys.append(F.xxhash64(F.lit(name), length, F.call_function("substring_index", F.col("norm"), F.lit(" "), k)))
    return F.array(*keys)


def with_variants(lines: DataFrame) -> DataFrame:
    """``lines`` with v1 and v2: hashes of ``norm`` as a whole (place 0) and without each of its words (places 1 to n)."""
    xor = lambda a, b: a.bitwiseXOR(b)
    zero = F.lit(0).cast("bigint")
    out = lines.withColumn("_words", F.split("norm", " "))
    for seed in (1, 2):
        out = out.withColumn("_own", F.transform("_words", lambda w, k: F.xxhash64(F.lit(seed), w, k)))
        out = out.withColumn("_moved", F.transform(F.slice("_words", F.lit(2), F.size("_words")), lambda w, k: F.xxhash64(F.lit(seed), w, k)))
        # without its first word; then word after word back in and the next one out
        steps = F.concat(F.array(F.aggregate("_moved", zero, xor)), F.zip_with(F.slice("_own", F.lit(1), F.size("_moved")), "_moved", xor))
        out = with_running(out.withColumn("_steps", steps), "_steps", "_without", zero, xor)
        out = out.withColumn(f"v{seed}", F.concat(F.array(F.aggregate("_own", zero, xor)), "_without"))
    return out.drop("_words", "_own", "_moved", "_steps", "_without")


def _within_one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays of words differ by one edit at most."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda e: ~e))

    def lacks(long, short):
        differs = F.array_position(F.zip_with(long, short, lambda x, y: x.eqNullSafe(y)), False).cast("int")
        return F.slice(long, differs + 1, F.size(long)) == F.slice(short, differs, F.size(short) + 1)

    return F.when(F.size(a) == F.size(b), same <= 1).when(F.size(a) == F.size(b) + 1, lacks(a, b)).when(F.size(b) == F.size(a) + 1, lacks(b, a)).otherwise(F.lit(False))


def repeated_lines(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """doc_id, h, line_no and ``near`` of each line that goes. Each step is a table, so that its shuffle files can go."""
    place = F.struct("doc_id", "h", "line_no")
    lines = written(_lines(docs, min_words), "lines")
    firsts = lines.select("k1", "k2", F.struct(place.alias("at"), "halves").alias("f")).groupBy("k1", "k2").agg(F.min("f").alias("f"), F.count(F.lit(1)).alias("copies"))
    firsts = written(firsts.select("k1", "k2", F.col("f.at").alias("at"), F.col("f.halves").alias("halves"), "copies"), "first-lines")
    copies = firsts.where("copies > 1").select("k1", "k2", "at")
    of_copies = sieve(copies, "k1")
    exact = lines.where(may_be_in(of_copies, "k1")).select("doc_id", "h", "line_no", "k1", "k2").join(copies, ["k1", "k2"])
    exact = written(exact.where(place != F.col("at")).select("doc_id", "h", "line_no", F.lit(False).alias("near")), "equal-lines")
    drop_written(lines)

    half = firsts.where("halves is not null").select(F.explode("halves").alias("half"), "k1", "at.doc_id", "at.h", "at.line_no")
    shared = written(half.groupBy("half").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).where("lo <> hi").select("half"), "shared-halves")
    wanted = half.where(may_be_in(sieve(shared, "half"), "half")).join(shared, "half")
    wanted = written(wanted.select("doc_id", "h", "line_no").distinct(), "wanted-lines")
    drop_written(firsts)
    drop_written(shared)
    some = _exploded(docs).where(may_be_in(sieve(wanted, "doc_id", "h", "line_no"), "doc_id", "h", "line_no")).join(wanted, ["doc_id", "h", "line_no"])
    some = written(with_variants(some.select(place.alias("at"), "norm").distinct()), "near-lines")
    drop_written(wanted)

    # variants that two lines have; then the rows of these only
    own = F.xxhash64("at.doc_id", "at.h", "at.line_no").alias("own")
    twice = some.select(own, F.explode("v1").alias("v1")).groupBy("v1").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo <> hi").select("v1")
    twice = written(twice, "shared-variants")
    each = some.select("at", F.posexplode(F.arrays_zip("v1", "v2")).alias("place", "v")).select("at", "place", "v.v1", "v.v2")
    variants = written(each.where(may_be_in(sieve(twice, "v1"), "v1")).join(twice, "v1"), "variants")
    drop_written(twice)
    by_place = variants.groupBy("v1", "v2", "place").agg(F.min("at").alias("first"))
    # of one variant: the earliest line without the word at a place, the earliest without any word, the whole line
    by_key = by_place.groupBy("v1", "v2").agg(
        F.min(F.when(F.col("place") > 0, F.col("first"))).alias("any_first"),
        F.min(F.when(F.col("place") == 0, F.col("first"))).alias("whole"),
    )
    same_place = by_place.join(by_key, ["v1", "v2"]).select("v1", "v2", "place", F.when(F.col("place") == 0, F.col("any_first")).otherwise(F.least("first", "whole")).alias("partner"))
    pairs = variants.join(same_place, ["v1", "v2", "place"]).where("partner < at").groupBy("at").agg(F.min("partner").alias("partner"))
    words = lambda c: F.split(F.col(c), " ")
    checked = pairs.join(some.select("at", "norm"), "at").join(some.select(F.col("at").alias("partner"), F.col("norm").alias("norm_b")), "partner")
    near = checked.where(_within_one_edit(words("norm"), words("norm_b"))).select("at.doc_id", "at.h", "at.line_no", F.lit(True).alias("near"))
    out = written(exact.unionByName(near), "repeated-lines")
    for t in (exact, some, variants):
        drop_written(t)
    return out


def line_dedup(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``; adds n_lines, n_exact and n_near (lines before, and gone)."""
    names = [c for c in docs.columns if c not in ("text", "n_lines", "n_exact", "n_near")]
    gone = repeated_lines(docs.select("doc_id", "text"), min_words).groupBy(F.col("doc_id").alias("_doc_id"), F.col("h").alias("_h"))
    gone = gone.agg(F.collect_list("line_no").alias("_gone"), F.count_if("near").alias("_near"))  # no more than the document's lines
    filled = F.size(F.array_remove(F.split("_normal", "\n"), ""))
    own = [F.col(f"`{c}`") for c in names]
    rows = with_normal(docs.select(*own, "text", F.xxhash64("text").alias("_h")))
    rows = rows.select(*own, "text", "_h", F.when(F.col("text").isNull(), 0).otherwise(filled).cast("bigint").alias("n_lines"))
    may_lose = may_be_in(sieve(gone, "_doc_id", "_h"), "doc_id", "_h")
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    left = F.array_join(F.transform(kept, lambda k: F.get("_lines", k)), "\n")
    of_doc = gone.withColumnRenamed("_h", "_gone_h").hint("shuffle_hash")
    lose = rows.where(may_lose).join(of_doc, (F.col("doc_id") == F.col("_doc_id")) & (F.col("_h") == F.col("_gone_h")), "left").withColumn("_lines", F.split("text", "\n"))
    n_gone = F.coalesce(F.size("_gone"), F.lit(0))
    n_near = F.coalesce("_near", F.lit(0))
    lose = lose.select(*own, F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left).alias("text"), "n_lines", (F.greatest(n_gone, F.lit(0)) - n_near).cast("bigint").alias("n_exact"), n_near.cast("bigint").alias("n_near"))
    none = F.lit(0).cast("bigint")
    return rows.where(~may_lose).select(*own, "text", "n_lines", none.alias("n_exact"), none.alias("n_near")).unionByName(lose)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_exact", "n_near", "text")


SQL = r"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
l AS (SELECT doc_id, line_no, trim(regexp_replace(lower(line), '[ \t\r\x0b\x0c]+', ' ', 'g')) AS norm FROM raw),
b AS (SELECT doc_id, line_no, norm, doc_id * 10000000 + line_no AS pos FROM l WHERE norm <> ''),
f AS (SELECT norm, min(pos) AS pos, string_split(norm, ' ') AS w FROM b GROUP BY norm),
n AS (SELECT norm, pos, w, len(w) AS n FROM f WHERE len(w) >= 5),
v AS (
  SELECT pos, 0 AS place, norm AS rest FROM n
  UNION ALL
  SELECT pos, k AS place, array_to_string(list_concat(w[1:k - 1], w[k + 1:n]), ' ') AS rest FROM (SELECT pos, w, n, unnest(range(1, n + 1)) AS k FROM n)
),
p AS (SELECT rest, place, min(pos) AS least_pos FROM v GROUP BY rest, place),
k AS (SELECT rest, min(CASE WHEN place > 0 THEN least_pos END) AS any_least, min(CASE WHEN place = 0 THEN least_pos END) AS whole FROM p GROUP BY rest),
near AS (
  SELECT DISTINCT v.pos FROM v JOIN p ON p.rest = v.rest AND p.place = v.place JOIN k ON k.rest = v.rest
  WHERE (v.place = 0 AND k.any_least < v.pos) OR (v.place > 0 AND (p.least_pos < v.pos OR k.whole < v.pos))
),
marked AS (
  SELECT b.doc_id, b.line_no, CASE WHEN b.pos <> f.pos THEN 1 ELSE 0 END AS is_exact, CASE WHEN b.pos = f.pos AND near.pos IS NOT NULL THEN 1 ELSE 0 END AS is_near
  FROM b JOIN f ON f.norm = b.norm LEFT JOIN near ON near.pos = b.pos
),
j AS (
  SELECT raw.doc_id, raw.line_no, raw.line, m.doc_id IS NOT NULL AS counted, coalesce(m.is_exact, 0) AS is_exact, coalesce(m.is_near, 0) AS is_near
  FROM raw LEFT JOIN marked m ON m.doc_id = raw.doc_id AND m.line_no = raw.line_no
),
t AS (
  SELECT doc_id, count(*) FILTER (WHERE counted) AS n_lines, sum(is_exact) AS n_exact, sum(is_near) AS n_near,
         string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE is_exact + is_near = 0) AS text
  FROM j GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(t.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(t.n_exact, 0) AS BIGINT) AS n_exact, CAST(coalesce(t.n_near, 0) AS BIGINT) AS n_near,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text
FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id
"""
