"""Targets kept as documents, and the layers of a request: default, own, shared and scene values, later ones winning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specula.plans.registry import query
from specula.sources.tables import table

#: Names of the common documents, the fields of skin, and the axes of a scene in the order they win.
DEFAULT, SHARED, SCENE = "_default", "_skin_shared", "_scene"
SKIN = ("skin_l", "skin_c", "skin_hue", "skin_n")
AXES = ("exp", "span", "back", "shot", "face", "overwhite")
NUMBERS = ("n", "black_shape", "hi_shape", "sat", *SKIN)
SCHEMA = f"who STRING, {', '.join(f'{f} DOUBLE' for f in NUMBERS)}, sh ARRAY<DOUBLE>, hi ARRAY<DOUBLE>, band_gain ARRAY<DOUBLE>, skin_own BOOLEAN, _bad STRING"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name and body: a JSON document of several lines for each brand of the parts, the common ones, and one for each value
    of a scene's axes; fields are absent where parts say nothing, and every ninth brand's text is cut off."""
    part = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name"))
    size, price = F.avg("p_size"), F.avg("p_retailprice")
    of = part.agg(F.count(F.lit(1)).cast("double").alias("n"), F.round(-size, 3).alias("black_shape"), F.round(size / 2, 3).alias("hi_shape"), F.round(price / 1000, 3).alias("sat"), F.round(price / 500, 3).alias("skin_l"), F.round(50 + size / 10, 3).alias("skin_hue"), F.conv(F.regexp_extract("name", r"(\d+)$", 1), 10, 10).cast("int").alias("no"))
    some = lambda c, every: F.when(F.col("no") % every > 0, F.col(c)).alias(c)
    gains = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.round(-k * F.col("sat") / 100, 3)).alias("band_gain")
    body = F.to_json(F.struct(F.concat(F.lit("of "), "name").alias("who"), "n", "black_shape", some("hi_shape", 2), some("sat", 3), "skin_l", some("skin_hue", 5), (F.col("no") % 4 == 0).alias("skin_own"), F.array(F.col("sat"), -F.col("sat")).alias("sh"), gains), {"pretty": "true"})
    brands = of.select("name", F.when(F.col("no") % 9 == 4, F.substring(body, 1, 40)).otherwise(body).alias("body"))
    common = spark.createDataFrame(
        [
            (DEFAULT, '{"who": "all",\n "n": 112, "black_shape": -53.1, "hi_shape": 31.8, "sat": 1.0,\n "skin_l": 9.4, "skin_c": 2.91, "skin_hue": 54.8, "skin_n": 20, "sh": [-1.2, 2.0], "hi": [-0.4, -0.5]}'),
            (SHARED, '{"skin_l": 4.0,\n "skin_hue": 54.75, "skin_n": 32}'),
            (f"{SCENE}/exp=dark", '{"black_shape": -60.0}'),
            (f"{SCENE}/exp=*", '{"sat": 0.9}'),
            (f"{SCENE}/back=behind", '{"hi_shape": 20.0,\n "skin_l": 6.5}'),
            (f"{SCENE}/overwhite=yes", '{"hi_shape": 12.0}'),
        ],
        "name string, body string",
    )
    return brands.unionByName(common)


def parsed(docs: DataFrame) -> DataFrame:
    """The documents' fields by a fixed schema; a text that is no document is a row with its text in ``_bad``."""
    return docs.select("name", F.from_json("body", SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "multiLine": "true"}).alias("d")).select("name", "d.*")


def layers(docs: DataFrame) -> DataFrame:
    """name, fields (map of the numbers that a document has) and skin_own, of sound documents; a null text is none."""
    fields = F.map_filter(F.create_map(*[x for f in NUMBERS for x in (F.lit(f), F.col(f))]), lambda k, v: v.isNotNull())
    return parsed(docs.where("body IS NOT NULL")).where("_bad IS NULL").select("name", fields.alias("fields"), F.coalesce("skin_own", F.lit(False)).alias("skin_own"))


def resolved(requests: DataFrame, docs: DataFrame, axes: list[str]) -> DataFrame:
    """``requests`` (request, name and a column for each of ``axes``) with fields, own (the name has a document) and hits.

    Values of the default give way to the name's own, these to the shared ones of skin unless the document keeps its
    own, and all to the scene's: axis by axis in a fixed order, an axis' own value before its any-value document. A
    request asks for a handful of documents by name, joined and put together by rank.
    """
    asked = [F.struct(F.lit(0).alias("rank"), F.lit(DEFAULT).alias("doc")), F.struct(F.lit(1).alias("rank"), F.col("name").alias("doc")), F.struct(F.lit(2).alias("rank"), F.lit(SHARED).alias("doc"))]
    for k, a in enumerate(x for x in AXES if x in axes):
        for j, v in enumerate((F.col(a), F.lit("*"))):
            asked.append(F.when(F.col(a).isNotNull(), F.struct(F.lit(3 + 2 * k + j).alias("rank"), F.concat(F.lit(f"{SCENE}/{a}="), v).alias("doc"))))
    of = requests.select("request", "name", F.explode(F.array_compact(F.array(*asked))).alias("a")).select("request", "name", "a.rank", "a.doc")
    found = of.join(layers(docs).withColumnRenamed("name", "doc"), "doc", "left")
    got = found.groupBy("request", "name").agg(F.array_sort(F.collect_list(F.when(F.col("fields").isNotNull(), F.struct("rank", F.map_entries("fields").alias("e"), "skin_own", "doc")))).alias("l"))
    keeps = F.exists("l", lambda x: (x["rank"] == 1) & x["skin_own"])

    def laid(low: Column, x: Column) -> Column:
        top = F.map_from_entries(x["e"])
        top = F.when((x["rank"] == 2) & F.col("keeps"), F.map_filter(top, lambda k, v: F.lit(False))).when(x["rank"] == 2, F.map_filter(top, lambda k, v: k.isin(*SKIN))).otherwise(top)
        return F.map_zip_with(low, top, lambda k, a, b: F.coalesce(b, a))

    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    out = got.withColumn("keeps", keeps)
    hits = F.transform(F.filter("l", lambda x: x["rank"] > 2), lambda x: F.substring_index(x["doc"], "/", -1))
    return out.select("request", "name", F.aggregate("l", none, laid).alias("fields"), F.exists("l", lambda x: x["rank"] == 1).alias("own"), hits.alias("hits"))


_BRANDS = """part_ AS (SELECT p_brand AS name, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INT) AS no, CAST(count(*) AS DOUBLE) AS n, round(-avg(p_size), 3) AS black_shape, round(avg(p_size) / 2, 3) AS hi, round(avg(p_retailprice) / 1000, 3) AS s, round(avg(p_retailprice) / 500, 3) AS skin_l, round(50 + avg(p_size) / 10, 3) AS hue FROM part GROUP BY 1),
own AS (SELECT name, no % 9 = 4 AS bad, n, black_shape, CASE WHEN no % 2 > 0 THEN hi END AS hi_shape, CASE WHEN no % 3 > 0 THEN s END AS sat, s, skin_l, CASE WHEN no % 5 > 0 THEN hue END AS skin_hue, no % 4 = 0 AS keeps FROM part_)"""


@query(
    f"""WITH {_BRANDS}, all_ AS (SELECT name, bad, n, hi_shape, sat, skin_hue, CASE WHEN NOT bad THEN keeps END AS skin_own, CASE WHEN NOT bad THEN round(-11 * s / 100, 3) END AS last_gain, CASE WHEN NOT bad THEN -s END AS shade FROM own
UNION ALL SELECT * FROM (VALUES ('{DEFAULT}', false, 112.0, 31.8, 1.0, 54.8, NULL, NULL, 2.0), ('{SHARED}', false, NULL, NULL, NULL, 54.75, NULL, NULL, NULL), ('{SCENE}/exp=dark', false, NULL, NULL, NULL, NULL, NULL, NULL, NULL), ('{SCENE}/exp=*', false, NULL, NULL, 0.9, NULL, NULL, NULL, NULL), ('{SCENE}/back=behind', false, NULL, 20.0, NULL, NULL, NULL, NULL, NULL), ('{SCENE}/overwhite=yes', false, NULL, 12.0, NULL, NULL, NULL, NULL, NULL)) t(a, b, c, d, e, f, g, h, i))
SELECT name, bad, CASE WHEN NOT bad THEN n END AS n, CASE WHEN NOT bad THEN hi_shape END AS hi_shape, CASE WHEN NOT bad THEN sat END AS sat, CASE WHEN NOT bad THEN skin_hue END AS skin_hue, coalesce(skin_own, false) AS skin_own, last_gain, shade FROM all_"""
)
def targets_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of several lines by a fixed schema, broken ones as rows."""
    d = parsed(documents(spark, sf_dir)).withColumn("bad", F.col("_bad").isNotNull())
    sound = lambda c: F.when(~F.col("bad"), c)
    return d.select("name", "bad", *[sound(F.col(c)).alias(c) for c in ("n", "hi_shape", "sat", "skin_hue")], F.coalesce(sound(F.col("skin_own")), F.lit(False)).alias("skin_own"), sound(F.get("band_gain", F.lit(11))).alias("last_gain"), sound(F.get("sh", F.lit(1))).alias("shade"))


_REQUESTS = "req AS (SELECT c_custkey AS request, CASE WHEN c_nationkey % 10 = 0 THEN 'Brand#99' ELSE 'Brand#' || (1 + c_nationkey % 5) || (1 + c_custkey % 5) END AS name, CASE WHEN c_acctbal < 0 THEN 'dark' WHEN c_acctbal < 5000 THEN 'normal' END AS exp, CASE WHEN c_mktsegment = 'BUILDING' THEN 'behind' ELSE 'front' END AS back, CASE WHEN c_acctbal > 9000 THEN 'yes' ELSE 'no' END AS overwhite FROM customer)"


@query(
    f"""WITH {_BRANDS}, {_REQUESTS}, j AS (SELECT request, req.name, exp, back, overwhite, own.name IS NOT NULL AS own, coalesce(keeps, false) AS keeps, black_shape, hi_shape, sat, skin_l, skin_hue FROM req LEFT JOIN own ON own.name = req.name AND NOT bad)
SELECT request, name, own, CASE WHEN exp = 'dark' THEN -60.0 ELSE coalesce(black_shape, -53.1) END AS black_shape, CASE WHEN overwhite = 'yes' THEN 12.0 WHEN back = 'behind' THEN 20.0 ELSE coalesce(hi_shape, 31.8) END AS hi_shape, CASE WHEN exp IS NOT NULL THEN 0.9 ELSE coalesce(sat, 1.0) END AS sat,
CASE WHEN back = 'behind' THEN 6.5 WHEN keeps THEN skin_l ELSE 4.0 END AS skin_l, 2.91 AS skin_c, CASE WHEN keeps THEN coalesce(skin_hue, 54.8) ELSE 54.75 END AS skin_hue, CASE WHEN keeps THEN 20.0 ELSE 32.0 END AS skin_n,
concat_ws(',', CASE WHEN exp = 'dark' THEN 'exp=dark' END, CASE WHEN exp IS NOT NULL THEN 'exp=*' END, CASE WHEN back = 'behind' THEN 'back=behind' END, CASE WHEN overwhite = 'yes' THEN 'overwhite=yes' END) AS hits FROM j"""
)
def targets_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that hold for each request, from documents in layers."""
    c = table(spark, sf_dir, "customer")
    name = F.when(F.col("c_nationkey") % 10 == 0, "Brand#99").otherwise(F.concat(F.lit("Brand#"), 1 + F.col("c_nationkey") % 5, 1 + F.col("c_custkey") % 5))
    exp = F.when(F.col("c_acctbal") < 0, "dark").when(F.col("c_acctbal") < 5000, "normal")
    requests = c.select(F.col("c_custkey").alias("request"), name.alias("name"), exp.alias("exp"), F.when(F.col("c_mktsegment") == "BUILDING", "behind").otherwise("front").alias("back"), F.when(F.col("c_acctbal") > 9000, "yes").otherwise("no").alias("overwhite"))
    out = resolved(requests, documents(spark, sf_dir), ["exp", "back", "overwhite"])
    return out.select("request", "name", "own", *[F.col("fields")[f].alias(f) for f in ("black_shape", "hi_shape", "sat", *SKIN)], F.array_join("hits", ",").alias("hits"))
