"""Readers of the input tables and the views of them that stand for images, signals, spectra and catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def pixels(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """image, r, g, b in 0 to 1, one row a pixel, with further columns of its table."""
    df = table(spark, sf_dir, "lineitem")
    return df.select(
        F.col("l_suppkey").alias("image"),
        _unit(F.col("l_quantity") / 50).alias("r"),
        _unit(1 - 10 * F.col("l_discount")).alias("g"),
        _unit(F.col("l_tax") / 0.08).alias("b"),
        *more,
    )


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, id (unique, in order) and x in 0 to 1: a one-dimensional signal for each user, of whom more events have more."""
    df = table(spark, sf_dir, "events")
    return df.select(F.col("user_id").alias("image"), F.col("event_id").alias("id"), F.least(F.col("value") / 500, F.lit(1.0)).alias("x"))


#: Rows and columns of a frame.
HEIGHT, WIDTH = 7, 31


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, y, x and v in 0 to 1: images of HEIGHT x WIDTH pixels, the mean of what falls on a pixel; empty ones are absent."""
    df = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("image"), (F.col("l_linenumber") - 1).alias("y"), F.pmod("l_partkey", F.lit(WIDTH)).cast("int").alias("x"), "l_quantity")
    return df.groupBy("image", "y", "x").agg((F.avg("l_quantity") / 50).alias("v"))


def full_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`frames` with every pixel: an absent one has its image's mean."""
    some = frames(spark, sf_dir)
    every = some.groupBy("image").agg(F.avg("v").alias("m")).select("image", "m", F.explode(F.sequence(F.lit(0), F.lit(HEIGHT - 1))).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))).alias("x"))
    return every.join(some, ["image", "y", "x"], "left").select("image", "y", "x", F.coalesce("v", "m").alias("v"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, dir and name of files in folders two levels deep."""
    ends = F.array(*map(F.lit, (".JPG", ".RAF", ".jpg", ".dng", ".tif", ".txt")))
    df = table(spark, sf_dir, "part")
    name = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("_"), F.call_function("div", F.col("p_partkey"), F.lit(2)).cast("string"), F.get(ends, F.pmod("p_size", F.lit(6))))
    return df.select(F.col("p_partkey").alias("file_id"), F.concat(F.lit("D:/Lib/"), "p_brand", F.lit("/"), "p_type", F.lit("/")).alias("dir"), name.alias("name"))


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, family and bands: vectors that stand for spectra."""
    df = table(spark, sf_dir, "embeddings")
    return df.select(F.col("vec_id").alias("name"), F.col("label").alias("family"), F.col("embedding").cast("array<double>").alias("bands"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rel, bucket, priority and seq: several forms of one key in buckets."""
    df = table(spark, sf_dir, "orders")
    return df.select(F.col("o_custkey").alias("rel"), F.col("o_orderpriority").alias("bucket"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.col("o_orderkey").alias("seq"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rel and star (1 to 5); keys without a rating have no row."""
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rel"), (F.pmod("c_custkey", F.lit(7)) - 1).cast("int").alias("star"))
    return df.where("star > 0")


#: The same views as SQL.
PX = "px AS (SELECT l_suppkey AS image, least(greatest(l_quantity / 50, 0.0), 1.0) AS r, least(greatest(1 - 10 * l_discount, 0.0), 1.0) AS g, least(greatest(l_tax / 0.08, 0.0), 1.0) AS b FROM lineitem)"
SIG = "sig AS (SELECT user_id AS image, event_id AS id, least(value / 500, 1.0) AS x FROM events)"
FRAME = "frame AS (SELECT l_suppkey AS image, l_linenumber - 1 AS y, CAST(l_partkey % 31 AS INT) AS x, avg(l_quantity) / 50 AS v FROM lineitem GROUP BY 1, 2, 3)"
FULL = FRAME + ", lines AS (SELECT unnest(range(0, 7)) AS y), places AS (SELECT unnest(range(0, 31)) AS x), whole AS (SELECT m.image, lines.y, places.x, coalesce(f.v, m.m) AS v FROM (SELECT image, avg(v) AS m FROM frame GROUP BY image) m, lines, places LEFT JOIN frame f ON f.image = m.image AND f.y = lines.y AND f.x = places.x)"
FILES = "files AS (SELECT p_partkey AS file_id, 'D:/Lib/' || p_brand || '/' || p_type || '/' AS dir, replace(p_name, ' ', '_') || '_' || CAST(p_partkey // 2 AS VARCHAR) || (['.JPG', '.RAF', '.jpg', '.dng', '.tif', '.txt'])[p_size % 6 + 1] AS name FROM part)"
SPEC = "spec AS (SELECT vec_id AS name, label AS family, CAST(embedding AS DOUBLE[]) AS bands FROM embeddings)"
CAT = "cat AS (SELECT o_custkey AS rel, o_orderpriority AS bucket, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, o_orderkey AS seq FROM orders)"
RATE = "rate AS (SELECT c_custkey AS rel, CAST(c_custkey % 7 - 1 AS INTEGER) AS star FROM customer WHERE c_custkey % 7 - 1 > 0)"
