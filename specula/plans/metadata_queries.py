"""Metadata bytes: directories of tags found and read, from bytes that are made of a given table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specula.functions import directories as D
from specula.plans.registry import query
from specula.sources.tables import table


def _number(n: Column, width: int, little: Column) -> Column:
    """A number as hexadecimal text in either order of bytes."""
    text = F.lpad(F.hex(n.cast("bigint")), 2 * width, "0")
    cut = [text.substr(F.lit(2 * k + 1), F.lit(2)) for k in range(width)]
    return F.when(little, F.concat(*reversed(cut))).otherwise(F.concat(*cut))


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey and bytes: a JPEG's head for each part, with another segment before the metadata in some, bytes of either
    order, and in some a wrong mark, an end within the first directory, or no metadata at all."""
    # rows are few bytes and much work: as they are read, a few tasks would have them all
    p = table(spark, sf_dir, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    key, little = F.col("p_partkey"), F.col("p_partkey") % 2 == 0
    u16, u32 = (lambda n: _number(n, 2, little)), (lambda n: _number(n, 4, little))
    lit = lambda n: F.lit(n)
    make = F.concat(F.hex(F.encode("p_brand", "UTF-8")), F.lit("00"))
    length = (F.length(make) / 2).cast("int")
    entry = lambda tag, kind, count, value, wide: F.concat(u16(lit(tag)), u16(lit(kind)), u32(count), u32(value) if wide else F.concat(u16(value), F.lit("0000")))
    # places from the header: 8 the first directory of 4 entries, 58 the second of 3, 96 the ratio, 104 the text
    first = F.concat(u16(lit(4)), entry(0x0112, 3, lit(1), F.col("p_size") % 8 + 1, False), entry(0x010F, 2, length, lit(104), True), entry(0x8769, 4, lit(1), lit(58), True), entry(0x9999, 4, lit(1), key, True))
    second = F.concat(u16(lit(3)), entry(0x8827, 3, lit(1), F.col("p_size") * 100, False), entry(0x829D, 5, lit(1), lit(96), True), entry(0x9204, 3, lit(1), F.lit(65536) - F.col("p_size"), False))
    head = F.concat(F.when(little, "4949").otherwise("4D4D"), u16(F.when(key % 17 == 3, 43).otherwise(42)), u32(lit(8)))
    body = F.concat(head, first, second, u32(F.round(F.col("p_retailprice")).cast("bigint")), u32(key % 5 * 10), make)
    body = F.when(key % 13 == 5, body.substr(F.lit(1), F.lit(2 * (8 + 2 + 12 + 6)))).otherwise(body)
    segment = F.concat(F.lit("FFE1"), F.lpad(F.hex((F.length(body) / 2 + 8).cast("bigint")), 4, "0"), F.lit("457869660000"), body)
    other = F.when(key % 3 == 0, F.lit("FFE00006ABCDEF01")).otherwise(F.lit(""))
    return p.select("p_partkey", F.unhex(F.concat(F.lit("FFD8"), other, F.when(key % 19 == 7, F.lit("FFE20004AAAA")).otherwise(segment), F.lit("FFDA0000"))).alias("bytes"))


@query(
    """WITH p AS (SELECT *, p_partkey % 13 = 5 AS cut FROM part WHERE p_partkey % 19 <> 7 AND p_partkey % 17 <> 3)
SELECT p_partkey, 'orientation' AS name, CAST(p_size % 8 + 1 AS DOUBLE) AS number, '' AS text FROM p UNION ALL SELECT p_partkey, 'make', -1.0, p_brand FROM p WHERE NOT cut
UNION ALL SELECT p_partkey, 'iso', p_size * 100.0, '' FROM p WHERE NOT cut UNION ALL SELECT p_partkey, 'bias', -1.0 * p_size, '' FROM p WHERE NOT cut
UNION ALL SELECT p_partkey, 'fnum', round(CASE WHEN p_partkey % 5 = 0 THEN 0.0 ELSE round(p_retailprice) / (p_partkey % 5 * 10) END, 8), '' FROM p WHERE NOT cut"""
)
def ifd_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known tags of each picture's bytes; bytes that can't be read give no rows. A map over rows that are dealt out before."""
    df = D.with_values(D.with_start(pictures(spark, sf_dir), "bytes", "start"), "bytes", "start", "values")
    # of explode Spark would infer a filter and push it, with the whole expression, through every step above
    v = df.select("p_partkey", F.explode_outer("values").alias("v")).where("v.name IS NOT NULL")
    return v.select("p_partkey", "v.name", F.round(F.coalesce("v.number", F.lit(-1.0)), 8).alias("number"), F.coalesce("v.text", F.lit("")).alias("text"))
