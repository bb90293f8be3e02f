"""Directories of tagged values inside bytes, as pictures' metadata has them: columns beside a binary column.

Everything is read by offsets from the bytes; what lies beyond the bytes is null, and an entry with a
null gives no value. Walks are bounded by the bytes' length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of the tags that are read, by number.
TAGS = {0x010F: "make", 0x0110: "model", 0x0112: "orientation", 0x829A: "exp", 0x829D: "fnum", 0x8827: "iso", 0x9003: "dt", 0x9204: "bias", 0x9209: "flash", 0x920A: "focal", 0xA002: "pxX", 0xA003: "pxY", 0xA403: "wb", 0xA408: "k", 0xA434: "lens"}
#: The tag that points to a second directory; kinds of values: text, 16 bits, 32 bits, a ratio of 32 bits.
SECOND, TEXT, SHORT, LONG, RATIO = 0x8769, 2, 3, 4, 5


def _reversed(hex_: Column) -> Column:
    """Bytes in reverse order, of hexadecimal text."""
    return F.unhex(F.regexp_replace(F.reverse(hex_), "(.)(.)", "$2$1"))


class Bytes:
    """Numbers and texts at places of the column ``column``, null beyond its end; ``_size`` is its length.

    A number is one cut: where the order of bytes is little, from ``_view``, the bytes in reverse order.
    """

    def __init__(self, column: str, little: Column | None = None):
        self.bytes, self.size, self.little = F.col(column), F.col("_size"), little

    def number(self, at: Column, width: int) -> Column:
        view = self.bytes if self.little is None else F.col("_view")
        begin = at if self.little is None else F.when(self.little, self.size - width - at).otherwise(at)
        cut = F.substring(view, (begin + 1).cast("int"), F.lit(width))
        return F.when((at >= 0) & (at + width <= self.size), F.conv(F.hex(cut), 16, 10).cast("bigint"))

    def signed(self, at: Column, width: int) -> Column:
        n = self.number(at, width)
        return F.when(n >= 1 << (8 * width - 1), n - (1 << (8 * width))).otherwise(n)

    def text(self, at: Column, count: Column) -> Column:
        """Up to ``count`` bytes, no further than the first zero byte."""
        part = F.when((at >= 0) & (at < self.size), F.hex(F.substring(self.bytes, (at + 1).cast("int"), F.least(count, self.size - at).cast("int"))))
        whole = F.regexp_extract(part, "^((?:(?!00)..)*)", 1)
        return F.when(count > 0, F.unhex(whole).cast("string"))


def with_start(df: DataFrame, jpeg: str, to: str) -> DataFrame:
    """``df`` with ``to``: where the directory's header begins in a JPEG's bytes, after its segment's own; null if there is none.

    Segments are walked one by one, at most as many steps as fit into the bytes.
    """
    b = Bytes(jpeg)
    state = lambda at, found: F.struct(at.cast("bigint").alias("at"), found.cast("bigint").alias("found"))
    over = F.lit(-1)

    def step(s: Column, _: Column) -> Column:
        at, marker, size = s["at"], b.number(s["at"], 2), b.number(s["at"] + 2, 2)
        first = b.number(at, 1)
        is_exif = (marker == 0xFFE1) & (size > 8) & (b.number(at + 4, 4) == 0x45786966) & (b.number(at + 8, 2) == 0)
        no_length = (marker == 0xFFD8) | ((marker >= 0xFFD0) & (marker <= 0xFFD7))
        to = F.when(first != 0xFF, at + 1).when(marker == 0xFFDA, over).when(no_length, at + 2).when(size < 2, over).otherwise(at + 2 + size)
        return F.when(s["found"].isNotNull() | (at < 0) | (at + 4 > b.size), s).when((first == 0xFF) & is_exif, state(at, at + 10)).otherwise(state(to, F.lit(None)))

    out = df.withColumn("_size", F.length(jpeg))
    walk = F.aggregate(F.sequence(F.lit(0), F.coalesce("_size", F.lit(0))), state(F.lit(2), F.lit(None)), step)["found"]
    return out.withColumn(to, F.when((b.size >= 8) & (b.number(F.lit(0), 2) == 0xFFD8), walk)).drop("_size")


def _entries(b: Bytes, begin: Column) -> Column:
    """Entries of one directory: tag, kind, count and the place of the value's field; those cut off at the end are left out."""
    n = F.coalesce(b.number(begin, 2), F.lit(0))
    places = F.when(n > 0, F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda k: begin + 2 + k * 12)).otherwise(F.array().cast("array<bigint>"))
    inside = F.filter(places, lambda e: e + 12 <= b.size)
    return F.transform(inside, lambda e: F.struct(b.number(e, 2).alias("tag"), b.number(e + 2, 2).alias("kind"), b.number(e + 4, 4).alias("count"), (e + 8).alias("at")))


def with_values(df: DataFrame, column: str, start: str, to: str) -> DataFrame:
    """``df`` with ``to``: name, number and text of the known tags of the directory at ``start`` and of the one that it points to.

    Both byte orders; bytes without the header's mark give null; of a tag that repeats the last counts.
    """
    b = Bytes(column, F.col("_little"))
    at = F.col(start)
    out = df.withColumn("_size", F.length(column)).withColumn("_order", F.hex(F.substring(column, (at + 1).cast("int"), F.lit(2)))).withColumn("_little", F.col("_order") == "4949")
    out = out.withColumn("_view", F.when(F.col("_little"), _reversed(F.hex(column))).otherwise(F.col(column)))
    out = out.withColumn("_begin", F.when(F.col("_order").isin("4949", "4D4D") & (b.number(at + 2, 2) == 42), at + b.number(at + 4, 4)))
    out = out.withColumn("_first", _entries(b, F.col("_begin")))
    pointer = F.get(F.filter("_first", lambda e: (e["tag"] == SECOND) & (e["kind"] == LONG)), F.lit(0))
    out = out.withColumn("_pointer", pointer["at"]).withColumn("_begin2", at + b.number(F.col("_pointer"), 4))
    out = out.withColumn("_all", F.concat("_first", _entries(b, F.col("_begin2"))))
    names = F.create_map(*[x for k, v in TAGS.items() for x in (F.lit(k).cast("bigint"), F.lit(v))])
    fields = lambda e: F.struct(e["kind"].alias("kind"), e["count"].alias("count"), e["at"].alias("at"), F.try_element_at(names, e["tag"]).alias("name"), (at + b.number(e["at"], 4)).alias("far"))
    out = out.withColumn("_all", F.filter(F.transform("_all", fields), lambda e: e["name"].isNotNull()))
    is_text = lambda e: e["name"].isin("make", "model", "dt", "lens")

    def of(e: Column) -> Column:
        above, below = b.number(e["far"], 4), b.number(e["far"] + 4, 4)
        number = F.when(is_text(e), None).when(e["kind"] == RATIO, F.when(below == 0, 0.0).otherwise(above / below))
        number = number.when((e["kind"] == SHORT) & (e["name"] == "bias"), b.signed(e["at"], 2).cast("double")).when(e["kind"] == SHORT, b.number(e["at"], 2).cast("double")).when(e["kind"] == LONG, b.number(e["at"], 4).cast("double"))
        return F.struct(e["name"].alias("name"), number.alias("number"), F.when(is_text(e) & (e["kind"] == TEXT), b.text(e["far"], e["count"])).alias("text"))

    out = out.withColumn("_found", F.filter(F.transform("_all", of), lambda v: v["number"].isNotNull() | v["text"].isNotNull()))
    last = F.filter("_found", lambda v, k: ~F.exists(F.slice("_found", k + 2, F.size("_found")), lambda w: w["name"] == v["name"]))
    return out.withColumn(to, F.when(F.col("_begin").isNotNull(), last)).select(*df.columns, to)
