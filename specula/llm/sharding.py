"""Shards of nearly equal bytes by K-d tree partitioning.

The tree starts with all documents and the number of shards. A node of k shards is cut in two, k // 2 of them
going left, at the point of the widest metadata dimension where the left side has its share of the bytes: a
weighted median. Dimensions are numbers, scaled to 0 to 1 over the table: length, language and mean word length,
which copies of a text share. Which is widest is its spread inside the node. Documents that tie in it are told
apart by a hash of their text, then by one of doc_id and of a row's number among rows equal to it, so that copies
keep together as long as the law, equal bytes, allows, and a group of any size may be cut, rows repeated whole too.
Such rows are numbered without gathering them: equal ones are counted, and the counts are laid out again in runs.

Medians are found by counting, not sorting: all nodes of a level sum their bytes in 1,024 bins of the ordering
key, the driver reads that small table and narrows each node to one bin, until a bin is under 1/2000 of a shard or
a single key. What reaches the driver is nodes x bins, whatever the data's size. The slot of a row in its shard is
the count of the chunks before it, plus its place in its own chunk; chunks are made by a hash of text, doc_id and
number and hold about 250,000 rows each, so no shard needs to be sorted in one task.

Defined results: a null text has no bytes (size 8) and the checksum of the empty text; null language or source is
the value below all; rows that repeat, doc_id included (or null), are told apart by their number, may come into
several shards and take separate slots; an empty table gives no rows; further columns are dropped by the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from specula.llm.common import drop_written, partitions, table, text_or_empty, written

BINS = 1024
TIE_BITS = 40  # of the ordering key, below 22 bits of the dimension's value
OWN_BITS = 16  # of these, for what tells copies of a text apart


def ordering_key(value, tie):
    """62 bits: the dimension's value on 22 bits, then 40 bits that tell ties apart."""
    scaled = F.least(F.greatest((value * ((1 << 22) - 1)).cast("bigint"), F.lit(0)), F.lit((1 << 22) - 1))
    return F.shiftleft(scaled, TIE_BITS).bitwiseOR(tie)


def by_node(values: dict[int, object]):
    """For each row the value of its node."""
    out = None
    for node, v in values.items():
        v = v if isinstance(v, Column) else F.lit(v)
        out = F.when(F.col("node") == node, v) if out is None else out.when(F.col("node") == node, v)
    return out


def assign(rows: DataFrame, dims: list[str], size: str, tie: str, shards: int, slack: float = 0.0005) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1). ``dims``: columns in 0 to 1; ``tie``: a long of TIE_BITS bits.

    The rows are written anew with their node at each of the log2(shards) levels.
    """
    keys = {d: f"key_{d}" for d in dims}
    df = written(rows.withColumns({k: ordering_key(F.col(d), F.col(tie)) for d, k in keys.items()}).drop(*dims, tie).withColumn("node", F.lit(0)), "tree")
    fine = max(1, int((df.agg(F.sum(size)).first()[0] or 0) / shards * slack))
    nodes, made = {0: (0, shards)}, 1  # node: its first shard, its shards
    while any(k > 1 for _, k in nodes.values()):
        ends = (f(F.col(k)).alias(f"{end}_{d}") for d, k in keys.items() for end, f in (("lo", F.min), ("hi", F.max)))
        stats = {r["node"]: r for r in df.groupBy("node").agg(F.sum(size).alias("w"), *ends).collect()}
        cuts = {}
        for n, (_, k) in nodes.items():
            if k > 1 and n in stats:
                s = stats[n]
                dim = max(dims, key=lambda d: (s[f"hi_{d}"] - s[f"lo_{d}"], -dims.index(d)))
                cuts[n] = {"key": keys[dim], "lo": s[f"lo_{dim}"], "hi": s[f"hi_{dim}"], "below": 0, "goal": s["w"] * (k // 2) / k, "cut": None}
        while todo := {n: c for n, c in cuts.items() if c["cut"] is None}:
            for c in todo.values():
                c["step"] = max(1, -(-(c["hi"] - c["lo"] + 1) // BINS))
            key, lo, hi, step = (by_node({n: F.col(c[x]) if x == "key" else c[x] for n, c in todo.items()}) for x in ("key", "lo", "hi", "step"))
            ranged = df.select("node", size, key.alias("key"), lo.alias("lo"), hi.alias("hi"), step.alias("step")).where("key between lo and hi")
            found: dict[int, list] = {}
            for r in ranged.groupBy("node", F.expr("(key - lo) div step").alias("bin")).agg(F.sum(size).alias("w")).collect():
                found.setdefault(r["node"], []).append((r["bin"], r["w"]))
            for n, c in todo.items():
                below = c["below"]
                for at, w in sorted(found[n]):
                    if below + w >= c["goal"]:
                        break
                    below += w
                first = c["lo"] + at * c["step"]
                last = min(c["hi"], first + c["step"] - 1)
                if first == last or w <= fine:
                    c["cut"] = last if below + w - c["goal"] <= c["goal"] - below else first - 1
                else:
                    c |= {"lo": first, "hi": last, "below": below}
        moves, after = {}, {}
        for n, (first, k) in nodes.items():
            if n in cuts:
                moves[n] = F.when(F.col(cuts[n]["key"]) <= cuts[n]["cut"], made).otherwise(made + 1)
                after |= {made: (first, k // 2), made + 1: (first + k // 2, k - k // 2)}
                made += 2
            elif k == 1:  # what has no rows needs no shards
                after[n] = (first, k)
        nodes = after
        if moves:
            new = written(df.withColumn("node", F.coalesce(by_node(moves), F.col("node"))), "tree")
            drop_written(df)
            df = new
    shard = by_node({n: first for n, (first, _) in nodes.items()}) if nodes else F.lit(0)
    return df.withColumn("shard", shard.cast("int")).drop("node", *keys.values())


def slots(rows: DataFrame, by: str, order: list[str], chunk_rows: int = 250_000) -> DataFrame:
    """``rows`` with ``slot``, gapless from 0 in each value of ``by``."""
    n = rows.count()
    chunked = rows.withColumn("chunk", F.pmod(F.xxhash64(*order), F.lit(max(1, -(-n // chunk_rows) * 4))).cast("int"))
    counts = chunked.groupBy(by, "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(by, "chunk", (F.sum("n").over(Window.partitionBy(by).orderBy("chunk")) - F.col("n")).alias("before"))
    placed = chunked.withColumn("place", F.row_number().over(Window.partitionBy(by, "chunk").orderBy(*order)))
    return placed.join(before, [by, "chunk"]).withColumn("slot", F.col("before") + F.col("place") - 1).drop("chunk", "place", "before")


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, copy, size, text_crc32, the raw dimensions and the tie of each document."""
    text = F.encode(text_or_empty(), "UTF-8")
    head = F.rpad(F.substring(F.hex(F.encode(F.coalesce(F.col("lang"), F.lit("")), "UTF-8")), 1, 12), 12, "0")
    spaces = F.length(text_or_empty()) - F.length(F.replace(text_or_empty(), F.lit(" ")))
    of_each = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.log2(F.octet_length(text) + 8.0).alias("length"),
        F.conv(head, 16, 10).cast("double").alias("language"),
        F.log2(F.length(text_or_empty()) / (spaces + 1) + 1.0).alias("word_length"),
        F.xxhash64(text_or_empty()).alias("text_hash"),
    )
    return numbered(of_each)


def numbered(rows: DataFrame, run: int = 10_000) -> DataFrame:
    """``rows`` with ``copy``, from 0 among equal rows, and ``tie``: bits of text_hash, then of doc_id and copy.

    Equal rows are counted, partial counts first; counts come back as runs of ``run`` rows, which are dealt out anew.
    """
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    runs = counted.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(run).cast("bigint"))))
    dealt = runs.repartition(partitions(rows), F.xxhash64("doc_id", "text_hash", "_from"))
    every = dealt.withColumn("copy", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + run, F.col("_n")) - 1))).drop("_from", "_n")
    of_text = F.shiftrightunsigned("text_hash", 64 - TIE_BITS + OWN_BITS)
    own = F.shiftrightunsigned(F.xxhash64("doc_id", "copy"), 64 - OWN_BITS)
    return every.withColumn("tie", F.shiftleft(of_text, OWN_BITS).bitwiseOR(own)).drop("text_hash")


def scaled(rows: DataFrame, dims: list[str]) -> DataFrame:
    """The dimensions brought to 0 to 1."""
    ends = rows.agg(*(F.min(d).alias(f"lo_{d}") for d in dims), *(F.max(d).alias(f"hi_{d}") for d in dims)).first()
    width = lambda d: (ends[f"hi_{d}"] or 0) - (ends[f"lo_{d}"] or 0) or 1.0
    return rows.withColumns({d: (F.col(d) - F.lit(ends[f"lo_{d}"] or 0.0)) / F.lit(float(width(d))) for d in dims})


def op9_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = ["length", "language", "word_length"]
    kept = written(metadata(table(spark, sf_dir, "documents")), "shard-metadata")
    placed = assign(scaled(kept, dims), dims, "size", "tie", 24)
    drop_written(kept)
    out = slots(placed.select("doc_id", "copy", "size", "text_crc32", "shard"), "shard", ["text_crc32", "doc_id", "copy"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
