"""Helpers that the training-data operators share: written tables, and readers of the input tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN: dict[str, str | None] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent on one machine (tests) a folder is made for the application; on a cluster that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = _OWN.setdefault(spark.sparkContext.applicationId, None) or "file://" + tempfile.mkdtemp(prefix="specula-shared-")
        _OWN[spark.sparkContext.applicationId] = where
    return where.rstrip("/")


#: Spark's setting by which a finished query's shuffle files are deleted at once.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage is cut and lost executors lose nothing.

    Nothing else reads the shuffle files of this write, so Spark is told to delete them when it is done.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/specula/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before) if before is not None else spark.conf.unset(CLEAN)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the table behind a result of :func:`written` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame) -> int:
    """Shuffle partitions of the session; they are the cluster's to choose."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def texts_of(batch, column: str) -> Iterator[str]:
    """The texts of an Arrow batch, null as empty."""
    return (t or "" for t in batch.column(column).to_pylist())


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


#: Bits of a sieve as a power of two: 2 MB, whatever the data's size.
SIEVE_BITS = 24


def _bit(keys) -> Column:
    return F.xxhash64(*keys).bitwiseAND((1 << SIEVE_BITS) - 1)


def sieve(keys: DataFrame, *columns: str) -> Column:
    """A bit for each hash of the keys, as a scalar array of fixed size, for :func:`may_be_in`.

    It lets every row through whose key is among ``keys`` and few others while keys are fewer than bits; beyond that it
    lets all through. So it only thins out rows before a join that decides.
    """
    words = keys.select(_bit(columns).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("at").bitwiseAND(63).cast("int"))).alias("bits"))
    every = keys.sparkSession.range(1 << (SIEVE_BITS - 6)).withColumnRenamed("id", "word").join(F.broadcast(words), "word", "left")  # as many rows at most as there are words
    row = every.agg(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("x"))
    return row.select(F.transform("x", lambda x: x["bits"]).alias("x")).scalar()


def may_be_in(bits: Column, *columns: str) -> Column:
    """Whether a row's key can be among the keys of the sieve."""
    at = _bit(columns)
    hit = F.call_function("shiftright", F.get(bits, F.shiftright(at, 6).cast("int")), at.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
    return hit


def with_running(df: DataFrame, values: str, to: str, zero: Column, merge: Callable) -> DataFrame:
    """``df`` with ``to``: the running folds of the array ``values``, none for none.

    Folded in blocks of the root of its length, so that steps grow as the length to the power 1.5.
    """
    size, at = f"_{to}_size", f"_{to}_blocks"
    step = lambda all_, x: F.concat(all_, F.array(merge(F.coalesce(F.get(all_, F.size(all_) - 1), zero), x)))
    fold = lambda a: F.aggregate(a, F.slice(F.array(zero), 1, 0), step)
    begins = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.col(size))).otherwise(F.array().cast("array<int>"))
    out = df.withColumn(size, F.greatest(F.ceil(F.sqrt(F.size(values))), F.lit(1)).cast("int"))
    out = out.withColumn(at, F.transform(begins, lambda k: fold(F.slice(values, k, F.col(size)))))
    before = F.concat(F.array(zero), fold(F.transform(F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0))), lambda b: F.get(b, F.size(b) - 1))))
    return out.withColumn(to, F.flatten(F.zip_with(at, before, lambda b, x: F.transform(F.coalesce(b, F.slice(F.array(zero), 1, 0)), lambda v: merge(x, v))))).drop(size, at)
