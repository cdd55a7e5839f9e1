"""Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a key filter: at most 2**24 / 64 rows of 16 bytes, 4 MB, whatever the input holds.
FILTER_BITS = 1 << 24
#: Bytes of an Arrow batch (a longer text is a batch of its own), so that memory doesn't depend on rows' lengths.
BATCH_BYTES = 8 << 20


def workspace(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, below the shared spark.checkpoint.dir; a temporary one if that is unset and
    everything runs on this machine."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.gettempdir()
    return f"{folder.rstrip('/')}/paperloom-{spark.sparkContext.applicationId}"


def bounded_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of at most BATCH_BYTES go to Python, unless the session has a setting of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "64MB"):  # the default
        spark.conf.set(key, f"{BATCH_BYTES}b")


#: Spark's setting that a command's shuffle files go when the command is done.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder as Parquet and read again: its lineage is cut and a lost executor loses none of it. The
    shuffles that made it are deleted at once."""
    spark = df.sparkSession
    path, before = f"{workspace(spark)}/{uuid.uuid4().hex}", spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._paperloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored() tables that nothing will read any more."""
    for df in tables:
        _delete(df.sparkSession, df._paperloom_path)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application: for long sessions, once the results are written."""
    _delete(spark, workspace(spark))


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def key_filter(df: DataFrame, *keys: str) -> DataFrame:
    """A bitmap of hashed keys of bounded size, to broadcast. See maybe_in."""
    bit = F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS))
    return df.select(F.shiftright(bit, 6).alias("__word"), F.expr("1L").alias("__one"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or(F.expr("shiftleft(__one, CAST(__bit & 63 AS INT))")).alias("__bits"))


def maybe_in(df: DataFrame, bitmap: DataFrame, *keys: str) -> DataFrame:
    """df with a boolean __maybe: false only where the keys are in no row that the bitmap was made of.

    The bitmap's size has a fixed bound (FILTER_BITS), so broadcasting it is safe at any size of input; a full bitmap only costs speed.
    """
    bit = F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS))
    out = df.withColumn("__word", F.shiftright(bit, 6)).withColumn("__bit", (bit.bitwiseAND(F.lit(63))).cast("int"))
    out = out.join(F.broadcast(bitmap), "__word", "left")
    return out.withColumn("__maybe", F.coalesce(F.expr("(shiftright(__bits, __bit) & 1L) = 1L"), F.lit(False))).drop("__word", "__bit", "__bits")


def beside(columns: list[str], *added: str) -> list[str]:
    """Names for carried columns beside added ones: a column with the name of an added one gets underscores in front."""
    out, taken = [], {*columns, *added}
    for c in columns:
        if c in added:
            while c in taken:
                c = "_" + c
            taken.add(c)
        out.append(c)
    return out


def numbered(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """df's columns as c0, c1 ..., so that their own names clash with nothing."""
    return df.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(df.columns if columns is None else columns)])


def renamed(df: DataFrame, columns: list[str], *more: str) -> DataFrame:
    """c0, c1 ... of df under the given names, and more of its columns as they are."""
    return df.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)], *more)
