"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word: space, \t, \n, \v, \f, \r.
WHITE = "\t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``; only a session without
    that setting and without other machines (tests, local runs) gets a temporary one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = getattr(spark, "_skyloom_scratch", None)
        if base is None:
            base = "file://" + tempfile.mkdtemp(prefix="skyloom-")
            spark._skyloom_scratch = base
    return base.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below the application's own folder, which goes when the driver's process ends."""
    own = f"{shared_dir(spark)}/skyloom/{spark.sparkContext.applicationId}"
    if getattr(spark, "_skyloom_own", None) != own:
        spark._skyloom_own = own
        atexit.register(swept, spark, own)
    return f"{own}/{tag}-{uuid.uuid4().hex}"


def swept(spark: SparkSession, folder: str) -> None:
    """Deletes an application's folder, if its session still runs."""
    if spark.sparkContext._jsc is not None:
        deleted(spark, folder)


#: Bytes of rows that go to a Python worker at once while a table is stored.  Spark's default of 64 MB is there
#: twice in each task's JVM memory outside the heap, and again in its worker.
BATCH_BYTES = 4_000_000


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends here."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    schema = df.schema
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, str(BATCH_BYTES))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(limit, before)
    out = spark.read.schema(schema).parquet(path)
    out._skyloom_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes what ``stored`` wrote for ``df``; call it when nothing reads it any more."""
    path = getattr(df, "_skyloom_path", None)
    if path:
        deleted(df.sparkSession, path)


def deleted(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def words(text: Column) -> Column:
    """Array of the maximal runs of ``[^\\x20\\x09-\\x0D]``; none for null."""
    spaced = F.translate(F.coalesce(text, F.lit("")), WHITE, " " * len(WHITE))
    return F.array_remove(F.split(spaced, " "), "")


def count_chars(text: Column, chars: str) -> Column:
    """How many code points of ``text`` are among ``chars``."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes that may be sent to all tasks at once.
BROADCAST_BYTES = 64_000_000


def small(df: DataFrame, width: int) -> DataFrame:
    """``df``, a stored table of rows of ``width`` bytes, marked to go to all tasks if it is small enough."""
    return F.broadcast(df) if df.count() * width <= BROADCAST_BYTES else df


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def by_id(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``docs`` joined with a table that has doc_id and numbers; that table goes to all tasks only if it is small."""
    return docs.join(small(stored(ids, "by-id"), 32 * (1 + len(ids.columns))), "doc_id", how)


#: Ids from here on are given to rows without one; so that they can be told apart, tables with null ids may not use them.
OWN_IDS = 2**62


def with_own_ids(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``stage``, which joins by doc_id, makes of ``docs``, with rows of a null doc_id as documents of their own.

    While the stage runs they have ids made of 61 bits of a hash of all columns, above all others; equal rows without
    an id are rows with the same id.  The result has null again.
    """
    kind = docs.schema["doc_id"].dataType
    null, most = docs.agg(F.count_if(F.col("doc_id").isNull()), F.max(F.col("doc_id").cast("long"))).first()
    if not null:
        return stage(docs)
    if most is not None and most >= OWN_IDS:
        raise ValueError(f"doc_id: {most} beside null ids; ids must be below {OWN_IDS}")
    own = F.lit(OWN_IDS) + F.xxhash64(*docs.columns).bitwiseAND(F.lit(2**61 - 1))
    rows = stage(docs.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), own)))
    return rows.withColumn("doc_id", F.when(F.col("doc_id") < OWN_IDS, F.col("doc_id")).cast(kind))
