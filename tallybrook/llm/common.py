"""What the operators of this subpackage share: materialising in the cluster's shared folder, and small helpers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import weakref
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII white space: what separates words.
WORD = r"[^\x20\x09-\x0D]+"
_FOLD = str.maketrans(UPPER, LOWER)


def fold(text: str) -> str:
    """Lower-case A-Z only."""
    return text.translate(_FOLD)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one where it is unset, as in tests."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="tallybrook-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Drop a query's shuffle files when the query is over.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), **options: str) -> str:
    """Write df as Parquet; the shuffle files that this took go at once, as nothing else can use them."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).partitionBy(*partition_by).parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return path


#: The folders that a materialised table stands in.
_WHERE: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df once as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = write(df, new_path(spark, name), **options)
    out = spark.read.schema(df.schema).parquet(path)
    _WHERE[out] = [path]
    return out


def over(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """df, which reads these materialised tables: forget(df) deletes them."""
    _WHERE[df] = [path for t in tables for path in _WHERE.get(t, [])]
    return df


def forget(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more: what a stage leaves takes disk from all that follow."""
    for t in tables:
        for path in _WHERE.pop(t, []):
            drop(t.sparkSession, path)


def tidy(spark: SparkSession) -> None:
    """Have the driver collect its garbage: plans, broadcasts and generated classes of queries that are over. In operators of
    many queries they pile up until its heap is full and stays as large."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_tables(spark: SparkSession) -> None:
    """Delete what materialize() and new_path() left in the shared folder; call it when no result is read any more."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(shared_dir(spark) + "/*-" + "?" * 32)) or []:
        fs.delete(status.getPath(), True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_mod(col: str, n: int):
    """crc32(col as text) mod n; a null counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(col).cast("string"), F.lit("")), "UTF-8")) % n


def crc_mod_py(value, n: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % n


def give_back() -> None:
    """Return the memory that this process has freed to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
    if trim:
        trim(0)


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema); when a task is over its worker gives back what it freed. Executors keep as many workers as
    ever ran at once, and deal tasks to them in turn, so that each would stay as large as its largest task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(whole, schema)


def column(batch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def texts(batch, name: str = "text") -> Iterator[str]:
    """The texts of an Arrow batch one by one; null as the empty text."""
    for x in batch.column(batch.schema.get_field_index(name)):
        yield x.as_py() or ""


#: A key is hot if it holds over this share of a table's rows: at most so many keys are, whatever the table's size.
HOT = 1000


def spread(rows: DataFrame, facts: DataFrame, key: str, other: str, ways: int = 64) -> DataFrame:
    """rows joined with facts (one row a key, no null keys), where hot keys' rows go to several tasks each: they are salted
    by the hash of the column `other`, and the facts of hot keys, at most HOT, are repeated."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    total = rows.count()
    hot = counts.filter(F.col("_n") > max(10_000, total // HOT)).select(key, F.lit(ways).alias("_ways"))
    salted = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.when(F.col("_ways").isNotNull(), F.pmod(F.xxhash64(other), F.lit(ways))).otherwise(0)).drop("_ways")
    held = facts.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_ways", F.lit(1)) - F.lit(1).cast("long")))).drop("_ways")
    return salted.join(held, [key, "_salt"]).drop("_salt")


def keepers(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs, with their own columns, whose (doc_id, text_hash) groups marks as keeper; of rows equal in both,
    one. Only rows to drop, and rows that stand several times, are looked up; a bitmap keeps nearly all others from being
    exchanged."""
    from .bitmap import bitmap, in_bitmap

    named = groups.groupBy("doc_id", "text_hash").agg(F.any_value("keeper").alias("keeper"), F.count("*").alias("n")).filter("not keeper or n > 1")
    named = materialize(named.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "keeper"), "keepers")
    held = docs.sparkSession.sparkContext.broadcast(bitmap(named.select(F.xxhash64("id", "hash").alias("h")), "h"))  # at most 16 MB

    @F.arrow_udf("boolean")
    def listed(h: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(held.value, h.to_numpy(zero_copy_only=False).view(np.uint64)))

    marked = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))
    marked = marked.withColumn("listed", listed(F.xxhash64("doc_id", "text_hash")))
    some = marked.filter("listed")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
    several = some.join(named.filter("keeper"), same, "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return marked.filter("not listed").unionByName(some.join(named, same, "left_anti")).unionByName(several).select("row.*")


#: Rows that go to a Python worker at once, where Spark's own bound of 10,000 holds: whole texts are large.
ARROW_ROWS, ARROW = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound what a task holds of whole texts; a bound that the session sets itself stays."""
    if spark.conf.get(ARROW) == "10000":
        spark.conf.set(ARROW, str(ARROW_ROWS))
