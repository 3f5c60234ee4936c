"""Sources and sinks: the lake of Parquet tables, CSV and JSON lines, JDBC, and releases."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = re.compile(r"^[a-z][a-z0-9_]*$")
#: Columns that never reach the lake.
DENIED = {"pages": ("html", "extracted_text")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if not NAME.match(name):
        raise ValueError(f"{name!r} is no table name")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connect(spark: SparkSession, sf_dir: str, tables: list[str]) -> dict[str, DataFrame]:
    """The named tables, each also as a temporary view; a missing one is an error."""
    out = {}
    for name in tables:
        out[name] = table(spark, sf_dir, name)
        out[name].createOrReplaceTempView(name)
    return out


def drop_denied(df: DataFrame, name: str, denied: dict[str, tuple[str, ...]] = DENIED) -> DataFrame:
    left = [c for c in df.columns if c not in denied.get(name, ())]
    if not left:
        raise ValueError(f"no column of {name} may be exported")
    return df.select(*left)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where it is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="tallybrook-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(spark: SparkSession, source: str, tables: list[str], out: str, **jdbc: str) -> dict[str, int]:
    """Copy tables to Parquet without their denied columns, from a JDBC url or another lake; rows written by table."""
    counts = {}
    for name in tables:
        df = spark.read.jdbc(source, name, properties=jdbc) if source.startswith("jdbc:") else table(spark, source, name)
        drop_denied(df, name).write.mode("overwrite").parquet(f"{out}/{name}.parquet")
        counts[name] = spark.read.parquet(f"{out}/{name}.parquet").count()
    return counts


def read_csv(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """A CSV with a header, read by schema; rows without a required field are an error."""
    df = spark.read.csv(path, header=True, schema=schema, encoding="UTF-8")
    if required and df.filter(" or ".join(f"{c} is null" for c in required)).limit(1).count():
        raise ValueError(f"{path} lacks a value in {required}")
    return df


def read_jsonl(spark: SparkSession, path: str, schema: str, key: str, forbidden: tuple[str, ...] = ("grievance",)) -> DataFrame:
    """JSON lines by schema, with unique keys and without forbidden fields."""
    found = spark.read.json(path).columns
    if bad := [c for c in forbidden if c in found]:
        raise ValueError(f"{path} holds {bad}")
    df = spark.read.schema(schema).json(path)
    if df.groupBy(key).count().filter(f"`count` > 1 or {key} is null").limit(1).count():
        raise ValueError(f"{path}: {key} repeats or is null")
    return df


def publish(frames: dict[str, DataFrame], out: str, meta: dict) -> None:
    """A release: its tables into a staging folder, the meta row last, then one rename into place."""
    spark = next(iter(frames.values())).sparkSession
    staging = f"{out}.staging-{uuid.uuid4().hex}"
    for name, df in frames.items():
        df.write.parquet(f"{staging}/{name}.parquet")
    spark.createDataFrame([{k: str(v) for k, v in meta.items()}]).coalesce(1).write.json(f"{staging}/meta.json")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(out).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path(out)):
        fs.rename(path(out), path(f"{out}.old-{uuid.uuid4().hex}"))
    fs.rename(path(staging), path(out))


def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, modified (when its newest file was written) of some tables."""
    parts = [table(spark, sf_dir, n).select(F.lit(n).alias("name"), F.col("_metadata.file_modification_time").alias("t")).groupBy("name").agg(F.max("t").alias("modified")) for n in ("documents", "orders", "lineitem")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation through a CSV and back."""
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.csv(path, header=True)
    return read_csv(spark, path, "n_nationkey long, n_name string", ("n_nationkey",))


def jsonl_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark through JSON lines and back."""
    path = f"{shared_dir(spark)}/json-{uuid.uuid4().hex}"
    table(spark, sf_dir, "benchmark").write.json(path)
    return read_jsonl(spark, path, "item_id long, text string", "item_id")


QUERIES = {f.__name__: f for f in (freshness, csv_scan, jsonl_load)}
ORACLE_SQL = {"csv_scan": "SELECT n_nationkey::bigint AS n_nationkey, n_name FROM nation", "jsonl_load": "SELECT item_id, text FROM benchmark"}
