"""Records in bucket folders by a hash of their key, so that an upsert rewrites the buckets it touches and no others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.records import upsert
from .files import exists, kept, workspace

#: The folders' key; records have no such column.
BUCKET = "key_bucket"


def bucket(key: str, n: int) -> Column:
    """A key's bucket; equal keys, null ones too, have one."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _write(df: DataFrame, key: str, path: str, n: int) -> None:
    """Replace the buckets that df has rows of. The writer stages them and puts them in place when all of them are written,
    so a run that fails leaves the old ones."""
    # a bucket's rows go to several tasks where it is large: Spark splits what it rebalances
    rows = df.withColumn(BUCKET, bucket(key, n)).hint("rebalance", BUCKET)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).json(path)


def read_buckets(spark: SparkSession, path: str, ddl: str, only: list[int] | None = None) -> DataFrame:
    """The records of all buckets, or of those named, whose folders alone are then listed for reading; none if nothing is there."""
    if not exists(spark, path):
        return spark.createDataFrame([], ddl)
    rows = spark.read.schema(f"{ddl}, {BUCKET} int").json(path)
    return (rows if only is None else rows.filter(F.col(BUCKET).isin(only))).drop(BUCKET)


def upsert_buckets(new: DataFrame, key: str, path: str, ddl: str, n: int = 64) -> list[int]:
    """Put records into the store at `path` (a folder of this module's own, of always the same n): the rows of a key that
    new has take the place of the key's old ones; all other keys stay as they are. Returns the buckets that were rewritten,
    n at most, the only thing that goes to the driver. A null key is never replaced: its rows are added. No new rows
    rewrite nothing. Writers of one store must take turns."""
    spark = new.sparkSession
    if BUCKET in new.columns:
        raise ValueError(f"records have a column {BUCKET}")
    names = spark.createDataFrame([], ddl).columns
    there = exists(spark, path)
    # what goes over a store is kept as a table: computed once, and of a size that Spark knows, so that a few new keys are
    # broadcast and the store's rows need not be exchanged to find those they replace
    new = kept(new.select(*names), f"{workspace(spark)}/new") if there else new.select(*names)
    touched = sorted(r[0] for r in new.select(bucket(key, n).alias("b")).distinct().collect())
    if touched:
        _write(upsert(read_buckets(spark, path, ddl, touched), new, key) if there else new, key, path, n)
    return touched
