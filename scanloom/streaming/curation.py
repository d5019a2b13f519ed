"""Curation of arriving entries in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..operators.records import curate
from ..sources.files import exists

KEY = ["doc_id", "ordinal"]


def curate_stream(entries: DataFrame, out: str, state: str, kind=T.field_type) -> DataFrame:
    """Curate all entries (doc_id, ordinal, value) that wait in a stream and return the results so far. Each entry is
    curated once: the stream's state keeps the keys that came before, so a batch costs no more than its own entries, and
    one that runs again after a failure overwrites its own folder, out/batch=N. The checkpoint in `state` resumes where the
    last run stopped."""
    spark = entries.sparkSession
    schema = curate(entries, kind(F.col("value"))).schema

    def batch(df: DataFrame, n: int) -> None:
        curate(df, kind(F.col("value"))).write.mode("overwrite").parquet(f"{out}/batch={n}")

    entries.dropDuplicates(KEY).writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    if not exists(spark, out):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{_ddl(schema)}, batch BIGINT").parquet(out).drop("batch")


def _ddl(schema) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
