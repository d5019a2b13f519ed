"""Upserts into bucket folders."""

import os

import pytest
from pyspark.sql import functions as F

from scanloom.sources import buckets as B

DDL = "image_id STRING, value STRING"


def _files(at):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(at) for f in fs if f.startswith("part-")}


def test_an_upsert_rewrites_the_buckets_it_touches(spark, tmp_path):
    at = str(tmp_path / "store")
    rows = [(f"i{k % 300}", f"v{k}") for k in range(900)] + [(None, "null")]
    assert B.read_buckets(spark, at, DDL).count() == 0
    assert B.upsert_buckets(spark.createDataFrame(rows, DDL), "image_id", at, DDL, 16) == list(range(16))
    before = _files(at)
    new = [("i7", "a"), ("i7", "b"), ("fresh", "c"), (None, "more")]
    touched = B.upsert_buckets(spark.createDataFrame(new, DDL), "image_id", at, DDL, 16)
    after = _files(at)
    changed = {int(f.split(f"{B.BUCKET}=")[1].split("/")[0]) for f in set(before.items()) ^ set(after.items()) for f in [f[0]]}
    assert changed == set(touched) and len(touched) <= 3
    got = sorted((r["image_id"] or "", r["value"]) for r in B.read_buckets(spark, at, DDL).collect())
    assert got == sorted((i or "", v) for i, v in [r for r in rows if r[0] != "i7"] + new)
    assert B.upsert_buckets(spark.createDataFrame([], DDL), "image_id", at, DDL, 16) == [] and _files(at) == after
    assert B.read_buckets(spark, at, DDL, touched).filter("image_id = 'fresh'").count() == 1


def test_a_failed_upsert_leaves_the_old_state(spark, tmp_path):
    at = str(tmp_path / "store")
    B.upsert_buckets(spark.createDataFrame([(f"i{k}", "old") for k in range(50)], DDL), "image_id", at, DDL, 4)
    before = _files(at)
    bad = spark.createDataFrame([(f"i{k}", "new") for k in range(50)], DDL).withColumn("value", F.when(F.col("image_id") == "i33", F.raise_error(F.lit("broken"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="broken"):
        B.upsert_buckets(bad, "image_id", at, DDL, 4)
    assert _files(at) == before and {r["value"] for r in B.read_buckets(spark, at, DDL).collect()} == {"old"}
    with pytest.raises(ValueError):
        B.upsert_buckets(bad.withColumn(B.BUCKET, F.lit(1)).drop("value").withColumn("value", F.lit("x")), "image_id", at, DDL + f", {B.BUCKET} INT", 4)


def test_what_goes_over_a_store_is_computed_once(spark, tmp_path):
    ddl, at = "k long, v string", str(tmp_path / "store")
    B.upsert_buckets(spark.createDataFrame([(k, "old") for k in range(40)], ddl), "k", at, ddl, 4)
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    new = spark.createDataFrame([(k, "new") for k in range(35, 45)], ddl).mapInPandas(count, ddl)
    B.upsert_buckets(new, "k", at, ddl, 4)
    assert seen.value == 10
    assert sorted(map(tuple, B.read_buckets(spark, at, ddl).collect())) == [(k, "old" if k < 35 else "new") for k in range(45)]
