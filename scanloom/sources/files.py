"""Files in and out: listings, OCR and page providers, JSON readers and sinks."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas

# Suffixes of pictures and of convertible files.
PICTURES, CONVERTIBLE = ["jpg", "jpeg", "png", "bmp", "tiff", "tif", "gif"], ["jpg", "jpeg", "png", "pdf"]
SUMMARY_BANNER = "ANALIZA DOKUMENTU\n" + "=" * 40 + "\n\n"


def workspace(spark: SparkSession) -> str:
    """A new folder's URI below spark.checkpoint.dir, which all executors see; below a temporary folder where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors see")
        base = tempfile.mkdtemp(prefix="scanloom-")
        atexit.register(shutil.rmtree, base, True)
    return f"{base.rstrip('/')}/engine-{uuid.uuid4().hex}"


def kept(df: DataFrame, uri: str) -> DataFrame:
    """df as a Parquet table: computed once, cut off from its lineage, of a size that Spark knows."""
    df.write.parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


# listings


def listing(spark: SparkSession, root: str, glob: str = "*.{jpg,png}") -> DataFrame:
    """path, mt, length and content of files below root; content is read only where it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", F.col("modificationTime").alias("mt"), "length", "content")


def has_suffix(path: Column, suffixes: list[str]) -> Column:
    return F.lower(path).rlike(rf"\.({'|'.join(suffixes)})$")


def convertible(spark: SparkSession, root: str) -> DataFrame:
    """Pictures and PDFs below root with kind: pdf or image."""
    kind = F.when(has_suffix(F.col("path"), ["pdf"]), "pdf").otherwise("image")
    return listing(spark, root, "*").filter(has_suffix(F.col("path"), CONVERTIBLE)).withColumn("kind", kind)


def output_path(path: Column, root: str, out: str, suffix: str | None = None) -> Column:
    """The same relative path below another folder, with another suffix if one is given."""
    moved = F.concat(F.lit(out.rstrip("/")), F.substr(path, F.instr(path, root.rstrip("/")) + len(root.rstrip("/"))))
    return F.regexp_replace(moved, r"\.[^./]*$", f".{suffix}") if suffix else moved


def page_name(base: Column, page: Column, pages: Column) -> Column:
    """base, with _page and the number only where a file has several pages."""
    return F.when(pages > 1, F.concat(base, F.lit("_page"), page.cast("string"))).otherwise(base)


# providers: functions of bytes that run where the files are; a failure gives a row with error and nothing else

Words = Callable[[bytes], Iterable[tuple[str, int, int, int, int, float]]]
Pages = Callable[[bytes], Iterable[bytes]]


def _per_file(files: DataFrame, rows: Callable[[bytes], Iterable[tuple]], columns: list[str], ddl: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    out = [(path, k, *r, None) for k, r in enumerate(rows(content))]
                except Exception as e:  # one bad file must not end the job
                    out = [(path, None, *[None] * len(columns), f"{type(e).__name__}: {e}")]
                if out:
                    yield pd.DataFrame(out, columns=["path", "k", *columns, "error"]).astype(object)

    return files.select("path", "content").mapInPandas(run, f"path string, k int, {ddl}, error string")


def words(files: DataFrame, provider: Words) -> DataFrame:
    """path, word_idx, text, x, y, w, h, conf, error: an OCR provider's words of each file, blank ones left out."""
    out = _per_file(files, provider, ["text", "x", "y", "w", "h", "conf"], "text string, x int, y int, w int, h int, conf double")
    return out.filter(F.col("error").isNotNull() | (F.trim("text") != "")).withColumnRenamed("k", "word_idx")


def page_images(files: DataFrame, provider: Pages) -> DataFrame:
    """path, page (from 1), content, error: a provider's page images of each file."""
    out = _per_file(files, lambda b: ((p,) for p in provider(b)), ["content"], "content binary")
    return out.select("path", (F.col("k") + 1).alias("page"), "content", "error")


def texts(words_of: DataFrame) -> DataFrame:
    """path and text: words joined by spaces in their order."""
    ordered = F.array_sort(F.collect_list(F.when(F.col("error").isNull(), F.struct("word_idx", "text"))))
    joined = F.array_join(F.transform(ordered, lambda w: w["text"]), " ")
    return words_of.groupBy("path").agg(joined.alias("text"))


def ocr_text(files: DataFrame, provider: Words, least: int | None = None) -> DataFrame:
    """path and text of each file: its words, with `least` only those of more confidence, joined by spaces."""
    found = words(files, provider)
    return texts(found if least is None else found.filter((F.col("conf").cast("int") > least) | F.col("error").isNotNull()))


def page_files(pages: DataFrame) -> DataFrame:
    """page_images() with name: the file's, with _page and the number where it has several pages."""
    base = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    count = pages.groupBy("path").agg(F.count("page").alias("pages"))
    return pages.join(count, "path").withColumn("name", F.concat(page_name(base, F.col("page"), F.col("pages")), F.lit(".jpg")))


# JSON readers


def read_documents(spark: SparkSession, path: str, ddl: str = schemas.REGEX_DOCUMENT) -> DataFrame:
    return spark.read.schema(ddl).json(path)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """image_id, image_path, annotations of files that hold one object keyed by image; a missing or corrupt file has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], "image_id string, image_path string, annotations array<struct<field:string,value:string,bbox:array<int>,confidence:double>>")
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", schemas.ANNOTATION_FILE).alias("m"))
    rows = whole.select(F.explode("m").alias("image_id", "r"))
    return rows.select("image_id", "r.image_path", "r.annotations")


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """entry_id (from 0) and the entries of a review file; a missing one has none."""
    ddl = f"entry_id int, {schemas.REVIEW_ENTRY.replace(': ', ':')}"
    if not exists(spark, path):
        return spark.createDataFrame([], ddl)
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", schemas.REVIEW_FILE).alias("f"))
    return whole.select(F.posexplode("f.entries").alias("entry_id", "e")).select("entry_id", "e.*")


def read_results(spark: SparkSession, path: str, ddl: str = schemas.CURATED) -> DataFrame:
    """Results of runs before this one, none if there was no run; corrupt lines give none."""
    return spark.read.schema(ddl).option("mode", "DROPMALFORMED").json(path) if exists(spark, path) else spark.createDataFrame([], ddl)


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a file that holds one JSON list."""
    return spark.read.schema(schemas.TRAINING_ROW).option("multiLine", True).json(path)


# sinks


def write_documents(documents: DataFrame, path: str, ordered: bool = False) -> None:
    """One JSON line per document; ordered sorts all of them by name over as many files as there are ranges."""
    (documents.orderBy("file_name") if ordered else documents).write.mode("overwrite").json(path)


def append_documents(documents: DataFrame, path: str) -> None:
    """Further lines behind those that are there."""
    documents.write.mode("append").json(path)


def write_page_metadata(pages: DataFrame, path: str) -> None:
    """Metadata, and raw text, a line per page with its source, so equal names in different folders stay apart."""
    named = pages.withColumn("name", F.regexp_extract("source", r"([^/]*)$", 1))
    named.select("source", "name", "language", "metadata").write.mode("overwrite").json(f"{path}/metadata")
    named.select("source", "name", "raw_text").write.mode("overwrite").json(f"{path}/text")


def write_summaries(summaries: DataFrame, path: str, stamp: str) -> None:
    """source and text; a line per summary with its file name, which carries the time (yyyyMMdd_HHmmss), and its banner.
    Empty summaries have no file."""
    base = F.regexp_replace(F.regexp_extract("source", r"([^/]*)$", 1), r"\.[^.]*$", "")
    name = F.concat(base, F.lit(f"_{stamp}.txt"))
    summaries.filter("text IS NOT NULL").select("source", name.alias("file"), F.concat(F.lit(SUMMARY_BANNER), "text").alias("text")).write.mode("overwrite").json(path)


def write_reviews(entries: DataFrame, path: str) -> None:
    """Review entries, a line each in the order of entry_id, in place of those that are there."""
    save_atomically(entries.orderBy("entry_id"), path)


def read_review_lines(spark: SparkSession, path: str) -> DataFrame:
    """The entries that write_reviews wrote; a missing folder has none."""
    ddl = f"entry_id BIGINT, {schemas.REVIEW_ENTRY}"
    return spark.read.schema(ddl).json(path) if exists(spark, path) else spark.createDataFrame([], ddl)


def _local(uri: str) -> str | None:
    u = urlparse(uri)
    return unquote(u.path) if u.scheme in ("", "file") else None


def _put(uri: str, data: bytes) -> None:
    """A file of a shared folder, whole or not at all, so that a repeated task does no harm."""
    part = f"{uri}.{uuid.uuid4().hex}.tmp"
    if path := _local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(_local(part), "wb") as f:
            f.write(data)
        os.replace(_local(part), path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(f"{path}.tmp") as f:
        f.write(data)
    store.move(f"{path}.tmp", path)


def write_files(files: DataFrame, root: str, encoders: list[Callable[[bytes], bytes]] | None = None) -> DataFrame:
    """path, ok, error of files (path relative to root, content), written when the result is computed. The first encoder
    that does not fail gives a file's bytes; if all do, the row has the last error and no file is written."""

    def one(path: str, content: bytes | None) -> tuple[bool, str | None]:
        error = "no content"
        for encode in (encoders or [bytes]) if content is not None else []:
            try:
                _put(f"{root.rstrip('/')}/{path}", encode(bytes(content)))
                return True, None
            except Exception as e:  # one bad file must not end the job
                error = f"{type(e).__name__}: {e}"
        return False, error

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(p, *one(p, c)) for p, c in zip(f["path"], f["content"], strict=True)], columns=["path", "ok", "error"]).astype({"error": object})

    return files.select("path", "content").mapInPandas(run, "path string, ok boolean, error string")


def save_atomically(df: DataFrame, path: str) -> None:
    """df as JSON lines in place of what path has, which may be what df is computed from: written beside it, then swapped
    by renaming. A run that dies leaves either the old or the new records, the old ones under .old at worst."""
    spark = df.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    new, old = f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp", f"{path.rstrip('/')}.old"
    df.write.json(new)
    store = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    store.delete(fs_path(old), True)
    if store.exists(fs_path(path)) and not store.rename(fs_path(path), fs_path(old)):
        raise OSError(f"{path} cannot be moved away")
    if not store.rename(fs_path(new), fs_path(path)):
        store.rename(fs_path(old), fs_path(path))
        raise OSError(f"{new} cannot be moved to {path}")
    store.delete(fs_path(old), True)


def save_batches(records: DataFrame, path: str, state: str) -> None:
    """Save a stream's records batch by batch; one that runs again after a failure overwrites its own folder."""

    def save(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").json(f"{path}/batch={n}")

    records.writeStream.foreachBatch(save).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def read_batches(spark: SparkSession, path: str, ddl: str, key: str) -> DataFrame:
    """What save_batches saved, each key's record of the last batch that has one."""
    rows = spark.read.schema(f"{ddl}, batch BIGINT").json(path)
    last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (key, "batch")]), "batch").alias("r"))
    return last.select(key, "r.*")


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as CSV in a folder of its name, in place of a workbook's sheets."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def upsert_file(new: DataFrame, old: DataFrame, key: str, path: str) -> None:
    """old with the rows of new's keys replaced, in path, which may be old's own."""
    from ..operators.records import upsert

    save_atomically(upsert(old, new, key), path)
