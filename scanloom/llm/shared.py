"""Things that several training-data operators need."""

from __future__ import annotations

import atexit
import io
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Words of every contract: runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


_owner: dict = {}


def worker_state(owner: str) -> dict:
    """What a worker process keeps between tasks, for one operator at a time: another one's caches are let go."""
    if owner not in _owner:
        _owner.clear()
        _owner[owner] = {}
    return _owner[owner]


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def folders_made() -> Iterator[list[str]]:
    """The folders that shared_dir gives out meanwhile to this thread's work, and to no other's."""
    before = _made.set(own := [])
    try:
        yield own
    finally:
        _made.reset(before)


def shared_dir(spark: SparkSession) -> str:
    """A new folder's URI below spark.checkpoint.dir, which all executors see; where that is unset (tests), a temporary folder becomes it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors see")
        base = tempfile.mkdtemp(prefix="scanloom-")
        atexit.register(shutil.rmtree, base, True)
        spark.sparkContext.setCheckpointDir(base)
    uri = f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"
    if (own := _made.get()) is not None:
        own.append(uri)
    return uri


#: Rows of a batch that goes to a Python worker while a table is stored; with texts of a few kB, some MB.
BATCH = 2000


def stored(df: DataFrame, uri: str) -> DataFrame:
    """df cut off from its lineage as a Parquet table in the shared folder; its shuffles' files go at once, and batches for
    Python workers are kept small."""
    conf, rows = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", rows: str(min(BATCH, int(conf.get(rows)) or BATCH))}
    was = {k: conf.get(k, None) for k in own}
    for k, v in own.items():
        conf.set(k, v)
    try:
        df.write.parquet(uri)
    finally:
        for k, v in was.items():
            conf.unset(k) if v is None else conf.set(k, v)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def free_name(df: DataFrame, base: str) -> str:
    """base, or base with as many underscores after it as make it no column of df."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a row number that stays the same however often df is computed. A scan of files gives it as it is; what has
    joins, shuffles or the like in it might give its rows in another order the next time and is stored first."""
    steps = re.findall(r"^[\s:+\-*]*(?:\(\d+\) )?(\w+)", df._jdf.queryExecution().sparkPlan().toString(), re.M)
    if not set(steps) <= {"Project", "Filter", "ColumnarToRow", "FileScan", "Scan", "LocalTableScan"}:
        df = stored(df, f"{shared_dir(df.sparkSession)}/rows")
    return df.withColumn(name, F.monotonically_increasing_id())


def with_place(df: DataFrame, name: str) -> DataFrame:
    """df with a number that grows in the order of its rows: by the number of the Parquet file that a row lies in, then its
    place there; of a table that is no scan of such files, in the order that Spark gives them out."""
    try:
        at = df.metadataColumn("_metadata")
        file = lambda p: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(at["file_name"], p, 1), F.lit("")), F.lit("9999999999")), F.lit(0)).cast("long")
        return df.select("*", (F.shiftleft(file(r"^part-(\d+)"), 44) + F.shiftleft(file(r"-c(\d+)"), 34) + at["row_index"]).alias(name))
    except AnalysisException:
        return df.withColumn(name, F.monotonically_increasing_id())


def removed(spark: SparkSession, *uris: str) -> None:
    """Delete tables of the shared folder that nothing needs any more."""
    for uri in uris:
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def local_path(uri: str) -> str | None:
    """The path of a URI that the file system itself can open, or None."""
    u = urlparse(uri)
    return unquote(u.path) if u.scheme in ("", "file") else None


def put_bytes(uri: str, data: bytes) -> None:
    """Write a file of the shared folder whole or not at all, so that a repeated task does no harm."""
    if path := local_path(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(part := f"{path}.{uuid.uuid4().hex}") as f:
        f.write(data)
    store.move(part, path)


def opened(uri: str):
    """A file of the shared folder for reading."""
    if path := local_path(uri):
        return open(path, "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def moved(folder: str, to: str) -> None:
    """Give the one Parquet file of a folder another place. Where that has been done before, nothing is left to do; a file
    that is in neither place is an error."""
    if here := local_path(folder):
        names = [n for n in os.listdir(here) if n.endswith(".parquet") and n[0] not in "._"] if os.path.isdir(here) else []
        exists = os.path.exists(local_path(to))
        rename = lambda n: os.replace(f"{here}/{n}", local_path(to))
    else:
        from pyarrow import fs

        store, here = fs.FileSystem.from_uri(folder)
        found = store.get_file_info(fs.FileSelector(here, allow_not_found=True))
        names = [x.base_name for x in found if x.base_name.endswith(".parquet") and x.base_name[0] not in "._"]
        there = fs.FileSystem.from_uri(to)[1]
        exists = store.get_file_info(there).type != fs.FileType.NotFound
        rename = lambda n: store.move(f"{here}/{n}", there)
    if len(names) > 1 or not names and not exists:
        raise ValueError(f"{folder} has {len(names)} files, not one")
    for n in names:
        rename(n)


def removed_tree(uri: str) -> None:
    """Remove a folder with all that is in it, from a task; nothing if it is not there."""
    if path := local_path(uri):
        shutil.rmtree(path, ignore_errors=not os.path.exists(path))
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if store.get_file_info(path).type != fs.FileType.NotFound:
        store.delete_dir(path)


def quoted(name: str) -> str:
    """A column's name for expressions, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def put_array(uri: str, a: np.ndarray) -> None:
    np.save(out := io.BytesIO(), np.ascontiguousarray(a), allow_pickle=False)
    put_bytes(uri, out.getbuffer())


def map_array(uri: str) -> np.ndarray:
    """The array, memory-mapped. From a store that cannot be mapped, a copy is fetched whose name is removed at once."""
    if path := local_path(uri):
        return np.load(path, mmap_mode="r").view(np.ndarray)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with tempfile.NamedTemporaryFile(suffix=".npy") as f, store.open_input_stream(path) as src:
        shutil.copyfileobj(src, f)
        f.flush()
        return np.load(f.name, mmap_mode="r").view(np.ndarray)


def arrow_map(df: DataFrame, per_batch: Callable[[pa.RecordBatch], dict[str, list | np.ndarray | pa.Array]], schema: str) -> DataFrame:
    """df.mapInArrow with a function from a batch to columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = per_batch(b)
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols.values()], names=list(cols))

    return df.mapInArrow(run, schema)


def type_of(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str, text_col: str, keep: list[str] | None = None) -> DataFrame:
    """The two columns as id and text, then those of `keep` by number, so that clashing names cannot matter; null texts are empty."""
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep or [])])


def texts_of(b: pa.RecordBatch) -> list[bytes]:
    return b.column("text").cast(pa.binary()).to_pylist()


def slices(b: pa.RecordBatch, size: int = 4_000_000, of: str | int = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many bytes in its text column, so that a worker never holds more of them taken apart."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(of)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size)))
        yield b.slice(at, to - at)
        at = to
