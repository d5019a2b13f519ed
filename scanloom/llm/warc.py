"""WARC archives with revisit records, and a capture index by external merge.

Writing: a small table of the payloads that occur more than once tells responses from revisits, so payloads stay where
they are wherever it can be broadcast. Each task writes archives of gzip members, one per record, in the order of
(URL key, time), so its index rows form a sorted run. Merging: runs are dealt out by ranges of the key; each range keeps
its slices of the runs as Arrow batches, of which a loser tree takes a few rows at a time, which gives the globally
ordered capture histories. Reading parses the archives that Spark lists and checks every payload against its digest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from itertools import islice, pairwise
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .shared import put_bytes, shared_dir, stored, type_of

#: An archive ends after so many bytes.
ROLL = 4 << 20
#: Rows of a run that the merge takes apart at a time.
AT_ONCE = 256
#: The date of a record without one.
NO_DATE = "1970-01-01T00:00:00Z"
RUN = "url_key string, ts timestamp, page string, file string, start long, length long, record_type string, digest string, run int, row long"


def url_key(url: Column) -> Column:
    """Sort-friendly key of a URL: host labels from the top domain down, then port, path and query, no fragment."""
    u = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_replace(F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]*", ""), "#.*$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def _header(value: object) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))


def _coded(value: str) -> str:
    """A header value that unquote() gives back, whatever characters it has."""
    return re.sub(r"[\x00-\x20%\x7f\x85\u2028\u2029]", lambda m: quote(m[0], safe=""), value)


def record_id(page: str | None, url: str | None, date: str | None, digest: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {url} {date} {digest} {kind}')}>"


def record(kind: str, page: str | None, url: str | None, date: str | None, digest: str, size: int, payload: bytes, original: tuple[str, str | None, str | None] | None) -> bytes:
    """One record, uncompressed; original: page, URL and date of the response that a revisit refers to. Equal rows have
    records of equal ids."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {size}\r\n\r\n".encode() + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page, url, date, digest, kind)}", f"WARC-Date: {date or NO_DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    if original:
        other, its_url, its_date = original
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(other, its_url, its_date, digest, 'response')}"]
        if its_url is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_header(its_url)}")
        lines += [f"WARC-Refers-To-Date: {its_date or NO_DATE}", f"X-Refers-To-Page: {_coded(other)}"]
    if page is not None:
        lines.append(f"X-Page: {_coded(page)}")
    lines += [f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(headers, payload, place of the first byte) of an archive's records; raises on a broken record or a payload unlike its digest."""
    size = len(data)
    while data:
        start = size - len(data)
        z = zlib.decompressobj(31)
        raw = z.decompress(data)
        if not z.eof:
            raise ValueError("an archive ends inside a record")
        data = z.unused_data
        head, _, body = raw.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines)
        n = int(headers["Content-Length"])
        if version != "WARC/1.1" or body[n:] != b"\r\n\r\n":
            raise ValueError("a record is broken")
        payload = body[:n].partition(b"\r\n\r\n")[2]
        headers |= {k: unquote(headers[k]) for k in ("X-Page", "X-Refers-To-Page") if k in headers}
        if headers["WARC-Type"] == "response" and headers["WARC-Payload-Digest"] != "sha1:" + b32(payload):
            raise ValueError(f"page {headers.get('X-Page')}: the payload is not that of its digest")
        yield headers, payload, start


def b32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so the next row costs one path of matches."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        self.k = len(runs)
        self.losers = [-1] * max(1, self.k)
        winners = [-1] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.top = winners[1] if self.k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def __iter__(self) -> Iterator:
        while self.k and (row := self.heads[self.top]) is not None:
            yield row
            at = self.top
            self.heads[at] = next(self.runs[at], None)
            node = (at + self.k) // 2
            while node:
                if self._before(self.losers[node], at):
                    self.losers[node], at = at, self.losers[node]
                node //= 2
            self.top = at


def write_archives(pages: DataFrame, uri: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", ts_col: str | None = None, least: int = 0) -> DataFrame:
    """Write the archives below {uri}/warc; returns their index rows, a sorted run per task (RUN).

    Among equal payloads (by SHA-256) of at least `least` bytes, rows of the smallest id are responses and the others
    revisits. Null payloads are empty, null URLs have no target, a row of a null id is a response unless another id has
    its payload; repeated rows give repeated records; an empty table writes nothing; other columns are ignored.
    Without ts_col a capture's time is so many seconds after 2000-01-01 as a hash of its id gives (below 2 ** 24); null
    times sort first.
    """
    ts = F.col(ts_col).cast("timestamp") if ts_col else F.timestamp_seconds(F.lit(946684800) + F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 24)))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"), ts.alias("ts"))
    date = F.date_format(F.to_utc_timestamp("ts", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = rows.withColumn("size", F.octet_length("payload")).withColumn("same", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("date", date)
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "url", "date"))).alias("first")
    often = rows.filter(F.col("size") >= least).groupBy("same").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL").select("same", "first")
    # a table of its own: small, it is broadcast; else the rows of one payload, however many, may be split over tasks
    often = stored(often, f"{uri}/often")
    joined = rows.join(often, "same", "left").withColumn("first", F.when(~F.col("id").eqNullSafe(F.col("first.id")), F.col("first")))
    revisit = F.col("first").isNotNull()
    digest = F.sha1(F.col("payload").cast("binary"))
    shown = joined.select(url_key(F.col("url")).alias("url_key"), "ts", F.col("id").cast("string").alias("page"), "url", F.when(revisit, "").otherwise(F.col("payload")).alias("payload"), F.col("first.id").cast("string").alias("first"), F.col("first.url").alias("first_url"), F.col("first.date").alias("first_date"), digest.alias("digest"), "size", "date")
    shown = shown.sortWithinPartitions("url_key", "ts", "page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, part, row = TaskContext.get().partitionId(), 0, 0
        names = ["url_key", "ts", "page", "file", "start", "length", "record_type", "digest", "run", "row"]
        data, held = bytearray(), []

        def flush() -> pa.RecordBatch:
            file = f"{task:06d}-{part:06d}.warc.gz"
            put_bytes(f"{uri}/warc/{file}", bytes(data))
            cols = [[r[i] for r in held] for i in range(8)]
            n = len(held)
            arrays = [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.timestamp("us", "UTC")), pa.array(cols[2], pa.string()), pa.array([file] * n, pa.string()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.string()), pa.array(cols[6], pa.string()), pa.array([task] * n, pa.int32()), pa.array(cols[7], pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for b in batches:
            for key, ts, page, url, payload, first, first_url, first_date, digest, size, date in _rows(b, AT_ONCE):
                kind = "response" if first is None else "revisit"
                code = base64.b32encode(bytes.fromhex(digest)).decode()
                original = None if first is None else (first, first_url, first_date)
                packed = gzip.compress(record(kind, page, url, date, code, size, payload.encode(), original), 3, mtime=0)
                held.append((key, ts, page, len(data), len(packed), kind, code, row))
                data += packed
                row += 1
                if len(data) >= ROLL:
                    yield flush()
                    data, held, part = bytearray(), [], part + 1
        if held:
            yield flush()

    return shown.mapInArrow(run, RUN)


def _rows(b: pa.RecordBatch, n: int) -> Iterator[tuple]:
    """A batch's rows, of which so many at a time are Python objects."""
    for at in range(0, b.num_rows, n):
        yield from zip(*(c.to_pylist() for c in b.slice(at, n).columns), strict=True)


_FIRST = datetime.min.replace(tzinfo=timezone.utc)


def _slice(parts: list[pa.RecordBatch]) -> Iterator[tuple]:
    """One run's rows of a range with their sort keys: key, time (null first), page (null first), run and row."""
    for b in parts:
        for r in _rows(b, AT_ONCE):
            yield (r[0], r[1] or _FIRST, r[2] or "", r[8], r[9]), r


def merge_runs(runs: DataFrame) -> DataFrame:
    """The runs' rows in global order of (url_key, ts, page): part is ascending ranges, place the row's place in its part.
    A range is dealt by key and time, so the captures of one URL, however many, spread over ranges. Null times and pages
    come first, ties and repeated rows in the order of their run and row; an empty table gives none."""
    n = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = runs.repartitionByRange(n, "url_key", "ts", "page").sortWithinPartitions("run", "row")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, slices = TaskContext.get().partitionId(), {}
        names: list[str] = []
        for b in batches:
            names, run = b.schema.names, b.column(8).to_numpy()
            edges = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(run)]
            for a, z in pairwise(edges):
                if z > a:
                    slices.setdefault(int(run[a]), []).append(b.slice(a, z - a))
        types = [pa.string(), pa.timestamp("us", "UTC"), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64()]
        tree, at = iter(LoserTree([_slice(s) for s in slices.values()])), 0
        while some := [r for _, r in islice(tree, 10_000)]:
            arrays = [pa.array([r[i] for r in some], t) for i, t in enumerate(types)] + [pa.array([part] * len(some), pa.int32()), pa.array(range(at, at + len(some)), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "part", "place"])
            at += len(some)

    return dealt.mapInArrow(merge, RUN + ", part int, place long")


def read_archives(spark, uri: str, id_type: str = "long") -> DataFrame:
    """A row per record of the archives below a folder: page_id, payload_bytes, payload_digest, record_type, refers_to and
    where it lies (file, start). Sizes and digests are those of the full payload, for revisits too; a null id comes back as
    null, repeated records as repeated rows; a broken archive raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for h, _, start in parse(data):
                    out.append((h.get("X-Page"), int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"], h.get("X-Refers-To-Page"), path.rsplit("/", 1)[-1], start))
            types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["page", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "start"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(uri).select("path", "content")
    got = files.mapInArrow(run, "page string, payload_bytes long, payload_digest string, record_type string, refers_to string, file string, start long")
    return got.select(F.col("page").cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type).alias("refers_to"), "file", "start")


def capture(pages: DataFrame, id_col: str = "page_id", **options) -> tuple[DataFrame, DataFrame]:
    """Write, read back and index: the records as read from the archives, and the merged index. An empty table gives two
    empty results; repeated rows give repeated records; other columns are ignored."""
    spark, uri = pages.sparkSession, shared_dir(pages.sparkSession)
    runs = stored(write_archives(pages, uri, id_col, **options), f"{uri}/runs")
    if not runs.take(1):
        return spark.createDataFrame([], f"page_id {type_of(pages, id_col)}, payload_bytes long, payload_digest string, record_type string, refers_to {type_of(pages, id_col)}, file string, start long"), spark.createDataFrame([], RUN + ", part int, place long")
    return read_archives(spark, f"{uri}/warc", type_of(pages, id_col)), merge_runs(runs)
