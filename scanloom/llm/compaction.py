"""Executed compaction: small files of a day are packed first-fit into groups, and one file takes the place of each group.

A table is written as one Parquet file for each (day, lot, piece). Each day's small files are then planned by first-fit
decreasing: a max-residual segment tree holds what each group still takes and descends leftmost to the first group that a
file fits into. The rows of groups of several files join the plan, are dealt by group, sorted by their file's place in the
group and their own place in the file, and written again. What must move, moves at the end, a day to a task.

Writers are Spark's, so an attempt that is lost or repeated leaves nothing. Moving and removing files is the same however
often it is done: `settle` after a failure goes on where it stopped, and originals go only when their merged file stands.
Tables with a row per file or day are joined by Spark, which broadcasts them only where their size on disk allows it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import free_name, local_path, moved, opened, quoted, removed_tree, shared_dir, stored, type_of

#: The day of rows without a time; no timestamp lies so early.
NO_DAY = -(1 << 40)
PLAN = "day long, lot long, piece long, n_rows long, grp long, ordinal long, n_files long, sources string"


class FirstFit:
    """Groups of equal capacity, of which the earliest with room takes the next item.

    Leaves hold what groups still take, nodes the most below them. Groups that nobody opened have all their room, so the
    leftmost leaf with room is the earliest open group that fits or else the next new one."""

    def __init__(self, most: int, items: int):
        self.leaves = 1 << max(0, items - 1).bit_length()
        self.room = [most] * (2 * self.leaves)

    def put(self, size: int) -> int:
        node = 1
        while node < self.leaves:
            node *= 2
            node += self.room[node] < size
        at = node - self.leaves
        self.room[node] -= size
        while node > 1:
            node //= 2
            self.room[node] = max(self.room[2 * node], self.room[2 * node + 1])
        return at


def plan(files: DataFrame, small: int, most: int) -> DataFrame:
    """files (day, lot, piece, n_rows) with the group of each (grp), its place there (ordinal), the number of files in the
    group and, at its first file, their names in joining order (sources). Files of under `small` rows, by descending rows,
    then lot, then piece, join the earliest group that holds at most `most` rows with them; the others, and those over
    `most`, stay alone in groups of negative numbers. A day is one task, whose files are as many as its lots and pieces,
    however many rows they have; ties are told apart by lot and piece; an empty table stays empty."""

    def run(day: pd.DataFrame) -> pd.DataFrame:
        at = day.assign(down=-day["n_rows"]).sort_values(["down", "lot", "piece"]).drop(columns="down")
        fits = (at["n_rows"] < small) & (at["n_rows"] <= most)
        packer, groups, sources = FirstFit(most, int(fits.sum())), [], {}
        for lot, piece, n, ok in zip(at["lot"], at["piece"], at["n_rows"], fits, strict=True):
            groups.append(packer.put(int(n)) if ok else -1 - len(groups))  # a group of its own
            sources.setdefault(groups[-1], []).append(f"{lot}-{piece}")
        at["grp"], at["ordinal"] = groups, pd.Series(groups, at.index).groupby(groups).cumcount()
        at["n_files"] = [len(sources[g]) for g in groups]
        at["sources"] = [",".join(sources[g]) if first else None for g, first in zip(groups, at["ordinal"] == 0, strict=True)]
        return at

    return files.select("day", "lot", "piece", "n_rows").groupBy("day").applyInPandas(run, PLAN)


def day_of(time: Column) -> Column:
    return F.coalesce(F.unix_date(F.to_date(time)).cast("long"), F.lit(NO_DAY))


def share(rows: int, by: int) -> int:
    return 1 + rows // by


def write_lots(df: DataFrame, uri: str, days: DataFrame, rows: int, id_col: str, time_col: str, lot_rows: int = 200) -> list[str]:
    """Write df as one file for each day, lot and piece, sorted by time, then id; days: day, n. Returns the names of the
    folders' keys, which are free, so that no column of df is lost."""
    keys = [free_name(df, k) for k in ("day", "lot", "piece")]
    day, lot, piece = map(quoted, keys)
    h = F.crc32(F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("")).cast("binary"))
    n = free_name(df, "n")
    per_day = days.select(F.col("day").alias(keys[0]), F.col("n").alias(n))
    placed = df.withColumn(keys[0], day_of(F.col(quoted(time_col)))).join(per_day, keys[0])
    lots = 1 + F.floor(F.col(quoted(n)) / share(rows, lot_rows))
    placed = placed.withColumn(keys[1], (F.floor(h / 16) % lots).cast("long")).withColumn(keys[2], F.least(h % 4, F.floor(h / 4) % 4).cast("long"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartition(tasks, day, lot, piece).sortWithinPartitions(day, lot, piece, quoted(time_col), quoted(id_col))
    placed.select(*map(quoted, df.columns), day, lot, piece).write.option("maxRecordsPerFile", 0).partitionBy(*keys).parquet(uri)
    return keys


def merge(df: DataFrame, uri: str, keys: list[str], planned: DataFrame, to: str) -> str:
    """Write the rows of groups of several files to `to`, a file for each group, in the order of its files and of their
    rows. Returns the name of the folders' key for the group."""
    day, lot, piece = map(quoted, keys)
    schema = StructType([*df.schema.fields, *[StructField(k, LongType()) for k in keys]])
    free = [free_name(df, x) for x in ("grp", "ordinal", "row")]
    grp, ordinal, row = map(quoted, free)
    several = planned.select(F.col("day").alias(keys[0]), F.col("lot").alias(keys[1]), F.col("piece").alias(keys[2]), F.col("grp").alias(free[0]), F.col("ordinal").alias(free[1])).filter(F.col("n_files") > 1)
    rows = df.sparkSession.read.schema(schema).parquet(uri)
    rows = rows.select("*", rows.metadataColumn("_metadata")["row_index"].alias(free[2])).join(several, keys)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, day, grp).sortWithinPartitions(day, grp, ordinal, row)
    rows.select(*map(quoted, df.columns), day, grp).write.option("maxRecordsPerFile", 0).partitionBy(keys[0], free[0]).parquet(to)
    return free[0]


def file_name(day: int, lot: int, piece: int) -> str:
    return f"{'none' if day == NO_DAY else day}-{lot}-{piece}.parquet"


def settle(planned: DataFrame, uri: str, merged: str, keys: list[str], grp: str) -> DataFrame:
    """Bring each day's files to their last names, those of the first file of each group, and remove what they replace with
    the day's folder. Done again after a failure, it goes on where it stopped. A row per last file: name, and its row of the plan."""

    def run(day: pd.DataFrame) -> pd.DataFrame:
        at, last = int(day["day"].iloc[0]), day[day["ordinal"] == 0]
        own, names = f"{uri}/{keys[0]}={at}", [file_name(at, x, y) for x, y in zip(last["lot"], last["piece"], strict=True)]
        for name, lot, piece, g, n in zip(names, last["lot"], last["piece"], last["grp"], last["n_files"], strict=True):
            moved(f"{merged}/{keys[0]}={at}/{grp}={g}" if n > 1 else f"{own}/{keys[1]}={lot}/{keys[2]}={piece}", f"{uri}/{name}")
        removed_tree(own)
        return last.assign(name=names)

    return planned.groupBy("day").applyInPandas(run, f"{PLAN}, name string")


def contents(spark, uri: str, id_col: str, value_col: str | None) -> DataFrame:
    """A row per file of a folder, read from the file itself a batch of rows at a time: path, name, n_rows, the smallest and
    largest id, cents (the sum of floor(100 * value + 0.5); null, infinite and undefined values count 0), ids_sha256 (of the
    ids in the file's order, joined by commas; null ids are empty) and the names of the columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path in b.column(0).to_pylist():
                digest, n, least, largest, cents = hashlib.sha256(), 0, None, None, 0
                with opened(path) as source, pq.ParquetFile(source) as file:
                    columns = file.schema_arrow.names
                    for part in file.iter_batches(1 << 15, columns=[c for c in (id_col, value_col) if c], use_threads=False):
                        ids = part.column(id_col)
                        if not part.num_rows:
                            continue
                        digest.update(("," * bool(n) + ",".join(pc.fill_null(ids.cast(pa.string()), "").to_pylist())).encode())
                        n += part.num_rows
                        ends = pc.min_max(ids).as_py()
                        least = ends["min"] if least is None else least if ends["min"] is None else min(least, ends["min"])
                        largest = ends["max"] if largest is None else largest if ends["max"] is None else max(largest, ends["max"])
                        if value_col:
                            x = np.floor(100 * part.column(value_col).cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.5)
                            cents += sum(map(int, x[np.isfinite(x)].tolist()))
                ends = [None if x is None else str(x) for x in (least, largest)]
                out.append((local_path(path) or path, path.rsplit("/", 1)[-1], n, *ends, cents, digest.hexdigest(), ",".join(columns)))
            types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    names = ["path", "name", "n_rows", "least", "largest", "cents", "ids_sha256", "columns"]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(uri).select("path")
    return files.mapInArrow(run, "path string, name string, n_rows long, least string, largest string, cents long, ids_sha256 string, columns string")


def compact(df: DataFrame, id_col: str = "click_id", time_col: str = "arrived_at", value_col: str | None = "value", lot_rows: int = 200, small: int = 750, most: int = 400) -> DataFrame:
    """Write df's files and compact them. A row per last file, as it was read back: day, lot, piece (its first source's),
    n_rows, min_ and max_ of id_col, cents, sources (its files in joining order), ids_sha256, columns, path, rewritten.

    Of df's R rows a file holds some 1 / lot_rows at most; files under 1 + floor(R / small) rows are packed into groups of
    1 + floor(R / most). Null times are a day of their own (null), null ids count as an empty text and sort first; rows of
    equal time and id stand in any order, repeated rows stay; df's columns keep their order and may have any names; an empty
    table gives no files. All rows of a file must meet in one task, which streams them: a file is a share of R by design.
    """
    spark, uri, work = df.sparkSession, shared_dir(df.sparkSession), shared_dir(df.sparkSession)
    days = stored(df.groupBy(day_of(F.col(quoted(time_col))).alias("day")).agg(F.count(F.lit(1)).alias("n")), f"{work}/days")
    rows = days.agg(F.sum("n")).first()[0] or 0
    keys = write_lots(df, uri, days, rows, id_col, time_col, lot_rows)
    files = spark.read.schema(", ".join(f"{quoted(k)} long" for k in keys)).parquet(uri).groupBy(*[F.col(quoted(k)).alias(x) for k, x in zip(keys, ("day", "lot", "piece"), strict=True)]).agg(F.count(F.lit(1)).alias("n_rows"))
    planned = stored(plan(files, share(rows, small), share(rows, most)), f"{work}/plan")
    grp = merge(df, uri, keys, planned, f"{work}/merged")
    last = stored(settle(planned, uri, f"{work}/merged", keys, grp), f"{work}/last")
    told = contents(spark, uri, id_col, value_col).join(last.drop("n_rows"), "name")
    ids = [F.col(k).cast(type_of(df, id_col)).alias(f"{end}_{id_col}") for k, end in (("least", "min"), ("largest", "max"))]
    return told.select(F.nullif("day", F.lit(NO_DAY)).alias("day"), "lot", "piece", "n_rows", *ids, "cents", "sources", "ids_sha256", "columns", "path", (F.col("n_files") > 1).alias("rewritten"))
