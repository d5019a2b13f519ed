"""Words to lines, lines to blocks, and merging of overlapping boxes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType


def ocr_words(docs: DataFrame) -> DataFrame:
    """Word boxes laid out from whole texts, as a stand-in for OCR output."""
    w = docs.select(F.col("doc_id").alias("image_id"), F.posexplode(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != "")).alias("p", "text"))
    per = 2 + F.col("image_id") % 11
    col, row = F.col("p") % per, F.floor(F.col("p") / per)
    x = col * 85 + F.when((col >= 2) & (row % 2 == 0), 600).otherwise(0)
    return w.select("image_id", F.col("p").cast("long").alias("word_idx"), "text", x.cast("long").alias("x"), (row * 40 + col * 3).cast("long").alias("y"), (8 * F.least(F.length("text"), F.lit(10))).cast("long").alias("w"), (12 + F.col("p") % 4).cast("long").alias("h"), (40 + (7 * F.col("p")) % 60).cast("double").alias("conf"))


def confident(words: DataFrame, least: int = 50) -> DataFrame:
    return words.filter((F.col("conf").cast("int") > least) & (F.trim("text") != ""))


def _numbered(t: pa.Table) -> pa.RecordBatch:
    """Whole images' words in order of image, y and word, with line."""
    t = t.combine_chunks()
    y, h = (t[c].to_numpy().astype(np.int64) for c in ("y", "h"))
    image = t["image_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    edges = [0, *(np.flatnonzero(image[1:] != image[:-1]) + 1).tolist(), len(y)]
    line = np.zeros(len(y), np.int64)
    for a, z in pairwise(edges):
        # boxes are whole numbers, so the threshold may be cut down to one
        limit, at, n = int(min(0.7 * h[a:z].mean(), 15.0)) if z > a else 0, a, 0
        while at < z:
            to = a + int(np.searchsorted(y[a:z], y[at] + limit, side="right"))
            line[at:to] = n
            at, n = to, n + 1
    return pa.RecordBatch.from_arrays([*[c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in t.columns], pa.array(line)], names=[*t.column_names, "line"])


def lines(words: DataFrame) -> DataFrame:
    """words with line (from 0): in order of y, a word joins the line whose first word is at most min(0.7 mean height, 15)
    above it. The anchor is the line's first word, so this is a fold over an image's words, not a window of gaps: one
    exchange by image, and whole rows stream through Arrow an image at a time."""

    return _streamed(words, _numbered, StructType([*words.schema.fields, StructField("line", LongType())]), "y", "word_idx")


def _streamed(rows: DataFrame, whole: Callable[[pa.Table], pa.RecordBatch], schema: StructType, *order: str, together: bool = False) -> DataFrame:
    """whole() of tables of whole images' rows, sorted by image and order; of rows that lie together, as they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows so far of the image that the last batch ended in
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([*held, b])
            image = t["image_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            cut = int(np.flatnonzero(image != image[-1])[-1]) + 1 if (image != image[-1]).any() else 0
            held = t.slice(cut).to_batches()
            if cut:
                yield whole(t.slice(0, cut))
        if held:
            yield whole(pa.Table.from_batches(held))

    if not together:
        rows = rows.repartition("image_id").sortWithinPartitions("image_id", *order)
    return rows.mapInArrow(run, schema)


def _lined_heights(t: pa.Table) -> pa.RecordBatch:
    """The line of each height y of whole images, whose words there have the sum h of n sides."""
    t = t.combine_chunks()
    y, h, n = (t[c].fill_null(0).to_numpy().astype(np.int64) for c in ("y", "h", "n"))
    image = t["image_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    edges = [0, *(np.flatnonzero(image[1:] != image[:-1]) + 1).tolist(), len(y)]
    line = np.zeros(len(y), np.int64)
    for a, z in pairwise(edges):
        sides = int(n[a:z].sum())
        # heights are whole numbers, so the threshold may be cut down to one; without sides it is the largest
        limit, at, k = int(np.floor(min(0.7 * int(h[a:z].sum()) / sides, 15.0))) if sides else 15, a, 0
        while at < z:
            to = a + int(np.searchsorted(y[a:z], y[at] + max(limit, 0), side="right"))
            line[at:to] = k
            at, k = to, k + 1
    return pa.RecordBatch.from_arrays([t["image_id"].chunk(0), t["y"].chunk(0), pa.array(line)], names=["image_id", "y", "line"])


def lines_by_height(words: DataFrame) -> DataFrame:
    """lines() for pages of any number of words: which line a word is in depends on its page and height alone, so the fold
    goes over a page's different heights, of which it has no more than pixels, and the words join their height's line. Means
    and heights are summed up in tasks before they are exchanged, and the words of one page are dealt by their height. Words
    without a height have no line (null); null images are one page; repeated words stay; an empty table stays empty."""
    heights = words.filter("y IS NOT NULL").groupBy("image_id", "y").agg(F.sum("h").alias("h"), F.count("h").alias("n"))
    lined = _streamed(heights, _lined_heights, StructType([heights.schema["image_id"], heights.schema["y"], StructField("line", LongType())]), "y")
    lined = lined.select(F.col("image_id").alias("_image"), F.col("y").alias("_y"), "line")
    return words.join(lined, F.col("image_id").eqNullSafe(F.col("_image")) & (F.col("y") == F.col("_y")), "left").drop("_image", "_y")


def blocks(lined: DataFrame) -> DataFrame:
    """lined with block (from 0 in its line): a line is cut where a gap exceeds max(2 mean gaps, 3 mean widths), if its mean
    gap exceeds two mean widths or it has three words or fewer."""
    line = W.partitionBy("image_id", "line")
    order = line.orderBy("x", "y", "word_idx")
    g = lined.withColumn("_gap", F.col("x") - F.lag(F.col("x") + F.col("w")).over(order))
    g = g.withColumn("_mean", F.avg("_gap").over(line)).withColumn("_width", F.avg("w").over(line)).withColumn("_n", F.count(F.lit(1)).over(line))
    cut = (F.col("_n") >= 2) & ((F.col("_mean") > 2 * F.col("_width")) | (F.col("_n") <= 3)) & (F.col("_gap") > F.greatest(2 * F.col("_mean"), 3 * F.col("_width")))
    return g.withColumn("block", F.sum(F.when(cut, 1).otherwise(0)).over(order)).drop("_gap", "_mean", "_width", "_n")


def annotations(blocked: DataFrame, classify: Callable[[Column], Column]) -> DataFrame:
    """A field per block: its words from left to right, box padded by 5 % and cut at zero, mean confidence, class.
    Texts of fewer than two characters go, and so do single words without a class; other texts without one are Unknown."""
    parts = blocked.groupBy("image_id", "line", "block").agg(F.array_sort(F.collect_list(F.struct("x", "y", "word_idx", "text"))).alias("ws"), F.min("x").alias("a"), F.min("y").alias("b"), F.max(F.col("x") + F.col("w")).alias("c"), F.max(F.col("y") + F.col("h")).alias("d"), F.round(F.avg("conf"), 6).alias("confidence"))
    return _classified(parts.withColumn("value", F.array_join(F.transform("ws", lambda w: w.text), " ")).withColumn("_n", F.size("ws")), classify)


def _classified(parts: DataFrame, classify: Callable[[Column], Column]) -> DataFrame:
    """The fields of blocks: value of _n words, sides a to d and mean confidence."""
    parts = parts.withColumn("_class", classify(F.col("value")))
    pad = lambda lo, hi: ((F.col(hi) - F.col(lo)) * 0.05).cast("long")
    kept = parts.filter((F.length(F.trim("value")) >= 2) & (F.col("_class").isNotNull() | (F.col("_n") >= 2)))
    low = lambda lo, hi: F.greatest(F.lit(0), F.col(lo) - pad(lo, hi))
    return kept.select("image_id", "line", "block", "value", F.coalesce("_class", F.lit("Unknown")).alias("field"), low("a", "c").alias("x1"), low("b", "d").alias("y1"), (F.col("c") + pad("a", "c")).alias("x2"), (F.col("d") + pad("b", "d")).alias("y2"), "confidence")


def _parted(t: pa.Table) -> pa.RecordBatch:
    """The blocks of whole images' words, as annotations() finds them."""
    t = t.combine_chunks()
    image = t["image_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    x, y, w, h, idx, conf = (t[c].to_numpy() for c in ("x", "y", "w", "h", "word_idx", "conf"))
    down = np.lexsort((idx, y, image))
    line = np.empty(len(x), np.int64)
    line[down] = _numbered(t.select(["image_id", "word_idx", "y", "h"]).take(down)).column("line").to_numpy()
    keys = [idx, y, x, line, image]
    order = np.lexsort(keys)
    if len(x) > 1 and np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys]).any():
        # words that share all of it stand in the order of their texts
        order = np.lexsort([np.unique([v.encode() for v in t["text"].to_pylist()], return_inverse=True)[1], *keys])
    image, line, x, y, w, h, conf = (v[order] for v in (image, line, x, y, w, h, conf))
    opens = np.r_[True, (image[1:] != image[:-1]) | (line[1:] != line[:-1])]
    first = np.flatnonzero(opens)
    n = np.diff(np.r_[first, len(x)])
    gap = np.where(opens, 0, x - np.r_[0, (x + w)[:-1]])
    mean, width = np.add.reduceat(gap, first) / np.maximum(n - 1, 1), np.add.reduceat(w, first) / n
    of = np.cumsum(opens) - 1
    able = (n >= 2) & ((mean > 2 * width) | (n <= 3))
    cuts = ~opens & able[of] & (gap > np.maximum(2 * mean, 3 * width)[of])
    block = np.cumsum(cuts)
    block -= block[first][of]
    at = np.flatnonzero(opens | cuts)
    words = np.diff(np.r_[at, len(x)])
    text = t["text"].combine_chunks().cast(pa.string()).take(pa.array(order))
    value = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[at, len(x)], pa.int32()), text), " ")
    image_ids = t["image_id"].combine_chunks().take(pa.array(order[at]))
    sides = [np.minimum.reduceat(x, at), np.minimum.reduceat(y, at), np.maximum.reduceat(x + w, at), np.maximum.reduceat(y + h, at)]
    return pa.RecordBatch.from_arrays([image_ids, *map(pa.array, (line[at], block[at])), value, *map(pa.array, (words, *sides, np.add.reduceat(conf, at) / words))], names=["image_id", "line", "block", "value", "_n", "a", "b", "c", "d", "confidence"])


def fields(words: DataFrame, classify: Callable[[Column], Column], together: bool = False) -> DataFrame:
    """annotations() of blocks() of lines(): words (none of whose columns are null but the image) go to Python once, a whole image
    at a time, and only blocks come back. Where the words of an image stand one behind the other in a partition (`together`),
    they are neither exchanged nor sorted by Spark; else there is one exchange by image."""
    longs = [StructField(c, LongType()) for c in ("_n", "a", "b", "c", "d")]
    schema = StructType([words.schema["image_id"], StructField("line", LongType()), StructField("block", LongType()), StructField("value", StringType()), *longs, StructField("confidence", DoubleType())])
    rows = words.select("image_id", "word_idx", "text", *[F.col(c).cast("long").alias(c) for c in ("x", "y", "w", "h")], F.col("conf").cast("double").alias("conf"))
    return _classified(_streamed(rows, _parted, schema, "y", "word_idx", together=together).withColumn("confidence", F.round("confidence", 6)), classify)


def merges(rows: list[tuple]) -> Iterator[tuple[tuple, list]]:
    """Greedy merge of (x1, y1, x2, y2, field, value, confidence, ...) in order of y1: a box takes in every later one that it
    overlaps by more than half of the smaller, growing as it goes; a known field stays, unknown gives way. Gives each
    result's first row and the seven values that became of it."""
    rows, taken = sorted(rows, key=lambda r: r[1]), set()
    for i, r in enumerate(rows):
        if i in taken:
            continue
        x1, y1, x2, y2, field, value, conf = r[:7]
        for j in range(i + 1, len(rows)):
            if j in taken:
                continue
            a1, b1, a2, b2, f, v, c = rows[j][:7]
            inter = max(0, min(x2, a2) - max(x1, a1)) * max(0, min(y2, b2) - max(y1, b1))
            if 2 * inter > min((x2 - x1) * (y2 - y1), (a2 - a1) * (b2 - b1)):
                x1, y1, x2, y2 = min(x1, a1), min(y1, b1), max(x2, a2), max(y2, b2)
                field, value, conf = (f if field == "Unknown" else field), f"{value} {v}", max(conf, c)
                taken.add(j)
        yield r, [x1, y1, x2, y2, field, value, conf]


def merge_rows(rows: list[tuple]) -> list[list]:
    """merges()'s results alone."""
    return [m for _, m in merges(rows)]


def merge_overlaps(boxes: DataFrame) -> DataFrame:
    """Each image's boxes after the greedy merge. It depends on order, so it is a fold over an image's sorted boxes; many
    images go to Python in one batch. For images of very many boxes see geometry.merge_pages()."""
    fields = ["x1", "y1", "x2", "y2", "field", "value", "confidence"]
    per = boxes.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("ord", *fields))).alias("boxes"))

    def merged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [[image, k, *r] for image, bs in zip(f["image_id"], f["boxes"], strict=True) for k, r in enumerate(merge_rows([tuple(b[c] for c in fields) for b in bs]))]
            yield pd.DataFrame(out, columns=["image_id", "ord", *fields])

    return per.mapInPandas(merged, "image_id long, ord long, x1 long, y1 long, x2 long, y2 long, field string, value string, confidence long")
