"""Boxes that meet, by a grid; pages of very many boxes taken apart into pieces that cannot touch.

A box stands in every cell of a grid that it covers, so boxes that meet share a cell, and joins compare boxes of a cell and
not of a page. A pair is reported from one cell alone, that of its intersection's first corner.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.files import kept, workspace

SIDES = ["x1", "y1", "x2", "y2"]


def cell_size(boxes: DataFrame) -> int:
    """Twice the mean side of a table's boxes: most boxes then stand in one to four cells, and few share one."""
    mean = boxes.agg(F.avg((F.col("x2") - F.col("x1") + F.col("y2") - F.col("y1")) / 2)).first()[0]
    return max(1, int(2 * (mean or 0)))


def in_cells(boxes: DataFrame, size: int) -> DataFrame:
    """boxes once for each cell (cx, cy) that they cover; those with a null side or sides the wrong way round for none."""
    cells = lambda lo, hi: F.when(F.col(hi) >= F.col(lo), F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))
    return boxes.select("*", F.explode(cells("x1", "x2")).alias("cx")).select("*", F.explode(cells("y1", "y2")).alias("cy"))


def meeting(boxes: DataFrame, by: list[str], mark: str, condition: Callable[[Column, Column, Column], Column], size: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """Pairs (by, a, b, inter) of boxes with equal `by`: a is the smaller mark, inter the area that both cover, which is over
    zero, and condition of it and the two boxes (structs of area and the columns of `keep`) holds. Marks are unique; null
    ones and null `by` meet nothing."""
    size = size or cell_size(boxes)
    one = in_cells(boxes.select(*by, F.col(mark).alias("m"), *SIDES, *(keep or [])), size)
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    one = one.select(*by, "cx", "cy", F.struct("m", *SIDES, area.alias("area"), *(keep or [])).alias("a"))
    both = one.join(one.withColumnRenamed("a", "b"), [*by, "cx", "cy"]).filter(F.col("a.m") < F.col("b.m"))
    low = lambda s: F.greatest(f"a.{s}1", f"b.{s}1")
    side = lambda s: F.greatest(F.lit(0), F.least(f"a.{s}2", f"b.{s}2") - low(s))
    here = (F.floor(low("x") / size) == F.col("cx")) & (F.floor(low("y") / size) == F.col("cy"))
    inter = side("x") * side("y")
    return both.filter(here & (inter > 0) & condition(inter, F.col("a"), F.col("b"))).select(*by, F.col("a.m").alias("a"), F.col("b.m").alias("b"), inter.alias("inter"))


def mostly(inter: Column, a: Column, b: Column) -> Column:
    """More than half of the smaller box."""
    return 2 * inter > F.least(a["area"], b["area"])


def overlap_pairs(boxes: DataFrame) -> DataFrame:
    """Pairs of an image's boxes whose intersection exceeds half of the smaller one."""
    found = meeting(boxes, ["image_id"], "ord", mostly)
    return found.select("image_id", F.col("a").alias("ord_a"), F.col("b").alias("ord_b"), F.col("inter").alias("intersection"))


def hits(boxes: DataFrame, points: DataFrame, scale: float = 1.0) -> DataFrame:
    """boxes with px and py of each point (image_id, px, py) of a picture drawn at scale that they have; borders belong to a
    box. A point stands in one cell, so it meets the boxes there alone."""
    size = cell_size(boxes)
    at = points.select("image_id", "px", "py", (F.col("px") / scale).alias("_x"), (F.col("py") / scale).alias("_y"))
    at = at.withColumn("cx", F.floor(F.col("_x") / size)).withColumn("cy", F.floor(F.col("_y") / size))
    found = in_cells(boxes, size).join(at, ["image_id", "cx", "cy"]).filter(F.expr("_x BETWEEN x1 AND x2 AND _y BETWEEN y1 AND y2"))
    return found.select(*boxes.columns, "px", "py")


def components(edges: DataFrame, uri: str) -> DataFrame:
    """(node, root) of every node of the edges (a, b), root the smallest node that it is linked with: each round gives a node
    its neighbours' smallest root and then that root's own, as a table in the shared folder, until nothing changes."""
    both = kept(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{uri}/edges")
    roots, k = kept(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), f"{uri}/0"), 0
    while True:
        k += 1
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        lower = roots.join(near, roots["node"] == near["a"]).select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        own = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
        moved = lower.join(own, "root", "left").select("node", "was", F.least("root", "above").alias("root"))
        moved = kept(moved, f"{uri}/{k}")
        roots = moved.select("node", "root")
        if not moved.filter("was <> root").take(1):
            return roots


def apart(boxes: DataFrame, uri: str) -> DataFrame:
    """boxes (image_id, ord, sides) with part: boxes of different parts never merge. Boxes that overlap mostly are of one
    part from the start. What grows inside a part stays in its hull, so a part of several boxes takes in every other whose
    hull it meets, again and again until there is none; single boxes do not grow and may go on lying over each other."""
    node = F.struct("image_id", "ord")
    own = kept(boxes.select("image_id", "ord", *SIDES, node.alias("part")), f"{uri}/own")
    parts, k = own, 0
    while True:
        hulls = parts.groupBy("part").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count(F.lit(1)).alias("n")).withColumn("image_id", F.col("part.image_id"))
        found = kept(meeting(hulls, ["image_id"], "part", lambda inter, a, b: (a["n"] > 1) | (b["n"] > 1) | mostly(inter, a, b), keep=["n"]), f"{uri}/meet-{k}")
        if not found.take(1):
            return parts
        roots = components(found, f"{uri}/roots-{k}").select(F.col("node").alias("part"), "root")
        k += 1
        parts = kept(parts.join(roots, "part", "left").select("image_id", "ord", *SIDES, F.coalesce("root", "part").alias("part")), f"{uri}/parts-{k}")


def numbered_in(df: DataFrame, by: str, order: list[str], name: str, uri: str) -> DataFrame:
    """df with its rows' numbers (from 0) in each `by` by `order`: ranges are numbered each for itself and moved by what
    their group has in the ranges before, so that a group of any size spreads over tasks."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, by, *order).sortWithinPartitions(by, *order).withColumn("_at", F.monotonically_increasing_id())
    placed = kept(placed.withColumn("_range", F.shiftright("_at", 33)), uri)
    runs = placed.groupBy(by, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))  # a row per range and group in it
    ahead = F.coalesce(F.sum("_n").over(W.partitionBy(by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select(F.col(by).alias("_by"), F.col("_range").alias("_of"), "_first", ahead.alias("_ahead"))
    joined = placed.join(starts, (F.col(by) == F.col("_by")) & (F.col("_range") == F.col("_of")))
    return joined.select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_ahead")).alias(name))


#: Strips of more boxes, and pieces of strips of more, are taken apart over tasks and not folded where they lie.
STRIP, PIECE = 100_000, 200
_KEY = ["image_id", "strip", "salt"]
_FIELDS = [*SIDES, "field", "value", "confidence"]
_MERGED = "image_id long, seed_y long, seed long, x1 long, y1 long, x2 long, y2 long, field string, value string, confidence long"


def in_strips(boxes: DataFrame, uri: str, most: int = STRIP) -> DataFrame:
    """boxes with strip and salt: no box crosses the border of two strips of a page, so boxes of different strips never
    merge. What is folded over is a table of the cells of heights that boxes begin in, in runs of 1024, not the boxes. Those
    of a strip of more than `most` have none (null) and are dealt by salt; so are boxes that meet nothing: those with a null
    side or sides the wrong way round, whose salt is below zero."""
    size = max(1, cell_size(boxes) // 16)
    fine = F.coalesce((F.col("x2") >= F.col("x1")) & (F.col("y2") >= F.col("y1")), F.lit(False))
    cell = F.floor(F.col("y1") / size)
    cells = boxes.filter(fine & F.col("image_id").isNotNull()).groupBy("image_id", cell.alias("cell")).agg(F.max(F.ceil(F.col("y2") / size)).alias("end"), F.count(F.lit(1)).alias("n"))
    cells = kept(cells.withColumn("run", F.floor(F.col("cell") / 1024)), f"{uri}/cells")
    earlier = W.partitionBy("image_id").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    ends = cells.groupBy("image_id", "run").agg(F.max("end").alias("end")).select("image_id", "run", F.max("end").over(earlier).alias("before"))
    own = W.partitionBy("image_id", "run").orderBy("cell")
    upto = F.greatest("before", F.max("end").over(own.rowsBetween(W.unboundedPreceding, -1)))
    begun = cells.join(ends, ["image_id", "run"]).withColumn("upto", upto).withColumn("begin", F.when(F.coalesce(F.col("upto") <= F.col("cell"), F.lit(True)), F.col("cell")))
    begun = kept(begun.select("image_id", "run", "cell", "n", F.max("begin").over(own).alias("begin")), f"{uri}/begun")
    last = begun.groupBy("image_id", "run").agg(F.max("begin").alias("begin")).select("image_id", "run", F.max("begin").over(earlier).alias("earlier"))
    strips = begun.join(last, ["image_id", "run"]).select("image_id", "cell", "n", F.coalesce("begin", "earlier").alias("strip"))
    large = strips.groupBy("image_id", "strip").agg(F.sum("n").alias("n")).filter(F.col("n") > most).select("image_id", "strip", F.lit(True).alias("large"))
    strips = strips.join(large, ["image_id", "strip"], "left").select("image_id", "cell", F.when(F.col("large").isNull(), F.col("strip")).alias("strip"))
    at = boxes.filter("image_id IS NOT NULL AND ord IS NOT NULL").withColumn("cell", F.when(fine, cell)).withColumn("_deal", F.pmod(F.xxhash64("ord"), F.lit(1024)))
    placed = at.filter(F.col("cell").isNotNull()).join(strips, ["image_id", "cell"]).withColumn("salt", F.when(F.col("strip").isNull(), F.col("_deal")).otherwise(0))
    alone = at.filter(F.col("cell").isNull()).withColumn("strip", F.lit(None).cast("long")).withColumn("salt", -1 - F.col("_deal"))
    return placed.unionByName(alone).drop("cell", "_deal")


def _pieces(key: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of boxes by key and x1, and the number of each one's piece in it: a piece ends where no box goes on."""
    by = np.lexsort((x1, key))
    key, x1, x2 = key[by], x1[by], x2[by]
    away = key * (int(x2.max()) - int(x2.min()) + 1)  # keeps a strip's ends above those of the ones before
    ends = np.maximum.accumulate(x2 + away) - away
    new = np.r_[True, (key[1:] != key[:-1]) | (x1[1:] >= ends[:-1])]
    return by, np.cumsum(new) - 1


def _folded(t: pa.Table, fold: Callable[[list[tuple]], Iterator[tuple[tuple, list]]], most: int) -> pa.RecordBatch:
    """Whole strips with their boxes merged (open is false), and as they are those of large strips and pieces (open)."""
    cols = {c: t[c].to_pylist() for c in (*_FIELDS, "image_id", "ord")}
    salt, begun = t["salt"].to_numpy(), ~t["strip"].is_null().to_numpy()
    out = [(k, None, bool(salt[k] >= 0)) for k in np.flatnonzero(~begun).tolist()]
    if begun.any():
        rows = np.flatnonzero(begun)
        image, strip, x1, x2, y1, ord_ = (t[c].to_numpy()[rows].astype(np.int64) for c in ("image_id", "strip", "x1", "x2", "y1", "ord"))
        key = np.cumsum(np.r_[0, (image[1:] != image[:-1]) | (strip[1:] != strip[:-1])])
        by, piece = _pieces(key, x1, x2)
        inner = np.lexsort((ord_[by], y1[by], piece))
        rows, size = rows[by][inner].tolist(), np.bincount(piece)
        values, at = list(zip(*[cols[c] for c in (*_FIELDS, "ord")], strict=True)), 0
        for n in size.tolist():
            own, at = rows[at : at + n], at + n
            if n == 1 or n > most:
                out += [(k, None, n > 1) for k in own]
            else:
                first = {values[k][7]: k for k in own}
                out += [(first[r[7]], m, False) for r, m in fold([values[k] for k in own])]
    at = [k for k, _, _ in out]
    merged = [m if m else [cols[c][k] for c in _FIELDS] for k, m, _ in out]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
    sides = [pa.array(list(c), ty) for c, ty in zip(zip(*merged, strict=True), types, strict=True)]
    ids = [pa.array([cols[c][k] for k in at], pa.int64()) for c in ("image_id", "y1", "ord")]
    return pa.RecordBatch.from_arrays([*ids, *sides, pa.array([o for _, _, o in out])], names=["image_id", "seed_y", "seed", *_FIELDS, "open"])


def merge_pages(boxes: DataFrame, fold: Callable[[list[tuple]], Iterator[tuple[tuple, list]]], strip: int = STRIP, piece: int = PIECE) -> DataFrame:
    """Each image's boxes after a greedy merge in order of (y1, ord), as `fold` does it for rows (x1, y1, x2, y2, field, value,
    confidence, ord): it gives for each result its first row and what became of it. An image is cut into strips that no box
    leaves and these into pieces, which are folded where they lie; strips and pieces of more than `strip` and `piece` boxes
    are taken apart() and folded part by part. The results are numbered in the order of their first rows, as one fold of the
    whole image would."""
    uri = workspace(boxes.sparkSession)

    def strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the boxes so far of the strip that the last batch ended in
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([*held, b])
            keys = [t[c].fill_null(-(2**62)).to_numpy() for c in _KEY]
            other = np.logical_or.reduce([k != k[-1] for k in keys])
            cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            held = t.slice(cut).to_batches()
            if cut:
                yield _folded(t.slice(0, cut), fold, piece)
        if held:
            yield _folded(pa.Table.from_batches(held), fold, piece)

    placed = in_strips(boxes.select("image_id", "ord", *_FIELDS), uri, strip).repartition(*_KEY).sortWithinPartitions(*_KEY)
    rows = kept(placed.mapInArrow(strips, f"{_MERGED}, open boolean"), f"{uri}/strips")
    done, left = rows.filter("NOT open").drop("open"), rows.filter("open").select("image_id", F.col("seed").alias("ord"), *_FIELDS)
    if left.take(1):
        done = kept(done.unionByName(_merge_parts(left, fold, uri)), f"{uri}/folded")
    return numbered_in(done, "image_id", ["seed_y", "seed"], "ord", f"{uri}/merged").select("image_id", "ord", *_FIELDS)


def _merge_parts(boxes: DataFrame, fold: Callable[[list[tuple]], Iterator[tuple[tuple, list]]], uri: str) -> DataFrame:
    """The merged boxes with their first rows' y1 and ord, a part to a task."""
    parts = apart(boxes, f"{uri}/apart").select("image_id", "ord", "part")
    per = boxes.join(parts, ["image_id", "ord"]).groupBy("part").agg(F.array_sort(F.collect_list(F.struct("y1", "ord", F.struct(*_FIELDS).alias("b")))).alias("boxes"))

    def merged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [[p["image_id"], first[1], first[7], *r] for p, bs in zip(f["part"], f["boxes"], strict=True) for first, r in fold([(*[x["b"][c] for c in _FIELDS], x["ord"]) for x in bs])]
            yield pd.DataFrame(out, columns=["image_id", "seed_y", "seed", *_FIELDS])

    return per.mapInPandas(merged, _MERGED)
