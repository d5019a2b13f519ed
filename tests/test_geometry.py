"""Boxes that meet, pages taken apart and cut into blocks, against plain versions on random pages."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scanloom.operators import geometry as B, layout as L, segments as X
from scanloom.plans import detection

DDL = "image_id long, ord long, x1 long, y1 long, x2 long, y2 long, field string, value string, confidence long"


def _page(r, image, n, wide, tall, side):
    out = []
    for k in range(n):
        x, y = r.randrange(wide), r.randrange(tall)
        out.append((image, k, x, y, x + r.randrange(side), y + r.randrange(side), r.choice(["Unknown", "Date", "Phone"]), f"v{k}", r.randrange(100)))
    return out


def _inter(a, b):
    return max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    out = _page(r, 1, 400, 3000, 3000, 120) + _page(r, 2, 60, 100, 100, 90) + _page(r, 3, 5, 10_000, 10, 9000) + [(4, 0, 5, 5, 5, 5, "Date", "point", 1), (5, 0, 0, 0, 10, 10, "Unknown", "a", 1), (5, 1, 0, 0, 10, 10, "Date", "a", 1), (5, 2, -30, -30, -20, -20, "Date", "n", 1), (5, 3, -29, -29, -20, -20, "Date", "n", 2)]
    return out


@pytest.mark.parametrize("size", [None, 1000, 7])
def test_pairs_that_meet_are_those_of_all_pairs(spark, rows, size):
    own = [x for x in rows if size != 7 or x[0] != 3]
    df = spark.createDataFrame([*own, (1, 9999, None, 0, 5, 5, "Date", "null", 1), (None, 1, 0, 0, 9, 9, "Date", "null", 1), (1, 9998, 50, 50, 10, 10, "Date", "turned", 1)], DDL).repartition(3)
    got = B.meeting(df, ["image_id"], "ord", B.mostly, size)
    area = lambda a: (a[4] - a[2]) * (a[5] - a[3])
    want = {(a[0], a[1], b[1], _inter(a, b)) for a in own for b in own if a[0] == b[0] and a[1] < b[1] and 2 * _inter(a, b) > min(area(a), area(b))}
    rows_ = [tuple(x) for x in got.select("image_id", "a", "b", "inter").collect()]
    assert set(rows_) == want and len(rows_) == len(want)


def test_hits_are_those_of_all_points(spark, rows):
    r = random.Random(6)
    points = [(i, r.randrange(3200), r.randrange(3200)) for i in (1, 1, 2, 3) for _ in range(60)] + [(4, 5, 5), (5, 10, 10), (5, -20, -20), (9, 0, 0)]
    got = B.hits(spark.createDataFrame(rows, DDL), spark.createDataFrame(points, "image_id long, px long, py long")).select("image_id", "ord", "px", "py").collect()
    want = Counter((b[0], b[1], x, y) for i, x, y in points for b in rows if b[0] == i and b[2] <= x <= b[4] and b[3] <= y <= b[5])
    assert Counter(map(tuple, got)) == want and want


def test_large_pages_are_merged_as_one_fold(spark, rows):
    got = sorted(tuple(x) for x in B.merge_pages(spark.createDataFrame(rows, DDL).repartition(4), L.merges).collect())
    want = []
    for image in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == image), key=lambda x: x[1])
        want += [(image, k, *m) for k, m in enumerate(L.merge_rows([tuple(x[2:]) for x in own]))]
    assert got == sorted(want)
    parts = B.apart(spark.createDataFrame(rows, DDL), B.workspace(spark)).select("image_id", "part").distinct().groupBy("image_id").count().collect()
    assert {x["image_id"]: x["count"] for x in parts}[1] > 20  # the page of many boxes comes apart


@pytest.mark.parametrize("strip,piece", [(30, 200), (100_000, 3), (5, 2)])
def test_strips_and_pieces_of_any_size_give_one_fold(spark, rows, strip, piece):
    r = random.Random(8)
    far = [(6, *x[1:]) for k in range(20) for x in [(6, 10 * k + j, 300 * (k % 4) + r.randrange(90), 400 * (k // 4) + r.randrange(90), 0, 0, r.choice(["Unknown", "Date"]), f"v{j}", j) for j in range(4)]]
    own = rows + [(*x[:4], x[2] + 60 + r.randrange(60), x[3] + 60 + r.randrange(60), *x[6:]) for x in far]
    df = spark.createDataFrame(own, DDL).repartition(4)
    got = sorted(tuple(x) for x in B.merge_pages(df, L.merges, strip, piece).collect())
    want = []
    for image in {x[0] for x in own}:
        page = sorted((x for x in own if x[0] == image), key=lambda x: x[1])
        want += [(image, k, *m) for k, m in enumerate(L.merge_rows([tuple(x[2:]) for x in page]))]
    assert got == sorted(want)


def test_pages_of_far_boxes_need_no_rounds_of_joins(spark, monkeypatch):
    def none(*_):
        raise AssertionError("taken apart by joins")

    monkeypatch.setattr(B, "apart", none)
    box = lambda k, j: (1, 10 * k + j, 400 * (k % 5) + 9 * j, 200 * (k // 5) + 9 * j, 400 * (k % 5) + 99, 200 * (k // 5) + 99, "Date", f"v{j}", 1)
    odd = [(1, 9001, None, 0, 5, 5, "Date", "null", 1), (1, 9002, 50, 50, 10, 10, "Date", "turned", 1), (None, 1, 0, 0, 9, 9, "Date", "no page", 1)]
    got = B.merge_pages(spark.createDataFrame([box(k, j) for k in range(25) for j in range(3)] + odd, DDL), L.merges).collect()
    assert Counter(x["value"] for x in got) == {"v0 v1 v2": 25, "null": 1, "turned": 1}
    assert sorted(x["ord"] for x in got) == list(range(27))
    assert B.merge_pages(spark.createDataFrame([], DDL), L.merges).count() == 0


def test_lines_by_height_are_those_of_the_fold(spark):
    r = random.Random(12)
    rows = [(image, k, f"w{k}", r.randrange(2000), r.randrange(tall), 9, r.randrange(1, 30), 90.0) for image, n, tall in ((1, 4000, 3000), (2, 50, 40), (3, 1, 1), (None, 30, 400)) for k in range(n)]
    df = spark.createDataFrame(rows + rows[:5], "image_id long, word_idx long, text string, x long, y long, w long, h long, conf double").repartition(4)
    told = lambda out: Counter((x["image_id"], x["word_idx"], x["line"]) for x in out.collect())
    assert told(L.lines_by_height(df)) == told(L.lines(df))
    odd = df.limit(1).withColumn("y", F.lit(None).cast("long"))
    assert [x["line"] for x in L.lines_by_height(odd).collect()] == [None] and L.lines_by_height(df.limit(0)).count() == 0


def _cut(words):
    """Plain recursion over (index, x, y, w, h)."""
    mean = sum(w[4] for w in words) / len(words)
    least = [max(1.0, X.BETWEEN_COLUMNS * mean), max(1.0, X.BETWEEN_LINES * mean)]
    out = []

    def parts(own, k):
        pieces, end, widest = [], None, -1.0
        for w in sorted(own, key=lambda w: (w[1 + k], w[1 + k] + w[3 + k])):
            free = None if end is None else w[1 + k] - end
            if free is None or free >= least[k]:
                pieces.append([])
            widest = widest if free is None else max(widest, float(free))
            pieces[-1].append(w)
            end = w[1 + k] + w[3 + k] if end is None else max(end, w[1 + k] + w[3 + k])
        return pieces, widest / least[k]

    def cut(own):
        (columns, wide), (rows, tall) = parts(own, 0), parts(own, 1)
        best = rows if tall >= wide else columns
        if len(best) == 1:
            out.append({w[0] for w in own})
        else:
            for p in best:
                cut(p)

    cut(words)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_cuts_are_those_of_a_plain_recursion(seed):
    r = random.Random(seed)
    for _ in range(40):
        words = [(k, r.randrange(0, 900, 30), r.randrange(0, 700, r.choice([7, 40])), r.randrange(1, 60), r.randrange(1, 16)) for k in range(r.randrange(1, 50))]
        block = X.xy_cut(*[np.array([w[i] for w in words]) for i in (1, 2, 3, 4)])
        assert [set(np.flatnonzero(block == b).tolist()) for b in range(block.max() + 1)] == _cut(words)


def test_segments_of_pages(spark):
    two = [(1, 0, "Head", 0, 0, 300, 10), (1, 1, "left", 0, 60, 50, 10), (1, 2, "right", 200, 60, 50, 10), (1, 3, "below", 0, 72, 50, 10), (1, 4, "Also", 200, 72, 50, 10), (1, 5, "lost", None, 0, 1, 1), (2, 0, "An: x", 0, 50, 9, 9), (2, 1, "to: y", 0, 0, 9, 9), (None, 0, "z", 0, 0, 1, 1)]
    df = spark.createDataFrame(two, "image_id long, word_idx long, text string, x long, y long, w long, h long").repartition(3)
    got = {(x["image_id"], x["text"]): x["segment"] for x in X.blocks(X.segments(df)).collect()}
    assert got == {(1, "Head"): 0, (1, "left below"): 1, (1, "right Also"): 2, (2, "to: y"): 0, (2, "An: x"): 1, (None, "z"): 0}
    assert {(x["text"], x["segment"]) for x in X.segments(df).filter("segment IS NULL").collect()} == {("lost", None)}
    top = X.blocks(X.segments(df)).groupBy("image_id").agg(X.topmost(["to:", "an:"]).alias("t")).collect()
    assert {x["image_id"]: x["t"] for x in top} == {1: "", 2: "to: y", None: ""}
    assert X.segments(df.limit(0)).count() == 0


def test_segments_of_all_documents(spark, sf):
    words = L.confident(L.ocr_words(spark.read.parquet(f"{sf}/documents.parquet"))).filter(F.col("word_idx") < 150).collect()
    by = {}
    for w in words:
        by.setdefault(w["image_id"], []).append((w["word_idx"], w["x"], w["y"], w["w"], w["h"]))
    df = spark.createDataFrame(words)
    got = {}
    for x in X.segments(df).collect():
        got.setdefault(x["image_id"], {}).setdefault(x["segment"], set()).add(x["word_idx"])
    assert all([got[i][k] for k in range(len(got[i]))] == _cut(own) for i, own in by.items()) and len(got) == len(by)
    assert detection.QUERIES["page_segments"](spark, sf).count() >= len(words)


@pytest.mark.parametrize("seed", range(4))
def test_many_pages_are_cut_at_once_as_each_is_alone(seed):
    r = random.Random(seed)
    pages = [[(r.randrange(-90, 900, 30), r.randrange(0, 700, r.choice([7, 40])), r.randrange(60), r.randrange(16)) for _ in range(r.randrange(1, 50))] for _ in range(40)]
    columns = [np.array(c, np.int64) for c in zip(*[(k, *w) for k, p in enumerate(pages) for w in p], strict=True)]
    want = [b for p in pages for b in X.xy_cut(*map(np.array, zip(*p, strict=True))).tolist()]
    assert X.xy_cuts(*columns).tolist() == want and len(X.xy_cuts(*[c[:0] for c in columns])) == 0


def test_heights_are_folded_without_copying_lists(spark):
    rows = [(1, k, f"w{k}", 0, 2 * k, 9, None if k % 2 else 10, 90.0) for k in range(3000)] + [(2, k, "w", 0, y, 9, None, 90.0) for k, y in enumerate((0, 15, 16, 31, 32))]
    df = spark.createDataFrame(rows, "image_id long, word_idx long, text string, x long, y long, w long, h long, conf double")
    out = L.lines_by_height(df)
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["image_id"], r["word_idx"]): r["line"] for r in out.collect()}
    assert all(got[1, k] == k // 4 for k in range(3000)) and [got[2, k] for k in range(5)] == [0, 0, 1, 1, 2]


def test_read_blocks_are_those_of_segments(spark):
    r = random.Random(7)
    pages = [(k, "|".join(r.choice(["An: x", "to: Y", "word", "Über", "FROM: z"]) + f",{r.randrange(0, 900, 30)},{r.randrange(0, 700, 40)},{r.randrange(60)},{r.randrange(16)}" for _ in range(r.randrange(0, 12)))) for k in range(1200)]
    own = [(k, i, *v.split(",")) for k, t in pages for i, v in enumerate(t.split("|")) if v]
    names = ["image_id", "word_idx", "text", "x", "y", "w", "h"]

    def read(b):
        ws = [(k, i, v.split(",")) for k, t in enumerate(b["text"].to_pylist()) for i, v in enumerate(t.split("|")) if v]
        return pa.table({"page": np.array([w[0] for w in ws], np.int64), "word_idx": np.array([w[1] for w in ws], np.int64), "text": pa.array([w[2][0] for w in ws], pa.string()), **{c: np.array([int(w[2][k]) for w in ws], np.int64) for k, c in enumerate("xywh", 1)}})

    words = spark.createDataFrame([(k, i, t, *map(int, s)) for k, i, t, *s in own], ", ".join(f"{c} {'string' if c == 'text' else 'long'}" for c in names))
    lists = {"sender": ["from:"], "receiver": ["to:", "an:"], "none": ["ü:"]}
    want = X.blocks(X.segments(words)).groupBy("image_id").agg(F.count(F.lit(1)).alias("blocks"), *[X.topmost(v).alias(k) for k, v in lists.items()])
    want = {x[0]: tuple(x[1:]) for x in want.collect()}
    df = spark.createDataFrame([(None, ""), *pages], "image_id long, text string")
    got = {x[0]: tuple(x[1:]) for x in X.read_blocks(df, read, lists, ["image_id"]).collect()}
    assert got == {k: want.get(k, (0, "", "", "")) for k in [None, *range(1200)]} and len(want) > 1000
    assert X.read_blocks(df.limit(0), read, lists, ["image_id"]).count() == 0


def test_invoice_words_are_not_exchanged(spark, sf):
    plan = detection.QUERIES["block_parties"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan  # the orders are spread, and nothing else


def test_fields_of_one_stream_are_annotations_of_blocks_of_lines(spark):
    import random

    from pyspark.sql import functions as F

    r = random.Random(8)
    rows = [(r.choice([None, 1, 2, 3, 4, 5]), k % 90, r.choice(["a", "Nr", "12-03-2024", "ä", "x@y.org", "", "bb"]), r.randrange(40) * 30, r.randrange(12) * 9, r.randrange(1, 60), r.randrange(4, 20), float(r.randrange(50, 100))) for k in range(700)]
    words = spark.createDataFrame(rows + rows[:3], "image_id long, word_idx long, text string, x long, y long, w long, h long, conf double").cache()
    kind = lambda c: F.when(c.rlike(r"\d"), "Date")
    told = lambda df: sorted(map(str, df.collect()))
    want = told(L.annotations(L.blocks(L.lines(words)), kind))
    lying = words.repartition(3, "image_id").sortWithinPartitions("image_id")
    assert len(want) > 100 and told(L.fields(words, kind)) == want == told(L.fields(lying, kind, together=True))
    assert L.fields(words.limit(0), kind).count() == 0


def test_fields_exchange_texts_and_no_words(spark, sf):
    from scanloom.plans import queries as Q

    plan = Q.QUERIES["field_annotations"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Window" not in plan and "Aggregate" not in plan
    assert plan.index("MapInArrow") < plan.index("Generate") < plan.index("RepartitionByExpression")
