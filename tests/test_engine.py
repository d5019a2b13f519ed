import duckdb
import pytest

from scanloom.functions import text as T
from scanloom.operators import layout, records
from scanloom.plans import queries as Q


def _rows(columns, rows):
    return sorted(repr(tuple(r[columns.index(c)] for c in sorted(columns))) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, sf, name):
    df = Q.QUERIES[name](spark, sf)
    con = duckdb.connect()
    for t in ("documents", "orders", "lineitem", "events", "labels", "conversations", "supplier", "sale_lines", "vendors"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.sql(Q.ORACLES[name])
    expected = _rows(list(rel.columns), rel.fetchall())
    assert expected and _rows(df.columns, df.collect()) == expected


def _one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f("t")).first()[0]


@pytest.mark.parametrize(
    ("f", "value", "expected"),
    [
        (T.clean_unicode, "Straße – „x”", 'Strasse - „x"'),
        (T.clean_phone, "0612345678", "061 234 56 78"),
        (T.clean_phone, "+31 6 1234 5678", "+31612345678"),
        (T.clean_phone, "3112345678", "+3112345678"),
        (T.clean_phone, "12", "12"),
        (T.dates, "31-02-2024 01-02-2024 5 March 2024 01-02-2024", ["01-02-2024", "5 March 2024"]),
        (T.document_numbers, "Nr 12345/678", ["Nr 12345/678", "12345/678"]),
        (T.phones, "123456789", ["123456789"]),
        (T.document_type, "Rechnung", "invoice"),
    ],
)
def test_text_rules(spark, f, value, expected):
    from pyspark.sql import functions as F

    assert _one(spark, value, lambda c: f(F.col(c))) == expected


def test_line_anchor_is_the_first_word(spark):
    words = spark.createDataFrame([(1, i, "w", 0, y, 8, 30, 90.0) for i, y in enumerate((0, 10, 20))], "image_id long, word_idx long, text string, x long, y long, w long, h long, conf double")
    assert [r["line"] for r in layout.lines(words).orderBy("word_idx").collect()] == [0, 0, 1]


def test_merge_is_strict_and_keeps_known_fields():
    rows = [(0, 0, 10, 10, "Date", "a", 1), (4, 0, 14, 10, "Email", "b", 2), (9, 0, 19, 10, "Unknown", "c", 3)]
    assert layout.merge_rows(rows) == [[0, 0, 14, 10, "Date", "a b", 2], [9, 0, 19, 10, "Unknown", "c", 3]]


def test_page_suffixes(spark):
    df = spark.createDataFrame([("/in/x/a_page1_page2.jpg",), ("/in/x/b_page_3.jpg",), ("/in/x/c.jpg",)], "path string")
    got = {r["base"]: (r["page"], r["file_name"], r["document_type"]) for r in records.page_key(df).collect()}
    assert got == {"a_page1": (2, "a", "x"), "b": (3, "b", "x"), "c": (1, "c", "x")}


def test_curation_in_two_halves_is_one_run(spark):
    e = spark.createDataFrame([(k, k, "v") for k in range(10)], "doc_id long, ordinal long, value string")
    first = e.filter("doc_id % 2 = 0")
    assert records.not_done(e, first).union(first).count() == 10 and records.not_done(e, e).count() == 0


def test_entry_points():
    import __spark_entry__ as entry

    assert set(Q.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_merge_over_a_table_equals_the_fold_per_image(spark, sf):
    from scanloom.sources import views

    boxes = views.view(spark, sf, views.BOXES)
    by = {}
    for r in boxes.orderBy("image_id", "ord").collect():
        by.setdefault(r["image_id"], []).append(tuple(r[c] for c in ("x1", "y1", "x2", "y2", "field", "value", "confidence")))
    want = sorted((k, i, *r) for k, rows in by.items() for i, r in enumerate(layout.merge_rows(rows)))
    assert sorted(tuple(r) for r in layout.merge_overlaps(boxes).collect()) == want


def test_lines_equal_a_plain_fold(spark, sf):
    words = Q.QUERIES["line_grouping"](spark, sf)
    raw = layout.confident(layout.ocr_words(spark.read.parquet(f"{sf}/documents.parquet"))).collect()
    by = {}
    for r in raw:
        by.setdefault(r["image_id"], []).append(r)
    want = set()
    for image, rows in by.items():
        limit, anchor, n = min(0.7 * sum(r["h"] for r in rows) / len(rows), 15.0), None, -1
        for r in sorted(rows, key=lambda r: (r["y"], r["word_idx"])):
            if anchor is None or r["y"] - anchor > limit:
                anchor, n = r["y"], n + 1
            want.add((image, r["word_idx"], n))
    assert {tuple(r) for r in words.collect()} == want and want


def test_words_may_contain_values_of_any_length(spark):
    from scanloom.operators import linking

    texts = ["abcde", "bcd", "xbcdx", "a", "", "äöü€", "aaaa", "abcde"]
    words = spark.createDataFrame([(1, k, t, k, 0, 1, 1) for k, t in enumerate(texts)] + [(2, 0, "other", 0, 0, 1, 1)], "image_id long, word_idx long, text string, x long, y long, w long, h long")
    values = ["bcd", "a", "", "öü", "€", "aaa", "bcdx", "abcdef", None, "bcd"]
    entities = spark.createDataFrame([(i, "k", p, v) for i in (1, 2, 3) for p, v in enumerate(values)], "image_id long, kind string, pos long, value string")
    want = {}
    for i, own in ((1, texts), (2, ["other"]), (3, [])):
        for p, v in enumerate(values):
            want[i, p] = next((k for k, t in enumerate(own) if v is not None and v in t), None)
    assert {(r["image_id"], r["pos"]): r["word_idx"] for r in linking.link(entities, words).collect()} == want
    inner = {(r["image_id"], r["pos"]): r["word_idx"] for r in linking.link(entities, words, "inner").collect()}
    assert inner == {k: x for k, x in want.items() if x is not None}


def test_images_of_words_may_span_batches(spark):
    rows = [(i if i < 6 else None, k, "w", k, 7 * k % 400, 8, 12 + k % 4, 90.0) for i in range(7) for k in range(300 if i == 3 else 20)]
    words = spark.createDataFrame(rows, "image_id long, word_idx long, text string, x long, y long, w long, h long, conf double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {(r["image_id"], r["word_idx"]): r["line"] for r in layout.lines(words).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for image in {r[0] for r in rows}:
        own = sorted((r[4], r[1], r[6]) for r in rows if r[0] == image)
        limit, anchor, n = min(0.7 * sum(h for _, _, h in own) / len(own), 15.0), None, -1
        for y, k, _ in own:
            if anchor is None or y - anchor > limit:
                anchor, n = y, n + 1
            assert got[image, k] == n
    assert layout.lines(words.limit(0)).count() == 0


def test_saving_over_what_is_read(spark, tmp_path):
    from scanloom.sources import files

    at = f"{tmp_path}/records"
    files.save_atomically(spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"), at)
    for _ in range(2):
        old = spark.read.schema("id BIGINT, v STRING").json(at)
        files.upsert_file(spark.createDataFrame([(2, "new"), (3, "c")], "id long, v string"), old, "id", at)
    assert sorted(tuple(r) for r in spark.read.schema("id BIGINT, v STRING").json(at).collect()) == [(1, "a"), (2, "new"), (3, "c")]
    assert [p.name for p in tmp_path.iterdir()] == ["records"]


def test_a_stream_curates_each_entry_once(spark, tmp_path):
    from scanloom.streaming.curation import curate_stream

    ddl = "doc_id long, ordinal long, value string"
    for k, rows in enumerate([[(1, 1, "a"), (1, 2, "b")], [(1, 2, "b"), (2, 1, None)], [(1, 1, "a"), (3, 1, " ")]]):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(ddl).parquet(f"{tmp_path}/in")
        got = curate_stream(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted((r["doc_id"], r["ordinal"], r["valid"], r["reason"]) for r in got.collect()) == [(1, 1, True, None), (1, 2, True, None), (2, 1, False, "processing_error"), (3, 1, False, "empty_value")]


def test_lines_are_grouped_without_the_words_texts(spark, sf):
    plan = Q.QUERIES["line_grouping"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    step = next(x for x in plan.splitlines() if "MapInArrow" in x)
    assert "y#" in step and "text#" not in step and "conf#" not in step
