"""Queries of sources, sinks and model rules: each writes with a sink, reads back with a reader, and compares with SQL over
the tables that it came from."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import patterns as P, text as T
from ..operators import images as I, linking as K, models as M, records as R
from ..sources import buckets as B, files as S, views as V
from . import duck as D

_BOXES, _INV, _REV, _CUR = (V.duck(x) for x in (V.BOXES, V.INVOICES, V.REVIEWS, V.CURATION))

#: a file for each supplier: folder, name, suffix and a text of three pages of words
_FILE = """concat('g', CAST(s_suppkey % 7 AS STRING), '/s', CAST(s_suppkey AS STRING), '.', CASE s_suppkey % 6 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' WHEN 2 THEN 'pdf' WHEN 3 THEN 'JPEG' WHEN 4 THEN 'bmp' ELSE 'txt' END)"""
_NAME = "concat('Supplier ', CAST(s_suppkey AS STRING), ' of nation ', CAST(s_nationkey AS STRING))"


def _tree(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """The files of all suppliers below a new folder, and the outcome of writing them. Every eleventh has no content, and
    every thirteenth only the second encoder takes."""
    root = f"{S.workspace(spark)}/files"
    rows = spark.read.parquet(f"{sf}/supplier.parquet")
    content = F.concat(F.when(F.col("s_suppkey") % 13 == 0, "odd ").otherwise(""), F.expr(_NAME)).cast("binary")
    files = rows.select(F.expr(_FILE).alias("path"), F.when(F.col("s_suppkey") % 11 > 0, content).alias("content"))

    def strict(data: bytes) -> bytes:
        if data.startswith(b"odd "):
            raise ValueError("odd")
        return data

    S.write_files(files, root, [strict, lambda data: data[4:]]).write.parquet(f"{root}-written")
    return root, spark.read.parquet(f"{root}-written")


def _relative(root: str, path: str = "path") -> Column:
    return F.substring_index(path, f"{root.rsplit('/', 2)[-2]}/files/", -1)


_TREE = f"(SELECT {_FILE} AS path, {_NAME} AS text, s_suppkey % 11 > 0 AS ok FROM supplier)".replace(" AS STRING", " AS VARCHAR")


def _written(spark: SparkSession, sf: str) -> DataFrame:
    return _tree(spark, sf)[1]


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return R.outcomes(_tree(spark, sf)[1])


def _pictures(spark: SparkSession, sf: str) -> DataFrame:
    root, _ = _tree(spark, sf)
    return S.listing(spark, root).select(_relative(root).alias("path"), "length")


def _convertible(spark: SparkSession, sf: str) -> DataFrame:
    root, _ = _tree(spark, sf)
    rows = S.convertible(spark, root).select("kind", _relative(root).alias("path"), S.has_suffix(F.col("path"), S.PICTURES).alias("picture"), S.output_path(F.col("path"), "/files", "/out", "jpg").alias("output"))
    return rows


def _words_of(data: bytes):
    """A stand-in for OCR: the words of a text, one below the other, less and less sure."""
    for k, w in enumerate(data.decode().split(" ")):
        yield w, 10, 20 * k, 8 * len(w), 12, 90.0 - 20 * k


def _ocr(spark: SparkSession, sf: str) -> DataFrame:
    root, _ = _tree(spark, sf)
    return S.words(S.listing(spark, root, "*"), _words_of).select(_relative(root).alias("path"), F.col("word_idx").cast("long").alias("word_idx"), "text", F.col("y").cast("long").alias("y"), "conf")


def _ocr_text(spark: SparkSession, sf: str) -> DataFrame:
    root, _ = _tree(spark, sf)
    return S.ocr_text(S.listing(spark, root, "*"), _words_of, 40).select(_relative(root).alias("path"), "text")


def _pages_of_pdf(data: bytes):
    """A stand-in for a decoder: a page for each word; a supplier whose number ends in 8 cannot be read."""
    words = data.split(b" ")
    if words[1].endswith(b"8"):
        raise ValueError("no pages")
    yield from words if int(words[1]) % 5 else words[:1]


def _pdf(spark: SparkSession, sf: str) -> DataFrame:
    root, _ = _tree(spark, sf)
    files = S.convertible(spark, root).filter("kind = 'pdf'")
    pages = S.page_files(S.page_images(files, _pages_of_pdf))
    return pages.filter("error IS NULL").select(_relative(root).alias("path"), F.col("page").cast("long").alias("page"), "name", F.col("content").cast("string").alias("content"))


_DOC = "file_name STRING, pages BIGINT, raw_text STRING"


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    """Two thirds of the documents anew, then the last third behind them; read as one."""
    at = f"{S.workspace(spark)}/documents"
    rows = V.view(spark, sf, V.INVOICES).select("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("file_name"), (F.col("doc_id") % 3 + 1).cast("long").alias("pages"), F.col("text").alias("raw_text"))
    part = lambda c: rows.filter(c).drop("doc_id")
    S.write_documents(part("doc_id % 3 = 2"), at)
    S.write_documents(part("doc_id % 3 < 2"), at, ordered=True)
    S.append_documents(part("doc_id % 3 = 2"), at)
    return S.read_documents(spark, at, _DOC)


def _images(spark: SparkSession, sf: str) -> DataFrame:
    boxes = V.view(spark, sf, V.BOXES)
    bbox = F.array(*[F.col(c).cast("int") for c in ("x1", "y1", "x2", "y2")])
    one = F.struct("ord", "field", "value", bbox.alias("bbox"), F.col("confidence").cast("double").alias("confidence"))
    listed = F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["field"].alias("field"), x["value"].alias("value"), x["bbox"].alias("bbox"), x["confidence"].alias("confidence")))
    # grouped by the view's own key, which its boxes lie by already; as a string it would take another exchange
    images = boxes.groupBy("image_id").agg(listed.alias("annotations")).select(F.col("image_id").cast("string").alias("image_id"), "annotations")
    return images.withColumn("image_path", F.concat(F.lit("/in/"), "image_id", F.lit(".jpg")))


def _flat(rows: DataFrame) -> DataFrame:
    parts = rows.select("image_id", "image_path", F.posexplode("annotations").alias("k", "a"))
    return parts.select(F.col("image_id").cast("long").alias("image_id"), "image_path", (F.col("k") + 1).cast("long").alias("ord"), "a.field", "a.value", F.get("a.bbox", F.lit(2)).cast("long").alias("x2"), F.col("a.confidence").cast("long").alias("confidence"))


def _keyed(spark: SparkSession, sf: str) -> DataFrame:
    """Files that hold one object keyed by image, a thousand images or fewer each."""
    at = f"{S.workspace(spark)}/keyed"
    entry = F.struct("image_id", F.struct("image_id", "image_path", "annotations").alias("r"))
    objects = _images(spark, sf).groupBy((F.col("image_id").cast("long") / 1000).cast("long").alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    objects.repartition("part").select("part", "value").write.partitionBy("part").text(at)
    return _flat(S.read_annotations(spark, at).drop("part"))


_FLAT = "SELECT image_id, concat('/in/', image_id, '.jpg') AS image_path, ord, field, {} AS value, x2, confidence FROM {}"


def _upserted(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth image's record replaced in its own file."""
    at = f"{S.workspace(spark)}/annotations"
    images = _images(spark, sf)
    S.save_atomically(images, at)
    old = spark.read.schema(images.schema).json(at)
    fixed = F.transform("annotations", lambda a: a.withField("value", F.lit("fixed")))
    S.upsert_file(old.filter("image_id % 5 = 0").withColumn("annotations", fixed), old, "image_id", at)
    return _flat(spark.read.schema(images.schema).json(at))


def _reviews(spark: SparkSession, sf: str) -> DataFrame:
    """All reviews saved, the unsure ones corrected and saved over them."""
    at = f"{S.workspace(spark)}/reviews"
    original = F.struct(F.concat(F.lit("text of "), F.col("doc_id").cast("string")).alias("value"))
    rows = V.view(spark, sf, V.REVIEWS).select("entry_id", F.lit("Date").alias("suggested_name"), "confidence", original.alias("original"), F.lit(None).cast("string").alias("translated_text"), "needs_review", F.lit(None).cast("string").alias("user_correction"))
    S.write_reviews(rows, at)
    saved = S.read_review_lines(spark, at)
    fixes = saved.filter("confidence < 0.3").select("entry_id", F.concat(F.lit("fixed "), "original.value").alias("user_correction"))
    S.write_reviews(R.apply_corrections(saved.drop("user_correction"), fixes), at)
    return S.read_review_lines(spark, at).select("entry_id", "confidence", F.col("original.value").alias("value"), "needs_review", "user_correction")


def _results(spark: SparkSession, sf: str) -> DataFrame:
    """Curated entries as lines, with broken lines among them, read as the results of a run before."""
    at = f"{S.workspace(spark)}/results"
    rows = R.curate(V.view(spark, sf, V.CURATION), M.field_class(F.col("value"))).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("ordinal").cast("int").alias("ordinal"), "value", "suggested_name", "valid", "reason")
    line = F.to_json(F.struct(*rows.columns))
    broken = F.when(F.col("ordinal") % 97 == 0, F.array(line, F.substring(line, 1, 20))).otherwise(F.array(line))
    rows.select(F.explode(broken).alias("value")).write.text(at)
    return S.read_results(spark, at).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "value", "suggested_name", "valid", "reason")


def _training(spark: SparkSession, sf: str) -> DataFrame:
    """Files that hold one list each, of a hundred rows or fewer."""
    at = f"{S.workspace(spark)}/training"
    row = F.struct(F.concat(F.lit("/in/"), F.col("doc_id").cast("string")).alias("image_path"), F.lit("de").alias("language"), F.to_json(F.struct(T.emails(F.col("text")).alias("emails"))).alias("entities"))
    lists = V.view(spark, sf, V.INVOICES).groupBy((F.col("doc_id") / 100).cast("long").alias("part")).agg(F.to_json(F.collect_list(row)).alias("value"))
    lists.select("value").repartition(8).write.option("lineSep", "\n").text(at)
    lines = spark.read.text(at)  # each line is a file's list
    return lines.select(F.inline(F.from_json("value", f"ARRAY<STRUCT<{', '.join(x.replace(' ', ': ') for x in S.schemas.TRAINING_ROW.split(', '))}>>")))


def _bucketed(spark: SparkSession, sf: str) -> DataFrame:
    """All boxes stored by image, then those of every hundredth image corrected and a few new ones put in."""
    at, ddl = f"{S.workspace(spark)}/boxes", "image_id BIGINT, ord BIGINT, field STRING, value STRING"
    old = V.view(spark, sf, V.BOXES).select("image_id", "ord", "field", "value")
    B.upsert_buckets(old, "image_id", at, ddl)
    some = old.filter("image_id % 100 = 1 AND ord < 3").withColumn("value", F.lit("corrected"))
    added = old.filter("image_id % 100 = 2 AND ord = 1").withColumn("image_id", -F.col("image_id"))
    B.upsert_buckets(some.unionByName(added), "image_id", at, ddl)
    return B.read_buckets(spark, at, ddl)


def _apart(rows: DataFrame, at: str) -> None:
    """Write each row's `value` as a file of its own in a folder of its `part`."""
    rows.repartition("part").write.option("lineSep", "\n").partitionBy("part").text(at)


def _training_files(spark: SparkSession, sf: str) -> DataFrame:
    """Lists in files of their own, read as training files are."""
    at = f"{S.workspace(spark)}/training"
    row = F.struct(F.concat(F.lit("/in/"), F.col("doc_id").cast("string")).alias("image_path"), F.lit("de").alias("language"), F.to_json(F.struct(T.phones(F.col("text")).alias("phones"))).alias("entities"))
    _apart(V.view(spark, sf, V.INVOICES).groupBy((F.col("doc_id") / 1000).cast("long").alias("part")).agg(F.to_json(F.collect_list(row)).alias("value")), at)
    return S.read_training(spark, at).select("image_path", "language", "entities")


def _review_files(spark: SparkSession, sf: str) -> DataFrame:
    """Review files of a thousand documents' entries each, read as they are."""
    at = f"{S.workspace(spark)}/reviews"
    original = F.struct(F.concat(F.lit("text of "), F.col("doc_id").cast("string")).alias("value"))
    rows = V.view(spark, sf, V.REVIEWS).select((F.col("doc_id") / 1000).cast("long").alias("part"), F.struct("doc_id", F.struct(F.lit("Date").alias("suggested_name"), "confidence", original.alias("original"), "needs_review").alias("e")).alias("s"))
    listed = rows.groupBy("part").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["e"]).alias("entries"))
    _apart(listed.select("part", F.to_json(F.struct(F.size("entries").alias("count"), "entries")).alias("value")), at)
    return S.read_reviews(spark, at).select(F.col("entry_id").cast("long").alias("entry_id"), "suggested_name", "confidence", F.col("original.value").alias("value"), "needs_review", "user_correction")


def _display_scales(spark: SparkSession, sf: str) -> DataFrame:
    """The scale at which each image, as wide and high as its boxes reach, is shown."""
    pages = V.view(spark, sf, V.BOXES).groupBy("image_id").agg(F.max("x2").alias("width"), F.max("y2").alias("height"))
    return pages.select("image_id", F.round(K.display_scale(), 9).alias("scale"))


def _entity_structs(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    rows = V.view(spark, sf, V.INVOICES).select("doc_id", F.posexplode(T.entity_structs(F.concat(T.emails(t), T.document_numbers(t)), 3)).alias("pos", "e"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "e.value", F.col("e.bbox").isNotNull().alias("has_box"))


def _summaries(spark: SparkSession, sf: str) -> DataFrame:
    """A stand-in model that repeats its prompt's first line in stars, fails on some and has nothing to say on others."""
    at = f"{S.workspace(spark)}/summaries"

    def model(prompt: str) -> str:
        if prompt.endswith("7"):
            raise ValueError("no answer")
        return "" if prompt.endswith("3") else f"** {prompt} **"

    rows = V.view(spark, sf, V.INVOICES).select(F.concat(F.lit("/in/doc"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("source"), F.when(F.col("doc_id") % 4 > 0, F.col("text")).otherwise(" \n").alias("text"), F.concat(F.lit("summary of "), F.col("doc_id").cast("string")).alias("prompt"))
    S.write_summaries(M.summaries(rows, model).select("source", F.col("summary").alias("text")), at, "20240102_030405")
    return spark.read.schema("source STRING, file STRING, text STRING").json(at)


def _metadata_files(spark: SparkSession, sf: str) -> DataFrame:
    at = f"{S.workspace(spark)}/metadata"
    t = F.col("text")
    source = F.concat(F.lit("/in/"), (F.col("doc_id") % 5).cast("string"), F.lit("/doc"), (F.col("doc_id") / 5).cast("long").cast("string"), F.lit(".jpg"))
    pages = V.view(spark, sf, V.INVOICES).select(source.alias("source"), F.lit("de").alias("language"), t.alias("raw_text"), F.struct(T.emails(t).alias("emails")).alias("metadata"))
    S.write_page_metadata(pages, at)
    meta = spark.read.schema("source STRING, name STRING, language STRING, metadata STRUCT<emails: ARRAY<STRING>>").json(f"{at}/metadata")
    text = spark.read.schema("source STRING, raw_text STRING").json(f"{at}/text")
    return meta.join(text, "source").select("source", "name", "language", F.array_join("metadata.emails", "|").alias("emails"), F.length("raw_text").cast("long").alias("chars"))


def _tables(spark: SparkSession, sf: str) -> DataFrame:
    """Two sheets, read back as one."""
    at = f"{S.workspace(spark)}/tables"
    rev = V.view(spark, sf, V.REVIEWS)
    S.write_tables({"open": rev.filter("needs_review"), "done": rev.filter("NOT needs_review")}, at)
    read = lambda name: spark.read.schema(rev.schema).option("header", True).csv(f"{at}/{name}").withColumn("sheet", F.lit(name))
    return read("open").unionByName(read("done"))


def _batches(spark: SparkSession, sf: str) -> DataFrame:
    """Entries that come as a stream of several files, saved batch by batch."""
    at = S.workspace(spark)
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "event_type")
    rows.repartition(5, "event_id").write.parquet(f"{at}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    S.save_batches(stream, f"{at}/out", f"{at}/state")
    return S.read_batches(spark, f"{at}/out", "event_id BIGINT, user_id BIGINT, event_type STRING", "event_id")


def _field_model(spark: SparkSession, sf: str) -> DataFrame:
    """A stand-in model that names a text's length and fails on odd numbers."""

    def model(text: str) -> str:
        if text[-1] in "13579":
            raise ValueError("no class")
        return f" length {len(text)} "

    rows = V.view(spark, sf, V.CURATION)
    value = F.when(F.col("ordinal") % 5 == 0, F.concat(F.rpad(F.lit("long"), 250, "-"), "value")).otherwise(F.col("value"))
    rows = rows.withColumn("value", F.when(F.col("ordinal") % 13 > 0, value))
    return R.curate(rows, M.field_class(F.col("value"), model)).select("doc_id", "ordinal", "suggested_name", "valid", "reason")


def _translated(spark: SparkSession, sf: str) -> DataFrame:
    """A stand-in model that writes capitals and fails on texts with a zero."""

    def model(text: str) -> str:
        if "0" in text:
            raise ValueError("no translation")
        return text.upper()

    value = F.when(F.col("ordinal") % 3 == 0, F.substring("value", 1, 2)).otherwise(F.col("value"))
    return V.view(spark, sf, V.CURATION).withColumn("value", value).select("doc_id", "ordinal", M.translated(F.col("value"), model).alias("translated"))


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", *[F.length(M.sample(t, k)).cast("long").alias(k) for k in M.SAMPLES], F.md5(M.sample(t, "language")).alias("md5"))


def _limits(spark: SparkSession, sf: str) -> DataFrame:
    """The first forty successes and the first forty files of all, both in order of document and page."""
    rows = V.view(spark, sf, V.PAGES).select("doc_id", "page_no", "path", (F.col("doc_id") % 3 > 0).alias("ok"))
    a = R.first_successes(rows, 40, "doc_id", "page_no").withColumn("kind", F.lit("successes"))
    return a.unionByName(R.first_rows(rows, 40, "doc_id", "page_no").withColumn("kind", F.lit("files"))).select("kind", "doc_id", "page_no", "ok")


def _picture(key: int) -> bytes:
    """A dark picture with a bright page whose place and size follow from a number, and lines on it; some are in colour."""
    y, x = np.mgrid[0:90, 0:120]
    page = (y >= 12 + key % 9) & (y < 80 - key % 7) & (x >= 15 + key % 11) & (x < 108 - key % 5)
    out = np.where(page & (y % 9 == 4) & (x % 3 > 0), 30, np.where(page, 210, 35 + key % 20)).astype(np.uint8)
    return I.encode(np.stack([out, out, out], axis=2) if key % 4 == 0 else out)


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    """Every enhancement of every supplier's picture: its size and mean brightness. Every eleventh file is no picture."""
    steps = {"cropped": I.cropped, "deskewed": I.deskew, "gray": I.gray, "binary": lambda x: I.binarize(I.gray(x)), "equalised": lambda x: I.equalize(I.gray(x)), "denoised": lambda x: I.denoise(I.gray(x), 5.0), "sharpened": lambda x: I.sharpen(I.gray(x), amount=0.8, threshold=5), "basic": I.basic, "rgb": I.rgb, "enhanced": I.enhanced}

    def draw(frames):
        for f in frames:
            yield pd.DataFrame([(f"s{k}.pgm", _picture(int(k)) if k % 11 else b"none") for k in f["s_suppkey"]], columns=["path", "content"])

    keys = V.spread(spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey"))
    files = keys.mapInPandas(draw, "path string, content binary")

    def told(image: np.ndarray) -> bytes:
        return f"{image.shape[1]} {image.shape[0]} {image.mean():.3f}".encode()

    every = I.apply_each(files, steps, write=told).withColumn("c", F.split(F.col("content").cast("string"), " "))
    return every.select("path", "step", "ok", "error", F.get("c", F.lit(0)).cast("long").alias("width"), F.get("c", F.lit(1)).cast("long").alias("height"), F.get("c", F.lit(2)).cast("double").alias("mean"))


QUERIES = {
    "image_steps": _steps,
    "files_written": _written, "file_outcomes": _outcomes, "pictures_listed": _pictures, "convertible_listed": _convertible, "ocr_words": _ocr, "ocr_texts": _ocr_text, "pdf_pages": _pdf, "documents_saved": _documents, "annotations_keyed": _keyed,
    "annotations_upserted": _upserted, "reviews_saved": _reviews, "results_read": _results, "annotations_in_buckets": _bucketed, "training_lists": _training, "training_files": _training_files, "review_files": _review_files, "display_scales": _display_scales, "entity_structs": _entity_structs, "summaries_saved": _summaries, "metadata_saved": _metadata_files, "tables_saved": _tables, "batches_saved": _batches,
    "field_model": _field_model, "translations": _translated, "text_samples": _samples, "first_limits": _limits,
}

_PAGES = V.duck(V.PAGES)
_CLASS = D.classes("v", P.CURATION_CLASSES, "NULL")
_EMAILS = D.distinct(D.hits(P.READER_EMAIL))
_SPLIT = f"(SELECT path, unnest(range(len(ws))) AS k, unnest(ws) AS w FROM (SELECT path, string_split(text, ' ') AS ws FROM {_TREE} WHERE ok))"
_BANNER = "concat('ANALIZA DOKUMENTU', chr(10), repeat('=', 40), chr(10), chr(10), 'summary of ', doc_id)"

ORACLES = {
    "files_written": f"SELECT path, ok, CASE WHEN NOT ok THEN 'no content' END AS error FROM {_TREE}",
    "file_outcomes": f"SELECT count(*) FILTER (WHERE ok) AS succeeded, count(*) FILTER (WHERE NOT ok) AS failed FROM {_TREE}",
    "pictures_listed": f"SELECT path, length(text) AS length FROM {_TREE} WHERE ok AND (ends_with(path, '.jpg') OR ends_with(path, '.png'))",
    "convertible_listed": f"SELECT CASE WHEN ends_with(path, 'pdf') THEN 'pdf' ELSE 'image' END AS kind, path, NOT ends_with(path, 'pdf') AS picture, concat('/out/', split_part(path, '.', 1), '.jpg') AS output FROM {_TREE} WHERE ok AND lower(split_part(path, '.', 2)) IN ('jpg', 'jpeg', 'png', 'pdf')",
    "ocr_words": f"SELECT path, k AS word_idx, w AS text, 20 * k AS y, CAST(90 - 20 * k AS DOUBLE) AS conf FROM {_SPLIT}",
    "ocr_texts": f"SELECT path, string_agg(w, ' ' ORDER BY k) AS text FROM {_SPLIT} WHERE 90 - 20 * k > 40 GROUP BY path",
    "pdf_pages": f"SELECT path, k + 1 AS page, concat(split_part(split_part(path, '/', 2), '.', 1), CASE WHEN n % 5 > 0 THEN concat('_page', k + 1) ELSE '' END, '.jpg') AS name, w AS content FROM (SELECT *, CAST(regexp_extract(path, '/s(\\d+)', 1) AS BIGINT) AS n FROM {_SPLIT}) WHERE ends_with(path, '.pdf') AND n % 10 <> 8 AND (n % 5 > 0 OR k = 0)",
    "documents_saved": f"SELECT concat('doc', doc_id) AS file_name, 1 + doc_id % 3 AS pages, text AS raw_text FROM {_INV}",
    "annotations_keyed": _FLAT.format("value", _BOXES),
    "annotations_upserted": _FLAT.format("CASE WHEN image_id % 5 = 0 THEN 'fixed' ELSE value END", _BOXES),
    "reviews_saved": f"SELECT entry_id, confidence, concat('text of ', doc_id) AS value, needs_review AND NOT confidence < 0.3 AS needs_review, CASE WHEN confidence < 0.3 THEN concat('fixed text of ', doc_id) END AS user_correction FROM {_REV}",
    "results_read": f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, ordinal, value, CASE WHEN trim(value) <> '' THEN coalesce({_CLASS.replace('(v,', '(value,')}, 'Unknown') END AS suggested_name, trim(value) <> '' AS valid, CASE WHEN trim(value) = '' THEN 'empty_value' END AS reason FROM {_CUR}",
    "training_lists": f"SELECT concat('/in/', doc_id) AS image_path, 'de' AS language, CAST(to_json({{'emails': {_EMAILS}}}) AS VARCHAR) AS entities FROM {_INV}",
    "annotations_in_buckets": f"WITH b AS {_BOXES} SELECT image_id, ord, field, value FROM b WHERE image_id % 100 <> 1 UNION ALL SELECT image_id, ord, field, 'corrected' FROM b WHERE image_id % 100 = 1 AND ord < 3 UNION ALL SELECT -image_id, ord, field, value FROM b WHERE image_id % 100 = 2 AND ord = 1",
    "training_files": f"SELECT concat('/in/', doc_id) AS image_path, 'de' AS language, CAST(to_json({{'phones': {D.distinct(D.every(P.READER_PHONES, False))}}}) AS VARCHAR) AS entities FROM {_INV}",
    "review_files": f"SELECT row_number() OVER (PARTITION BY doc_id // 1000 ORDER BY doc_id) - 1 AS entry_id, 'Date' AS suggested_name, confidence, concat('text of ', doc_id) AS value, needs_review, CAST(NULL AS VARCHAR) AS user_correction FROM {_REV}",
    "display_scales": f"SELECT image_id, round(least(1200.0::DOUBLE / max(x2), 1200.0::DOUBLE / max(y2)), 9) AS scale FROM {V.duck(V.BOXES)} GROUP BY image_id",
    "entity_structs": f"SELECT doc_id, unnest(range(len(es))) AS pos, unnest(es) AS value, false AS has_box FROM (SELECT doc_id, {D.chain([D.distinct(D.hits(P.READER_EMAIL)), D.every(P.READER_NUMBERS)])}[1:3] AS es FROM {_INV})",
    "summaries_saved": f"SELECT concat('/in/doc', doc_id, '.jpg') AS source, concat('doc', doc_id, '_20240102_030405.txt') AS file, {_BANNER} AS text FROM {_INV} WHERE doc_id % 4 > 0 AND doc_id % 10 NOT IN (3, 7)",
    "metadata_saved": f"SELECT concat('/in/', doc_id % 5, '/doc', doc_id // 5, '.jpg') AS source, concat('doc', doc_id // 5, '.jpg') AS name, 'de' AS language, {D.joined(_EMAILS)} AS emails, length(text) AS chars FROM {_INV}",
    "tables_saved": f"SELECT *, CASE WHEN needs_review THEN 'open' ELSE 'done' END AS sheet FROM {_REV}",
    "batches_saved": "SELECT event_id, user_id, event_type FROM events",
    "field_model": f"SELECT doc_id, ordinal, CASE WHEN v IS NULL OR trim(v) = '' THEN NULL ELSE coalesce({_CLASS}, CASE WHEN right(v[1:200], 1) IN ('1', '3', '5', '7', '9') THEN 'Unknown' ELSE concat('length ', length(v[1:200])) END) END AS suggested_name, v IS NOT NULL AND trim(v) <> '' AS valid, CASE WHEN v IS NULL THEN 'processing_error' WHEN trim(v) = '' THEN 'empty_value' END AS reason FROM (SELECT doc_id, ordinal, CASE WHEN ordinal % 13 = 0 THEN NULL WHEN ordinal % 5 = 0 THEN concat(rpad('long', 250, '-'), value) ELSE value END AS v FROM {_CUR})",
    "translations": f"SELECT doc_id, ordinal, CASE WHEN length(v) < 3 OR contains(v, '0') THEN v ELSE trim(upper(v)) END AS translated FROM (SELECT doc_id, ordinal, CASE WHEN ordinal % 3 = 0 THEN value[1:2] ELSE value END AS v FROM {_CUR})",
    "text_samples": "SELECT doc_id, " + ", ".join(f"length(text[1:{n}]) AS {k}" for k, n in M.SAMPLES.items()) + ", md5(text[1:850]) AS md5 FROM documents",
    "first_limits": f"WITH p AS (SELECT doc_id, page_no, doc_id % 3 > 0 AS ok FROM {_PAGES}) SELECT 'successes' AS kind, * FROM (SELECT * FROM p WHERE ok ORDER BY doc_id, page_no LIMIT 40) UNION ALL SELECT 'files' AS kind, * FROM (SELECT * FROM p ORDER BY doc_id, page_no LIMIT 40)",
}
