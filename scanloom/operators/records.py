"""Pages to documents, curation, review and incremental joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def page_key(pages: DataFrame) -> DataFrame:
    """Adds base and page (on the last _page suffix, with or without an underscore), file_name (before the first) and
    document_type (the parent folder)."""
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[A-Za-z0-9]+$", "")
    p = r"^(.*)_page_?(\d+)$"
    n = F.regexp_extract(name, p, 2)
    return pages.select("*", F.when(n != "", F.regexp_extract(name, p, 1)).otherwise(name).alias("base"), F.when(n != "", n).otherwise("1").cast("long").alias("page"), F.split_part(name, F.lit("_page"), F.lit(1)).alias("file_name"), F.try_element_at(F.split("path", "/"), F.lit(-2)).alias("document_type"))


def assemble(pages: DataFrame) -> DataFrame:
    """Documents (folder and base) of their pages in order: pages, distinct emails in first order, text length, the last
    page that has a sender."""
    listed = F.array_sort(F.collect_list(F.struct("page", "emails")))
    return pages.groupBy("document_type", "base").agg(F.count(F.lit(1)).alias("pages"), F.array_distinct(F.flatten(F.transform(listed, lambda x: x.emails))).alias("emails"), F.max_by("path", "page").alias("last_path"), F.sum(F.length("text")).alias("chars"))


def curate(entries: DataFrame, kind: Column) -> DataFrame:
    """Adds suggested_name, valid and reason: blank values are empty, and what is no text (null) cannot be processed."""
    reason = F.when(F.col("value").isNull(), "processing_error").when(F.trim("value") == "", "empty_value")
    return entries.select("*", F.when(reason.isNull(), kind).alias("suggested_name"), reason.isNull().alias("valid"), reason.alias("reason"))


def not_done(entries: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """Entries of documents not processed before."""
    return entries.join(done.select(key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of every key in new replaced by new's."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(old.columns))


def apply_corrections(entries: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrections by entry_id: the entry takes the text and needs no review any more."""
    c = corrections.select("entry_id", "user_correction")
    return entries.join(c, "entry_id", "left").withColumn("needs_review", F.col("needs_review") & F.col("user_correction").isNull())


def attention(confidence: Column) -> Column:
    return F.when(confidence < 0.5, "high").when(confidence < 0.8, "medium").otherwise("low")


def to_convert(sources: DataFrame, outputs: DataFrame) -> DataFrame:
    """Sources whose output is missing or older."""
    o = outputs.select(F.col("path").alias("_p"), F.col("mt").alias("_mt"))
    return sources.join(o, sources["path"] == F.col("_p"), "left").filter(F.col("_mt").isNull() | (F.col("mt") > F.col("_mt"))).drop("_p", "_mt")


def unmatched_corrections(entries: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrections of entries that do not exist."""
    return corrections.join(entries.select("entry_id"), "entry_id", "left_anti")


def search(entries: DataFrame, words: str, columns: list[str], only_open: bool = False) -> DataFrame:
    """Entries whose shown columns contain the words in any case; on request only those that still need review."""
    shown = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))
    found = entries.filter(F.contains(shown, F.lit(words.lower())))
    return found.filter("needs_review") if only_open else found


def first_successes(rows: DataFrame, most: int, *order: str, ok: str = "ok") -> DataFrame:
    """The first rows in an order that succeeded; failures do not count."""
    return rows.filter(F.col(ok)).orderBy(*order).limit(most)


def first_rows(rows: DataFrame, most: int | None, *order: str) -> DataFrame:
    """The first rows in an order, all without a limit."""
    return rows if most is None else rows.orderBy(*order).limit(most)


def outcomes(rows: DataFrame, ok: str = "ok") -> DataFrame:
    """One row: succeeded and failed."""
    return rows.agg(F.count_if(ok).alias("succeeded"), F.count_if(~F.coalesce(F.col(ok), F.lit(False))).alias("failed"))
