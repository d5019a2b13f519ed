"""From pages to document records. Pages have path, text (null: the page failed), lang (null: not detected) and, for the
rule profile, has_boxes. A document is a folder and a file name without page suffix. No clock is read: processing times
are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..operators.records import page_key

_KEY = ["folder", "base"]


def _keyed(pages: DataFrame) -> DataFrame:
    """Pages with their document's key, brought together by it before extraction: the one exchange carries texts and not
    what is found in them, and the aggregate that follows keeps its partitioning. Extraction is the work, so the number of
    partitions is fixed: by their bytes alone, small tables would leave most tasks empty."""
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return page_key(pages).withColumn("folder", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).repartition(n, *_KEY)


def _by_text(keyed: DataFrame, *rest: str) -> DataFrame:
    """A row for each text of a document, with the other columns of its pages in `_pages`; rows lie by document, so nothing is
    exchanged."""
    return keyed.groupBy(*_KEY, "text").agg(F.collect_list(F.struct(*rest)).alias("_pages"))


def _union(field: str) -> Column:
    """Distinct values of all pages in page order."""
    return F.array_distinct(F.flatten(F.transform("ps", lambda p: F.coalesce(p[field], F.array().cast("array<string>")))))


def _texts() -> Column:
    return F.array_join(F.transform("ps", lambda p: p["text"]), "\n")


def _last(field: str) -> Column:
    """The last page's value that is not empty."""
    return F.coalesce(F.try_element_at(F.filter(F.transform("ps", lambda p: p[field]), lambda x: x != ""), F.lit(-1)), F.lit(""))


def regex_documents(pages: DataFrame, literal: bool = False, entities: bool = True) -> DataFrame:
    """Regex profile, one record per document: sets over pages, the last sender and receiver, all pages counted, failed ones
    without part. literal leaves out dates and parties, as the first version did. Without entities, which are most of the
    work, nothing is looked for in the texts: for callers that read none of what would be found."""
    if not entities:
        none = F.array().cast("array<string>")
        found = _keyed(pages).select(*_KEY, "page", "file_name", "document_type", "lang", "text", *[none.alias(k) for k in ("dates", "amounts", "ids", "emails", "phones")], T.parties(F.col("text"), literal=True).alias("parties"))
        return _regex_records(found)
    # cleaned once and not in each expression that reads it; read once, however many of its document's pages have the text
    t = F.col("_clean")
    texts = _by_text(_keyed(pages), "page", "file_name", "document_type", "lang").withColumn("_clean", T.clean_unicode(F.col("text")))
    found = texts.select(*_KEY, "text", "_pages", T.dates_regex(t, literal).alias("dates"), T.amounts(t).alias("amounts"), T.document_numbers_regex(t).alias("ids"), T.emails_regex(t).alias("emails"), T.phones_regex(t).alias("phones"), T.parties(t, literal).alias("parties"))
    return _regex_records(found.select(*[c for c in found.columns if c != "_pages"], F.inline("_pages")))


def _regex_records(found: DataFrame) -> DataFrame:
    page = F.struct("page", "text", "lang", "dates", "amounts", "ids", "emails", "phones", F.col("parties.sender").alias("sender"), F.col("parties.receiver").alias("receiver"))
    docs = found.groupBy(*_KEY).agg(F.min("file_name").alias("file_name"), F.min("document_type").alias("document_type"), F.count(F.lit(1)).cast("int").alias("pages"), F.array_sort(F.collect_list(page)).alias("ps"))
    docs = docs.withColumn("ps", F.filter("ps", lambda p: p["text"].isNotNull())).withColumn("raw", _texts())
    entities = F.struct(_union("dates").alias("dates"), _union("amounts").alias("amounts"), _union("ids").alias("document_identifiers"), F.struct(_last("sender").alias("sender"), _last("receiver").alias("receiver")).alias("parties"), F.struct(_union("emails").alias("emails"), _union("phones").alias("phone_numbers")).alias("contact_data"))
    lang = F.get(F.filter(F.transform("ps", lambda p: p["lang"]), lambda x: x.isNotNull()), F.lit(0))
    meta = F.struct("document_type", F.lit(None).cast("double").alias("processing_time"), F.lit(None).cast("string").alias("timestamp"))
    truth = F.struct(F.struct(entities.alias("entities"), T.language_or_unknown(lang, F.col("raw")).alias("language")).alias("gt_parse"), F.col("raw").alias("raw_text"), meta.alias("metadata"))
    return docs.select("file_name", "pages", truth.alias("ground_truth"))


def rule_pages(pages: DataFrame, most_phones: int = 2, most_emails: int = 1, entities: bool = True) -> DataFrame:
    """Rule profile per page: entities with their limits, and the content block; a failed page keeps a null text. Organisations
    are filtered from the pages' `organizations`, which an entity model gives (ARRAY<STRING>); without that column there are none.
    Without entities no dates, ids, phones, e-mails or recipients are looked for, which are most of the work: for callers that
    read organisations and tax offices alone."""
    t, none = F.col("t"), F.array().cast("array<string>")
    found = F.coalesce(F.col("organizations"), F.array().cast("array<string>")) if "organizations" in pages.columns else F.array().cast("array<string>")
    keyed = _keyed(pages)
    rest = [c for c in keyed.columns if c not in (*_KEY, "text")]
    if entities:
        # a text is read once, however many of its document's pages have it
        keyed = _by_text(keyed, *rest)
    ok = keyed.withColumn("t", T.clean_spaces(F.col("text")))
    seek = lambda c, default: c if entities else default
    orgs = ok.withColumn("dates", seek(T.dates_rules(t), none)).withColumn("document_ids", seek(T.document_ids(t), none)).withColumn("phones", seek(T.phones_rules(t), none)).withColumn("emails", seek(T.emails_rules(t), none)).withColumn("tax_office", T.tax_office(t)).withColumn("name", seek(T.recipient_name(t), F.lit(""))).withColumn("address", seek(T.recipient_address(t), F.lit(None).cast("string")))
    if entities:
        orgs = orgs.select(*[c for c in orgs.columns if c != "_pages"], F.inline("_pages"))
    orgs = orgs.withColumn("found", found)
    header = F.struct("tax_office", T.first(F.col("dates")).alias("date"))
    recipient = F.struct("name", "address")
    some = lambda s: F.when(F.col("has_boxes"), s)
    contact = F.struct(F.slice("phones", 1, most_phones).alias("phones"), F.slice("emails", 1, most_emails).alias("emails"))
    content = F.struct(some(header).alias("header"), some(recipient).alias("recipient"), some(T.tax_numbers(F.col("document_ids"))).alias("tax_info"), contact.alias("contact"))
    return orgs.select(*_KEY, "page", "file_name", "document_type", F.col("t").alias("text"), "dates", "document_ids", "phones", "emails", T.organisations(F.col("found")).alias("organizations"), T.language_or_guess(F.col("lang"), t).alias("lang"), content.alias("content"), "has_boxes")


def rule_documents(pages: DataFrame, entities: bool = True) -> DataFrame:
    """Rule profile, one record per document with a page that did not fail: latest five dates, longest three ids, first
    phones, e-mails and organisations; content and language of the first page. pages counts all of its pages. Without
    entities see rule_pages()."""
    parts = F.struct("page", "text", "dates", "document_ids", "phones", "emails", "organizations", "lang", "content", "has_boxes")
    listed = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), parts))).alias("ps")
    docs = rule_pages(pages, entities=entities).groupBy(*_KEY).agg(F.min("file_name").alias("file_name"), F.min("document_type").alias("document_type"), F.count(F.lit(1)).cast("int").alias("pages"), listed).filter(F.size("ps") > 0)
    one = F.get("ps", F.lit(0))
    found = F.struct(T.latest(_union("dates")).alias("dates"), T.longest(_union("document_ids")).alias("document_ids"), F.slice(_union("phones"), 1, 3).alias("phones"), F.slice(_union("emails"), 1, 2).alias("emails"), F.slice(_union("organizations"), 1, 3).alias("organizations"), F.coalesce(one["lang"], F.lit("nl")).alias("language"))
    meta = F.struct("document_type", F.lit(None).cast("string").alias("processing_time"), F.exists("ps", lambda p: F.coalesce(p["has_boxes"], F.lit(False))).alias("bboxes_available"))
    truth = F.struct(F.struct(one["content"].alias("content"), found.alias("entities")).alias("gt_parse"), _texts().alias("raw_text"), meta.alias("metadata"))
    return docs.select("file_name", "pages", truth.alias("ground_truth"))


def page_metadata(pages: DataFrame) -> DataFrame:
    """Reader profile, one record per page."""
    t = F.col("text")
    return pages.select(F.col("path").alias("source"), T.language_code(F.col("lang"), legacy=True).alias("language"), t.alias("raw_text"), T.metadata(t).alias("metadata"))


def report(documents: DataFrame) -> DataFrame:
    """A row of counts and flags per regex-profile document."""
    e, g = F.col("ground_truth.gt_parse.entities"), F.col("ground_truth")
    size = lambda c: F.size(c)
    return documents.select(
        F.col("file_name").alias("file"), g["metadata"]["document_type"].alias("type"), "pages", (e["parties"]["sender"] != "").alias("has_sender"), (e["parties"]["receiver"] != "").alias("has_receiver"),
        size(e["dates"]).alias("num_dates"), size(e["amounts"]).alias("num_amounts"), size(e["contact_data"]["emails"]).alias("num_emails"), size(e["contact_data"]["phone_numbers"]).alias("num_phones"), g["gt_parse"]["language"].alias("language"),
    )


def summary(reported: DataFrame) -> DataFrame:
    """One row over all of report()."""
    flags = [F.count_if(f).alias(f) for f in ("has_sender", "has_receiver")] + [F.avg(F.col(f).cast("int")).alias(f"share_{f}") for f in ("has_sender", "has_receiver")]
    return reported.agg(F.count(F.lit(1)).alias("documents"), F.avg("pages").alias("mean_pages"), *flags, *[F.avg(n).alias(f"mean_{n}") for n in ("num_dates", "num_amounts", "num_emails", "num_phones")])


def counts(reported: DataFrame, column: str) -> DataFrame:
    return reported.groupBy(column).agg(F.count(F.lit(1)).alias("documents")).orderBy(F.desc("documents"), column)


def training_rows(documents: DataFrame) -> DataFrame:
    """Rows of image_path, language and entities with the target text of each."""
    return documents.withColumn("target", T.training_target(F.col("language"), F.col("entities")))
