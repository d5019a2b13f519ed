"""Queries of the extraction profiles, document records, links and OCR variants, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import patterns as P, text as T
from ..operators import alignment as A, layout as L, linking as K, records as R
from ..sources import views as V
from . import documents as D, duck as S

_INV, _PAGES, _BOXES, _REV = (V.duck(x) for x in (V.INVOICES, V.PAGES, V.BOXES, V.REVIEWS))
_CLEAN = f"(SELECT doc_id, {S.PLAIN} AS text FROM {_INV})"
_LINES = f"(SELECT doc_id, CAST(unnest(range(len(ls))) AS BIGINT) AS line, unnest(ls) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {_INV}))"


def _join(c: Column) -> Column:
    return F.array_join(c, "|")


def _inv(spark: SparkSession, sf: str) -> DataFrame:
    return V.view(spark, sf, V.INVOICES)


def _extractor(clean: bool, **columns):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        t = F.col("text")
        rows = _inv(spark, sf).select("doc_id", T.clean_spaces(t).alias("text")) if clean else _inv(spark, sf)
        return rows.select("doc_id", *[f(t).alias(k) for k, f in columns.items()])

    return query


def _of(f):
    return lambda t: _join(f(t))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with the invoice text; the page of every seventh document's second page failed."""
    failed = (F.col("doc_id") % 7 == 0) & (F.col("page_no") == 2)
    rows = V.view(spark, sf, V.PAGES, "o_orderkey").join(V.view(spark, sf, V.INVOICES, "o_orderkey"), "doc_id")
    return rows.select("path", F.when(~failed, F.col("text")).alias("text"), F.when(F.col("doc_id") % 2 == 0, "de").alias("lang"), (F.col("doc_id") % 5 != 0).alias("has_boxes"))


def _base() -> Column:
    return F.regexp_extract("file_name", r"doc(\d+)", 1).cast("long").alias("doc_id")


def _regex_documents(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("ground_truth.gt_parse.entities")
    return D.regex_documents(_pages(spark, sf)).select(
        _base(), F.col("pages").cast("long").alias("pages"), F.col("ground_truth.metadata.document_type").alias("document_type"), F.col("ground_truth.gt_parse.language").alias("language"), F.length("ground_truth.raw_text").cast("long").alias("chars"), F.col("ground_truth.raw_text").alias("raw_text"),
        _join(e["dates"]).alias("dates"), _join(e["amounts"]).alias("amounts"), _join(e["document_identifiers"]).alias("ids"), e["parties"]["sender"].alias("sender"), e["parties"]["receiver"].alias("receiver"), _join(e["contact_data"]["emails"]).alias("emails"), _join(e["contact_data"]["phone_numbers"]).alias("phones"),
    )


_KIND = "CASE doc_id % 4 WHEN 0 THEN 'rechnung' WHEN 1 THEN 'steuer' WHEN 2 THEN 'brief' ELSE 'other' END"
_GOOD = "(1 + doc_id % 3 - CASE WHEN doc_id % 7 = 0 AND doc_id % 3 > 0 THEN 1 ELSE 0 END)"  # pages that did not fail
_SETS = {"dates": S.regex_dates(), "amounts": S.distinct(S.every(P.REGEX_AMOUNTS)), "ids": S.distinct(S.regex_numbers()), "emails": S.distinct(S.hits(P.REGEX_EMAIL)), "phones": S.distinct(S.regex_phones())}
_LANG = "CASE WHEN doc_id % 2 = 0 THEN 'de' ELSE 'unknown' END"
_REGEX_SQL = f"SELECT doc_id, 1 + doc_id % 3 AS pages, {_KIND} AS document_type, {_LANG} AS language, CAST({_GOOD} * (length(text) + 1) - 1 AS BIGINT) AS chars, array_to_string(list_transform(range({_GOOD}), lambda v: text), chr(10)) AS raw_text, {S.sender()} AS sender, {S.receiver()} AS receiver, " + ", ".join(f"{S.joined(x)} AS {k}" for k, x in _SETS.items()) + f" FROM {_INV}"


def _summary(spark: SparkSession, sf: str) -> DataFrame:
    one = D.summary(D.report(D.regex_documents(_pages(spark, sf))))
    return one.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in one.dtypes])


_MEANS = {"num_dates": "dates", "num_amounts": "amounts", "num_emails": "emails", "num_phones": "phones"}
_SUMMARY_SQL = (
    f"SELECT count(*) AS documents, round(avg(pages), 6) AS mean_pages, count(*) FILTER (WHERE s <> '') AS has_sender, count(*) FILTER (WHERE r <> '') AS has_receiver, round(avg(CAST(s <> '' AS INT)), 6) AS share_has_sender, round(avg(CAST(r <> '' AS INT)), 6) AS share_has_receiver, "
    + ", ".join(f"round(avg({k}), 6) AS mean_{k}" for k in _MEANS)
    + f" FROM (SELECT 1 + doc_id % 3 AS pages, {S.sender()} AS s, {S.receiver()} AS r, "
    + ", ".join(f"len({_SETS[x]}) AS {k}" for k, x in _MEANS.items())
    + f" FROM {_INV})"
)


def _rule_documents(spark: SparkSession, sf: str) -> DataFrame:
    g = F.col("ground_truth.gt_parse")
    e, c = g["entities"], g["content"]
    return D.rule_documents(_pages(spark, sf)).select(
        _base(), F.col("pages").cast("long").alias("pages"), _join(e["dates"]).alias("dates"), _join(e["document_ids"]).alias("document_ids"), _join(e["phones"]).alias("phones"), _join(e["emails"]).alias("emails"), e["language"].alias("language"), F.col("ground_truth.metadata.bboxes_available").alias("boxes"),
        c["header"]["tax_office"].alias("tax_office"), c["recipient"]["name"].alias("name"), c["recipient"]["address"].alias("address"), c["tax_info"]["tax_number"].alias("tax_number"), c["tax_info"]["id_number"].alias("id_number"), _join(c["contact"]["phones"]).alias("page_phones"),
    )


_ADDRESS = S.hits(P.RECIPIENT_ADDRESS, False) + "[1]"
_ORG = f"coalesce({S.hits(P.TAX_ORG)}[1], '')"
_TAX_NO, _ID_NO = (f"coalesce({S.keep('ids', c)}[1], '')" for c in ("contains(v, '/')", "contains(lower(v), 'idnr')"))
_RANKED = f"SELECT doc_id, coalesce(string_agg(v, '|' ORDER BY d DESC, i) FILTER (WHERE n <= 5), '') AS dates FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d DESC NULLS LAST, i) AS n FROM (SELECT doc_id, v, i, {S.parsed('v')} AS d FROM (SELECT doc_id, unnest(ds) AS v, unnest(range(len(ds))) AS i FROM (SELECT doc_id, {S.rule_dates()} AS ds FROM {_CLEAN}))) WHERE d IS NOT NULL) GROUP BY doc_id"
_LONGEST = f"SELECT doc_id, string_agg(v, '|' ORDER BY length(v) DESC, i) AS ids FROM (SELECT doc_id, unnest(ids) AS v, unnest(range(len(ids))) AS i FROM (SELECT doc_id, {S.ids()} AS ids FROM {_CLEAN})) GROUP BY doc_id"
_BOX = "CASE WHEN doc_id % 5 <> 0 THEN {} END"
_RULE_SQL = (
    f"SELECT doc_id, 1 + doc_id % 3 AS pages, coalesce(r.dates, '') AS dates, coalesce(longest, '') AS document_ids, {S.joined(S.distinct('ph'))} AS phones, {S.joined('em')} AS emails, 'de' AS language, doc_id % 5 <> 0 AS boxes, "
    f"{_BOX.format('org')} AS tax_office, {_BOX.format('rn')} AS name, {_BOX.format('ra')} AS address, {_BOX.format(_TAX_NO)} AS tax_number, {_BOX.format(_ID_NO)} AS id_number, {S.joined('ph[1:2]')} AS page_phones "
    f"FROM (SELECT doc_id, {S.rule_phones()} AS ph, {S.rule_emails()} AS em, {S.ids()} AS ids, {_ORG} AS org, {S.recipient('text')} AS rn, {_ADDRESS} AS ra FROM {_CLEAN}) LEFT JOIN ({_RANKED}) r USING (doc_id) LEFT JOIN (SELECT doc_id, ids AS longest FROM ({_LONGEST})) USING (doc_id)"
)


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return _inv(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line").cast("long"))


def _classes(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return _lines(spark, sf).select("doc_id", "line", T.layout_class(t).alias("layout_class"), T.field_type(t).alias("curation_class"), T.colour(T.layout_class(t)).alias("colour"))


_LAYOUT = S.classes("text", P.LAYOUT_CLASSES, "NULL")
_COLOURS = "CASE " + " ".join(f"WHEN c = '{k}' THEN '{v}'" for k, v in P.COLOURS.items()) + f" ELSE '{P.COLOURS['Unknown']}' END"


def _entities(spark: SparkSession, sf: str) -> DataFrame:
    """Capitalised words of documents, and for each document one value that no word has."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("image_id"), F.concat(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b[A-Z][a-z]{5,}"), F.lit(0))), F.array(F.lit("no such word"))).alias("vs"))
    return d.select("image_id", F.lit("name").alias("kind"), F.posexplode("vs").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))


def _links(how: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return K.link(_entities(spark, sf), L.confident(L.ocr_words(spark.read.parquet(f"{sf}/documents.parquet"))), how)

    return query


_ENTITIES = f"SELECT image_id, unnest(range(len(vs))) AS pos, unnest(vs) AS value FROM (SELECT doc_id AS image_id, list_append({S.distinct(S.hits(chr(92) + 'b[A-Z][a-z]{5,}', False))}, 'no such word') AS vs FROM documents)"
_LINK = f"WITH e AS ({_ENTITIES}), w AS ({S.WORDS}), d AS (SELECT image_id, text, min(word_idx) AS word_idx FROM w GROUP BY ALL), v AS (SELECT DISTINCT image_id, value FROM e), h AS (SELECT image_id, value, min(word_idx) AS word_idx FROM v JOIN d USING (image_id) WHERE contains(d.text, v.value) GROUP BY ALL) SELECT image_id, 'name' AS kind, pos, value, word_idx, x, y, w.w AS w, w.h AS h FROM e"
_LINK += " {0} JOIN h USING (image_id, value) {0} JOIN w USING (image_id, word_idx)"


def _variants(spark: SparkSession, sf: str) -> DataFrame:
    """Turns against the next turn as its reading, in six variants."""
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    read = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    pairs = c.select("conv_id", "turn", F.col("text").alias("ref")).join(read, ["conv_id", "turn"])
    rows = K.in_variants(V.spread(pairs))  # comparing is dear, and a pair is short
    text = F.when(F.col("input") == "processed", F.replace("hyp", F.lit("e"), F.lit("c"))).otherwise(F.col("hyp"))
    text = F.when(F.col("filter") == "basic", F.lower(text)).when(F.col("filter") == "advanced", F.translate(text, ".,", "")).otherwise(text)
    rows = rows.select(F.concat_ws("-", "conv_id", "turn").alias("pair"), "ord", "method", F.length(text).cast("long").alias("text_length"), F.greatest(F.length("ref"), F.length(text)).alias("longer"), "ref", text.alias("text"))
    rows = A.with_edits(rows, "ref", "text")
    return rows.select("pair", "ord", "method", "text_length", F.round(T.similarity_of(F.col("edits"), F.col("longer")), 6).alias("similarity"))


#: edits are counted in bytes there, so each letter of the languages at hand that is not ASCII gets a byte of its own
_LETTERS = "äöüßéèêçñóíáúàâîôûëÄÖÜÉÈÊÇÑÓÍ"
_BYTES = ", ".join(f"chr({k})" for k in [*range(1, 9), 11, 12, *range(14, 32), 127])
_VARIANTS = (
    f"WITH c AS (SELECT conv_id, turn, text FROM conversations), v AS (SELECT a.conv_id, a.turn, a.text AS ref, ord, concat(i, '/', f) AS method, f, CASE i WHEN 'processed' THEN replace(b.text, 'e', 'c') ELSE b.text END AS x FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.turn = b.turn - 1 CROSS JOIN (VALUES (0, 'raw', 'none'), (1, 'raw', 'basic'), (2, 'raw', 'advanced'), (3, 'processed', 'none'), (4, 'processed', 'basic'), (5, 'processed', 'advanced')) m(ord, i, f)), "
    f"t AS (SELECT *, CASE f WHEN 'basic' THEN lower(x) WHEN 'advanced' THEN replace(replace(x, '.', ''), ',', '') ELSE x END AS t FROM v), b AS (SELECT *, translate(ref, '{_LETTERS}', concat({_BYTES})) AS rb, translate(t, '{_LETTERS}', concat({_BYTES})) AS tb FROM t) "
    "SELECT concat(conv_id, '-', turn) AS pair, ord, method, length(t) AS text_length, CASE WHEN greatest(length(ref), length(t)) = 0 THEN 1 ELSE round(1 - levenshtein(rb, tb) / greatest(length(ref), length(t)), 6) END AS similarity FROM b"
)


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    value = F.concat_ws(" ", "value", F.lit("of image"), "image_id")
    return V.view(spark, sf, V.BOXES).select("image_id", "ord", T.label(F.col("field"), value).alias("label"))


def _prompts(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return _inv(spark, sf).select("doc_id", T.prompt(t, T.dates(t), T.document_numbers(t)).alias("prompt"))


def _prompt_list(items: str) -> str:
    return f"coalesce(nullif(array_to_string({items}, ', '), ''), {S.quoted(P.PROMPT_NONE)})"


_PROMPT = [S.quoted(x) for x in P.PROMPT]


def _training(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    rows = _inv(spark, sf).select("doc_id", F.lit("de").alias("language"), F.struct(T.emails(t).alias("emails"), T.document_numbers(t).alias("numbers")).alias("entities"))
    return D.training_rows(rows).select("doc_id", "target")


def _file_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"))
    name = F.expr("CASE doc_id % 4 WHEN 0 THEN concat('Anna_Nowak_', doc_id) WHEN 1 THEN concat('Brief ', doc_id) WHEN 2 THEN concat('12 scan-', doc_id) ELSE concat('x ', doc_id) END")
    return rows.select("doc_id", T.name_from_file(name).alias("name"))


def _languages(spark: SparkSession, sf: str) -> DataFrame:
    lang, t = F.when(F.col("doc_id") % 3 > 0, F.element_at(F.array(F.lit("de"), F.lit("pl")), (F.col("doc_id") % 2 + 1).cast("int"))), F.when(F.col("doc_id") % 5 > 0, F.col("text"))
    t = F.coalesce(t, F.lit(" "))
    return _inv(spark, sf).select("doc_id", T.language_or_guess(lang, t).alias("guessed"), T.language_or_unknown(lang, t).alias("known"), T.language_model(lang).alias("model"), T.language_code(lang, legacy=True).alias("legacy"))


def _search(spark: SparkSession, sf: str) -> DataFrame:
    return R.search(V.view(spark, sf, V.REVIEWS), "7", ["entry_id", "doc_id"], only_open=True).select("entry_id", "doc_id")


def _buckets(spark: SparkSession, sf: str) -> DataFrame:
    return V.view(spark, sf, V.REVIEWS).groupBy(R.attention(F.col("confidence")).alias("attention")).agg(F.count(F.lit(1)).alias("entries"), F.count_if("needs_review").alias("open"))


def _bad_corrections(spark: SparkSession, sf: str) -> DataFrame:
    entries = V.view(spark, sf, V.REVIEWS)
    given = entries.select((F.col("entry_id") * 2).alias("entry_id"), F.lit("x").alias("user_correction"))
    return R.unmatched_corrections(entries, given).select("entry_id")


QUERIES = {
    "dates_regex_profile": _extractor(False, dates=_of(T.dates_regex)),
    "dates_ranked_top5": _extractor(True, dates=_of(lambda t: T.latest(T.dates_rules(t)))),
    "doc_numbers_regex": _extractor(False, numbers=_of(T.document_numbers_regex)),
    "ids_from_dates": _extractor(False, dates=lambda t: _join(T.ids_out_of_dates(F.regexp_extract_all(t, F.lit(r"\d{4}[.-]\d{2}[.-]\d{2,3}"), F.lit(0)), T.document_numbers_regex(t))["dates"]), ids=lambda t: _join(T.ids_out_of_dates(F.regexp_extract_all(t, F.lit(r"\d{4}[.-]\d{2}[.-]\d{2,3}"), F.lit(0)), T.document_numbers_regex(t))["ids"])),
    "topk_ids_by_length": _extractor(True, ids=_of(lambda t: T.longest(T.document_ids(t)))),
    "emails_by_profile": _extractor(False, regex_emails=_of(T.emails_regex), rule_emails=_of(T.emails_rules)),
    "phones_by_profile": _extractor(False, regex_phones=_of(T.phones_regex), rule_phones=_of(T.phones_rules)),
    "receiver_sender": _extractor(False, sender=lambda t: T.parties(t)["sender"], receiver=lambda t: T.parties(t)["receiver"]),
    "address_recipient": _extractor(True, name=T.recipient_name, address=T.recipient_address),
    "tax_header": _extractor(True, tax_office=lambda t: T.first(T.tax_organisations(t)), tax_number=lambda t: T.tax_numbers(T.document_ids(t))["tax_number"], id_number=lambda t: T.tax_numbers(T.document_ids(t))["id_number"]),
    "classify_field": _classes,
    "language_fallback": _languages,
    "name_from_file": _file_names,
    "regex_documents": _regex_documents,
    "rule_documents": _rule_documents,
    "summary_global": _summary,
    "summary_by_language": lambda spark, sf: D.counts(D.report(D.regex_documents(_pages(spark, sf), entities=False)), "language"),
    "entity_box_inner": _links("inner"),
    "entity_box_left": _links("left"),
    "ocr_variant_matrix": _variants,
    "best_variant": lambda spark, sf: K.best_variant(_variants(spark, sf), "pair"),
    "label_text": _labels,
    "prompt_text": _prompts,
    "train_rows": _training,
    "review_search": _search,
    "review_buckets": _buckets,
    "review_errors": _bad_corrections,
}

_DATE_LIKE = S.hits(r"\d{4}[.-]\d{2}[.-]\d{2,3}", False)
_IS_ID = f"regexp_matches(v, {S.quoted(P.ID_AS_DATE)})"
_LANGS = "CASE WHEN doc_id % 3 > 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'de' ELSE 'pl' END END"
_LINK_ORACLE = {how: _LINK.replace("{0}", join) for how, join in (("inner", ""), ("left", "LEFT"))}
_EMPTY_WHEN = "doc_id % 5 = 0"

ORACLES = {
    "dates_regex_profile": f"SELECT doc_id, {S.joined(S.regex_dates())} AS dates FROM {_INV}",
    "dates_ranked_top5": f"SELECT doc_id, coalesce(dates, '') AS dates FROM {_CLEAN} LEFT JOIN ({_RANKED}) USING (doc_id)",
    "doc_numbers_regex": f"SELECT doc_id, {S.joined(S.regex_numbers())} AS numbers FROM {_INV}",
    "ids_from_dates": f"SELECT doc_id, {S.joined(S.keep(_DATE_LIKE, 'NOT ' + _IS_ID))} AS dates, {S.joined(S.distinct(S.chain([S.regex_numbers(), S.keep(_DATE_LIKE, _IS_ID)])))} AS ids FROM {_INV}",
    "topk_ids_by_length": f"SELECT doc_id, coalesce(ids, '') AS ids FROM {_CLEAN} LEFT JOIN ({_LONGEST}) USING (doc_id)",
    "emails_by_profile": f"SELECT doc_id, {S.joined(S.hits(P.REGEX_EMAIL))} AS regex_emails, {S.joined(S.rule_emails())} AS rule_emails FROM {_INV}",
    "phones_by_profile": f"SELECT doc_id, {S.joined(S.regex_phones())} AS regex_phones, {S.joined(S.rule_phones())} AS rule_phones FROM {_INV}",
    "receiver_sender": f"SELECT doc_id, {S.sender()} AS sender, {S.receiver()} AS receiver FROM {_INV}",
    "address_recipient": f"SELECT doc_id, {S.recipient('text')} AS name, {_ADDRESS} AS address FROM {_CLEAN}",
    "tax_header": f"SELECT doc_id, org AS tax_office, {_TAX_NO} AS tax_number, {_ID_NO} AS id_number FROM (SELECT doc_id, {_ORG} AS org, {S.ids()} AS ids FROM {_CLEAN})",
    "classify_field": f"SELECT doc_id, line, c AS layout_class, curation_class, {_COLOURS} AS colour FROM (SELECT doc_id, line, {_LAYOUT} AS c, {S.classes('text', P.CURATION_CLASSES, chr(39) + 'Unknown' + chr(39))} AS curation_class FROM {_LINES})",
    "language_fallback": f"SELECT doc_id, coalesce(l, CASE WHEN {_EMPTY_WHEN} THEN 'nl' ELSE 'de' END) AS guessed, CASE WHEN {_EMPTY_WHEN} THEN 'unknown' ELSE coalesce(l, 'unknown') END AS known, 'de' AS model, CASE l WHEN 'de' THEN 'du' WHEN 'pl' THEN 'pl' ELSE 'en' END AS legacy FROM (SELECT o_orderkey AS doc_id, {_LANGS.replace('doc_id', 'o_orderkey')} AS l FROM orders)",
    "name_from_file": "SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN 'Anna Nowak' WHEN 1 THEN 'Brief' WHEN 2 THEN concat('scan-', o_orderkey) END AS name FROM orders",
    "regex_documents": _REGEX_SQL,
    "rule_documents": _RULE_SQL,
    "summary_global": _SUMMARY_SQL,
    "summary_by_language": f"SELECT {_LANG} AS language, count(*) AS documents FROM (SELECT o_orderkey AS doc_id FROM orders) GROUP BY 1",
    "entity_box_inner": _LINK_ORACLE["inner"],
    "entity_box_left": _LINK_ORACLE["left"],
    "ocr_variant_matrix": _VARIANTS,
    "best_variant": f"SELECT pair, arg_min(method, ord) AS method, any_value(similarity) AS similarity FROM (SELECT *, max(similarity) OVER (PARTITION BY pair) AS m FROM ({_VARIANTS})) WHERE similarity = m GROUP BY pair",
    "label_text": f"SELECT image_id, ord, concat(field, ': ', v[1:20], CASE WHEN length(v) > 20 THEN '...' ELSE '' END) AS label FROM (SELECT *, concat(value, ' of image ', image_id) AS v FROM {_BOXES})",
    "prompt_text": f"SELECT doc_id, concat({_PROMPT[0]}, {_prompt_list(S.reader_dates())}, {_PROMPT[1]}, {_prompt_list(S.every(P.READER_NUMBERS))}, {_PROMPT[2]}, text[1:{P.PROMPT_CHARS}], {_PROMPT[3]}) AS prompt FROM {_INV}",
    "train_rows": f"SELECT doc_id, concat('<s_de><s_dokument>', CAST(to_json({{'emails': {S.distinct(S.hits(P.READER_EMAIL))}, 'numbers': {S.every(P.READER_NUMBERS)}}}) AS VARCHAR), '</s>') AS target FROM {_INV}",
    "review_search": f"SELECT entry_id, doc_id FROM {_REV} WHERE needs_review AND contains(concat(entry_id, ' ', doc_id), '7')",
    "review_buckets": f"SELECT CASE WHEN confidence < 0.5 THEN 'high' WHEN confidence < 0.8 THEN 'medium' ELSE 'low' END AS attention, count(*) AS entries, count(*) FILTER (WHERE needs_review) AS open FROM {_REV} GROUP BY 1",
    "review_errors": f"WITH r AS {_REV} SELECT entry_id * 2 AS entry_id FROM r WHERE entry_id * 2 NOT IN (SELECT entry_id FROM r)",
}
