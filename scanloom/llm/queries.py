"""The operators applied to their whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import held_out_scores

    return held_out_scores(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import edit_likeness

    return edit_likeness(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import similar

    return similar(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, token_pieces

    pieces = token_pieces(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return pack(pieces)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    q = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), name="q", carry=["doc_id"])
    counts = [F.col(f"q.{k}") for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return q.select("doc_id", *counts, "q.base_failed", "q.kept", F.round("q.posterior", 6).alias("quality"), "q.votes")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents have no paths, so each gets one: ten to a directory, ten directories to a group, ten groups to a
    repository; the first document of each of these is its licence file."""
    from .licenses import scan_licenses

    path = F.expr("""concat('repo', doc_id div 1000, '/', CASE WHEN doc_id % 1000 = 0 THEN 'LICENSE' WHEN doc_id % 100 = 0 THEN concat('g', doc_id div 100, '/LICENSE')
        WHEN doc_id % 10 = 0 THEN concat('g', doc_id div 100, '/d', doc_id div 10, '/LICENSE') ELSE concat('g', doc_id div 100, '/d', doc_id div 10, '/', doc_id, '.txt') END)""")
    return scan_licenses(table(spark, sf_dir, "documents").withColumn("path", path), "doc_id", "path")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import capture

    records, index = capture(table(spark, sf_dir, "pages"))
    place = index.select("file", "start", "url_key", F.col("ts").alias("captured"), F.col("part").alias("index_part"), F.col("place").alias("index_place"))
    return records.join(place, ["file", "start"]).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "index_part", "index_place")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_fm import crc_mod, score, train

    docs = table(spark, sf_dir, "documents")
    machine = train(docs, table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 3) != 1), meta=["n_chars"])
    return score(docs, machine).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document, range-sorted by the training position of its first pass; documents that no pass takes have none."""
    from .mixing import curriculum, mix, positions, word_count
    from .shared import shared_dir, stored

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("size"), F.xxhash64("text").alias("mark"))
    mixed = mix(stored(docs, f"{shared_dir(spark)}/documents"), size_col="size", spread=["doc_id", "mark"], name="mix")
    first = curriculum(mixed, untaken=True).filter("mix.pass IS NULL OR mix.pass = 0")
    return first.select("doc_id", "size", "mix.source_size", "mix.target", "mix.taken", "mix.passes", F.col("mix.position").alias("first_position"), positions().alias("positions"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_fm import crc_mod
    from .toxicity import score, train

    docs, held_out = table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) == 0
    model = train(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .compaction import compact

    return compact(table(spark, sf_dir, "clicks"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


#: Shingles as texts, all pairs that share one, and the documents that links reach.
OP3 = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [1] ELSE range(1, len(ws) - 3) END) AS i FROM w)),
 n AS (SELECT w.doc_id, count(g.s) AS n FROM w LEFT JOIN g ON w.doc_id = g.doc_id GROUP BY w.doc_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
 l AS (SELECT a, b, c = x.n AND c = y.n AS equal FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
 r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.root FROM r JOIN l ON r.doc_id = l.a),
 k AS (SELECT doc_id, least(doc_id, (SELECT min(b) FROM l WHERE a = n.doc_id AND equal)) AS same FROM n),
 d AS (SELECT a AS doc_id, count(*) FILTER (WHERE equal) AS copies, count(DISTINCT same) FILTER (WHERE NOT equal) AS links FROM l JOIN k ON l.b = k.doc_id GROUP BY a)
 SELECT n.doc_id, n.n AS n_shingles, (SELECT min(root) FROM r WHERE r.doc_id = n.doc_id) AS component_id, 1 + coalesce(copies, 0) AS n_copies, coalesce(links, 0) AS n_links FROM n LEFT JOIN d ON n.doc_id = d.doc_id"""


#: Every document runs through every order; a failure's letter stands in a list of what it fails.
OP12 = r"""WITH RECURSIVE w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 f AS (SELECT part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c,
   regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false) AS good,
   coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1), false) AS toxic FROM w),
 k AS (SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails,
   count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY ALL),
 o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || x FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE NOT contains(filter_order, x)),
 s AS (SELECT filter_order, CAST(i AS INTEGER) AS step, filter_order[i] AS x, filter_order[:i - 1] AS earlier FROM o, range(1, 6) r(i) WHERE length(filter_order) = 5),
 g AS (SELECT part, filter_order, step, x, n, good, toxic, fails, contains(fails, x) AS hit, length(translate(fails, earlier, '')) < length(fails) AS gone FROM k, s),
 t AS (SELECT part, filter_order, step, x, sum(n) FILTER (WHERE NOT hit AND NOT gone) AS kept, sum(n) FILTER (WHERE hit AND NOT gone) AS removed, sum(n) FILTER (WHERE hit AND gone) AS redundant,
   sum(n) FILTER (WHERE fails = x) AS unique_fails, sum(good) FILTER (WHERE hit AND NOT gone) AS good_lost, sum(toxic) FILTER (WHERE hit AND NOT gone) AS toxic_lost FROM g GROUP BY ALL)
 SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
   CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
   CAST(coalesce(sum(removed) OVER (PARTITION BY part, x), 0) AS BIGINT) AS shapley FROM t"""


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_jaccard": OP3, "op12_filter_audit": OP12}
