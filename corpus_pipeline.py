"""From raw documents to packed training sequences: quality rules, quality classifier, near-duplicate removal, mixing
along a curriculum, best-fit packing. Each stage takes (spark, docs, sf_dir) and works on all that the one before kept;
run() writes each stage's result as Parquet in the shared folder and reads it again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scanloom.llm import jaccard, mixing, packing, quality_fm, quality_rules
from scanloom.llm.queries import vocabulary
from scanloom.llm.shared import folders_made, free_name, quoted, removed, shared_dir, stored, table, with_place


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the posterior of the votes accept. Null, empty and short texts go; repeated rows
    have equal verdicts; an empty table stays empty; further columns pass, whatever their names."""
    return quality_rules.accepted(docs)


def by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from the labelled rows of the raw documents, since the rows that
    the rules left have hardly any of the low class. Null and empty texts are scored by their statistics, ties at the
    threshold and repeated rows stay, an empty table stays empty; further columns pass, whatever their names."""
    machine = quality_fm.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter(quality_fm.crc_mod("doc_id", 3) != 1))
    return quality_fm.accepted(docs, machine)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id, of each group of linked documents; of rows with equal ids and texts the first.
    Null and empty texts link with nothing; null ids come after others; an empty table stays empty; further columns
    pass, whatever their names."""
    return jaccard.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, sorted by training position over the files and inside each: what is
    stored keeps the order, for the documents' columns alone may leave this stage. Null sources are a source, null texts
    weigh nothing, rows of equal ids are mixed each for itself, an empty table stays empty; further columns pass."""
    name = free_name(docs, "mix")
    return mixing.curriculum(mixing.mix(docs, name=name), name).select(*map(quoted, docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences: sequence_id, length (2048 tokens at most), ids, doc_ids, and pieces, which say for each
    piece its document, the document's place in the training order (unique for every time that it is taken), number,
    start, length and offset. Windows of the order are packed one after the other, so sequence_id follows the curriculum.
    Null and empty texts are their end alone; rows of equal or null ids have places of their own; no row is left out; an
    empty table gives none; further columns are ignored."""
    rows = with_place(docs.select("doc_id", "text"), "place")
    pieces = packing.token_pieces(rows, vocabulary("byte_bpe_50k.json"), with_ids=True, keep=["place"], cache_size=200_000)
    return packing.sequences(packing.pack(pieces, order_col="place"), keep=["place"])


STAGES = [
    ("quality rules", by_rules),
    ("quality classifier", by_classifier),
    ("n-gram Jaccard join", without_near_duplicates),
    ("mixing to target weights", mixed),
    ("best-fit packing", packed),
]

#: SQL expresses neither the classifier nor the packing; tests/llm/test_plain_versions.py compares every stage with a
#: plain version, and run() with their sequence.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. A stage called alone deletes nothing; here a stage's result is written, and then the
    result before it and the tables that the stage left are read no more and go."""
    docs, at = table(spark, sf_dir, "documents"), shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        with folders_made() as left:
            docs = stored(stage(spark, docs, sf_dir), f"{at}/stage-{k}")
        removed(spark, *left, *[f"{at}/stage-{k - 1}"] * bool(k))
    return docs
