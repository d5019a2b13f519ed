"""Entities to word boxes, points to boxes, and comparison of OCR variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.files import kept, workspace

# What the variants of an OCR comparison combine.
INPUTS, FILTERS = ["raw", "processed"], ["none", "basic", "advanced"]


#: Openings of values are told apart by their hash in so many slots: what is broadcast has no more rows, whatever the table.
SLOTS = 1 << 18


def link(entities: DataFrame, words: DataFrame, how: str = "left") -> DataFrame:
    """entities (image_id, kind, pos, value) with the box of the image's first word that contains the value: x, y, w, h
    and word_idx, null (left) or the row left out (inner) without such a word. Null values match nothing.

    An image's different words meet its different values by the value's first three characters (all of a shorter one),
    which a word that contains it has somewhere, so a page of many words and many values is no product of both. Parts of
    words that open no value of any image go where they arise: only the others are exchanged. What passes by a shared slot
    meets no value later on."""
    values = entities.filter("value IS NOT NULL").select("image_id", "value", F.substring("value", 1, 3).alias("_g"))
    openings = values.select(_slot("_g").alias("_slot"), F.length("_g").alias("_n")).distinct()
    keyed = candidates(words, kept(openings, f"{workspace(entities.sparkSession)}/openings"))
    keyed = keyed.groupBy("image_id", "_g", "_t").agg(F.min("_w").alias("_w"))
    hit = values.distinct().join(keyed, ["image_id", "_g"]).filter(F.contains("_t", "value")).groupBy("image_id", "value").agg(F.min("_w").alias("_w"))
    return entities.join(hit, ["image_id", "value"], how).select("image_id", "kind", "pos", "value", "_w.*")


def _slot(part: str) -> Column:
    return F.pmod(F.xxhash64(part), F.lit(SLOTS))


def candidates(words: DataFrame, openings: DataFrame) -> DataFrame:
    """Words (image_id, _t, _w) with each part _g of theirs whose slot is one of the openings' (_slot and _n, its length)."""
    sizes = sorted(r[0] for r in openings.select("_n").distinct().collect())  # four at most
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)))).alias("_i")
    places = words.select("image_id", F.col("text").alias("_t"), F.struct("word_idx", "x", "y", "w", "h").alias("_w"), at)
    # a place's parts of the sizes that values open with; the empty one once for each word
    parts = [F.substring(F.col("_t"), F.col("_i"), F.lit(n)) if n else F.when(F.col("_i") == 1, "") for n in sizes] or [F.lit(None).cast("string")]
    rows = places.select("image_id", "_t", "_w", (F.explode(F.array_distinct(F.array(*parts))) if len(parts) > 1 else parts[0]).alias("_g"))
    return rows.join(F.broadcast(openings.select("_slot").distinct()), _slot("_g") == F.col("_slot"), "left_semi")


def display_scale(width: str = "width", height: str = "height", most: int = 1200) -> Column:
    return F.least(most / F.col(width), most / F.col(height))


def variants(spark: SparkSession) -> DataFrame:
    """The six methods: ord, input, filter, method."""
    lists = spark.range(1).select(F.posexplode(F.array(*map(F.lit, INPUTS))).alias("i", "input")).select("i", "input", F.posexplode(F.array(*map(F.lit, FILTERS))).alias("j", "filter"))
    return lists.select((F.col("i") * len(FILTERS) + F.col("j")).cast("long").alias("ord"), "input", "filter", F.concat_ws("/", "input", "filter").alias("method"))


def in_variants(rows: DataFrame) -> DataFrame:
    """rows once for each of the six methods, with its ord, input, filter and method: lists unfolded, so no join."""
    methods = [F.struct(F.lit(k * len(FILTERS) + j).cast("long").alias("ord"), F.lit(i).alias("input"), F.lit(f).alias("filter"), F.lit(f"{i}/{f}").alias("method")) for k, i in enumerate(INPUTS) for j, f in enumerate(FILTERS)]
    return rows.select("*", F.inline(F.array(*methods)))


def best_variant(scored: DataFrame, key: str) -> DataFrame:
    """Per key the method of the highest similarity, the first in ord among equals."""
    best = F.max(F.struct("similarity", (-F.col("ord")).alias("_o"), "method")).alias("_b")
    return scored.groupBy(key).agg(best).select(key, F.col("_b.method").alias("method"), F.col("_b.similarity").alias("similarity"))
