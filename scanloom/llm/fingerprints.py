"""Exact document fingerprints: a canonical form, a wide hash of it, and byte comparison inside equal buckets.

Canonical form: NFC, full case folding, NFC again, runs of Unicode white space as one space, none at the ends.
Native: the ICU library that Spark ships does the Unicode steps through java_method, Spark's own functions the rest.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import NumericType

from .shared import id_and_text, numbered, shared_dir, stored, type_of

#: Sets of buckets or rows up to this many (some 50 bytes each) are broadcast, larger ones joined by shuffle; either way
#: gives the same result.
BROADCAST_ROWS = 200_000


def _icu(cls: str, method: str, text: Column, flag: bool) -> Column:
    return F.java_method(F.lit(f"com.ibm.icu.{cls}"), F.lit(method), text, F.lit(flag))


def canonical(text: Column) -> Column:
    """The canonical form of a non-null text."""
    folded = _icu("lang.UCharacter", "foldCase", _icu("text.Normalizer", "compose", text, False), True)
    return F.trim(F.regexp_replace(_icu("text.Normalizer", "compose", folded, False), r"[\s\x{85}\x1c-\x1f\p{Z}]+", " "))


def with_hash(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """df with {name}_hash, 128 bits of xxhash64 under two seeds, and {name}_sha, SHA-256, of the canonical form."""
    canon = df.withColumn("_canon", canonical(F.col(text_col)))
    wide = F.concat(F.lpad(F.hex(F.xxhash64("_canon")), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("second"), F.col("_canon"))), 16, "0"))
    return canon.withColumn(f"{name}_hash", F.lower(wide)).withColumn(f"{name}_sha", F.sha2("_canon", 256)).drop("_canon")


def semi_join(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows of df whose key is in a stored table; its counted size decides between broadcast and shuffle."""
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, on, "left_semi")


def shared_buckets(hashes: DataFrame) -> DataFrame:
    """The hashes (hash) of two rows or more."""
    return hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash")


def collided(texts: DataFrame) -> DataFrame:
    """The hashes (hash) under which the texts (text) have different canonical forms: the smallest and the largest of a
    bucket, combined before the shuffle, are compared byte by byte, so a bucket of a third of all rows is no burden."""
    canon = with_hash(texts, "text", "own").select(F.col("own_hash").alias("hash"), canonical(F.col("text")).alias("canon"))
    return canon.groupBy("hash").agg(F.min("canon").alias("a"), F.max("canon").alias("z")).filter("a <> z").select("hash")


def told_apart(rows: DataFrame, clashes: DataFrame, name: str) -> DataFrame:
    """rows with {name}_fingerprint: the hash, and in buckets of different texts also the SHA-256."""
    c = clashes.select(F.col("hash").alias(f"{name}_hash"), F.lit(True).alias("_clash"))
    joined = rows.join(c, f"{name}_hash", "left")
    return joined.withColumn(f"{name}_fingerprint", F.when(F.col("_clash"), F.concat_ws("-", f"{name}_hash", f"{name}_sha")).otherwise(F.col(f"{name}_hash"))).drop("_clash")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_chars (code points), fingerprint, n_equal (rows of that fingerprint) and first_id.

    Equal fingerprints mean equal canonical forms. Ids may be of any type that has an order. Null texts are empty texts and
    equal each other; null ids and repeated rows stay, and their texts are compared like others; an empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    at = shared_dir(df.sparkSession)
    rows = numbered(id_and_text(df, id_col, text_col), "row")
    hashed = stored(with_hash(rows, "text", "own").select("id", "row", F.length("text").cast("long").alias("n_chars"), "own_hash", "own_sha"), f"{at}/hashed")
    buckets = stored(shared_buckets(hashed.select(F.col("own_hash").alias("hash"))), f"{at}/buckets")
    some = stored(semi_join(hashed.withColumnRenamed("own_hash", "hash"), buckets, "hash").select("row"), f"{at}/some")
    clashes = stored(collided(semi_join(rows, some, "row")), f"{at}/clashes")
    out = told_apart(hashed, clashes, "own")
    groups = out.groupBy("own_fingerprint").agg(F.count(F.lit(1)).alias("n_equal"), F.min("id").alias("first_id"))
    return out.join(groups, "own_fingerprint").select(F.col("id").alias(id_col), "n_chars", F.col("own_fingerprint").alias("fingerprint"), "n_equal", "first_id")


def _cuts(rows: DataFrame, n: int) -> tuple[list, int]:
    """Up to n - 1 ids that part the rows into about equal ranges, one as often as it makes up ranges of its own, and how
    many ranges the rows of null ids fill. They balance the work alone; no result depends on them."""
    total, known = rows.agg(F.count(F.lit(1)), F.count("id")).first()
    empty = -(-(total - known) * n // max(1, total))
    shares = [k / n for k in range(1, n)]
    if isinstance(rows.schema["id"].dataType, NumericType):
        return list(rows.agg(F.percentile_approx("id", shares, 20_000).alias("c")).first()["c"] or []), empty
    part = min(1.0, 40 * n / max(1, known))
    some = sorted(r[0] for r in rows.select("id").filter("id IS NOT NULL").sample(part, 7).collect())
    return [some[int(s * len(some))] for s in shares] if some else [], empty


def with_next(rows: DataFrame, carried: list[str]) -> DataFrame:
    """rows (id, text, ...) with next_{c} of their successor in ascending order of the id (null first, ties by a hash of the
    text, then the text); the last row's is the first. One shuffle of the rows by ranges of that order, which may part the
    rows of one id or of none; each range also gets the next one's first row."""
    n = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts, empty = _cuts(rows, n)
    kind = type_of(rows, "id")
    known = sorted(set(cuts))
    upto = [0, *accumulate(cuts.count(c) for c in known)] if len(known) < len(cuts) else list(range(len(known) + 1))
    places, values = (F.array(*map(F.lit, x)) for x in (upto, known or [None]))
    values = values.cast(f"array<{kind}>")
    # how many of the different cuts are at most the id, by binary search
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(known)).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        above = F.get(values, mid) <= F.col("id")
        return F.when(s["lo"] >= s["hi"], s).when(above, F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))

    j = F.aggregate(F.sequence(F.lit(1), F.lit(len(known).bit_length() + 1)), start, step, lambda s: s["lo"])
    spread = F.shiftrightunsigned(F.xxhash64("text"), 11) / F.lit(float(1 << 53))
    ranged = rows.withColumn("_spread", spread).withColumn("_j", j)
    low, high = F.get(places, F.col("_j") - 1), F.get(places, F.col("_j"))
    own = F.when(F.get(values, F.col("_j") - 1) == F.col("id"), low + F.floor(F.col("_spread") * (high - low + 1))).otherwise(high)
    ranged = ranged.withColumn("_range", F.when(F.col("id").isNull(), F.floor(F.col("_spread") * empty)).otherwise(own + empty).cast("int")).drop("_j")
    # a row per range that holds some
    firsts = sorted((r["_range"], r["least"]) for r in ranged.groupBy("_range").agg(F.min(F.struct("id", "_spread")).alias("least")).collect())
    if not firsts:
        return rows.select("*", *[F.col(c).alias(f"next_{c}") for c in carried])
    before = [(firsts[k - 1][0], tuple(firsts[k][1])) for k in range(len(firsts))]
    ends = rows.sparkSession.createDataFrame(before, f"_to int, _least struct<id:{kind},spread:double>")
    guests = ranged.join(F.broadcast(ends), F.col("id").eqNullSafe(F.col("_least.id")) & (F.col("_spread") == F.col("_least.spread")))
    # one for each range, however many rows are equal
    others = [c for c in rows.columns if c != "text"]
    guest = guests.groupBy("_to").agg(F.min(F.struct("text", *others)).alias("g")).select(*[F.col(f"g.{c}").alias(c) for c in rows.columns], F.lit(0.0).alias("_spread"), F.col("_to").alias("_range"), F.lit(True).alias("_guest"))
    w = W.partitionBy("_range").orderBy("_guest", F.col("id").asc_nulls_first(), "_spread", "text")
    both = ranged.withColumn("_guest", F.lit(False)).unionByName(guest)
    return both.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carried]).filter("NOT _guest").drop("_guest", "_range", "_spread")


def edited(text: Column, following: Column) -> Column:
    """The text with the last half of its code points replaced by as many first ones (or all) of the following text."""
    n = F.length(text)
    return F.concat(F.substring(text, F.lit(1), n - F.floor(n / 2).cast("int")), F.substring(following, F.lit(1), F.floor(n / 2).cast("int")))


def edit_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness: an exact digest is like another (1.0) if it
    is equal, else not (0.0). Columns: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Ids may be of any type that has an order. Null texts are empty; null ids come first, rows of equal ids in the order of
    a hash of their texts; repeated rows stay, a row each; an empty table gives an empty result; other columns are ignored."""
    at = shared_dir(df.sparkSession)
    rows = numbered(id_and_text(df, id_col, text_col), "row")
    paired = with_next(with_hash(rows, "text", "own"), ["row", "text", "own_hash", "own_sha"]).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    pairs = with_hash(paired, "edited", "edited").withColumn("n_chars", F.length("text").cast("long")).withColumn("edited_sha256", F.sha2("edited", 256))
    pairs = stored(pairs.drop("text", "edited", "next_text"), f"{at}/pairs")
    both = pairs.select(F.col("own_hash").alias("hash")).unionByName(pairs.select(F.col("edited_hash").alias("hash")))
    buckets = stored(shared_buckets(both), f"{at}/buckets")
    own = stored(semi_join(pairs.select("row", F.col("own_hash").alias("hash")), buckets, "hash").select("row"), f"{at}/own")
    some = stored(semi_join(pairs.select("row", "next_row", F.col("edited_hash").alias("hash")), buckets, "hash").select("row", "next_row"), f"{at}/edited")
    ends = stored(some.select("row").unionByName(some.select(F.col("next_row").alias("row"))).distinct(), f"{at}/ends")
    near = stored(semi_join(rows, ends, "row"), f"{at}/near")
    again = some.join(near, "row").join(near.select(F.col("row").alias("next_row"), F.col("text").alias("next_text")), "next_row").select(edited(F.col("text"), F.col("next_text")).alias("text"))
    clashes = stored(collided(semi_join(rows, own, "row").select("text").unionByName(again)), f"{at}/clashes")
    out = pairs
    for name in ("own", "edited"):
        out = told_apart(out, clashes, name)
    out = told_apart(out.withColumnRenamed("own_fingerprint", "fingerprint"), clashes, "next_own")
    like = lambda a, b: F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)
    return out.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("fingerprint", "edited_fingerprint").alias("near_edited"), like("fingerprint", "next_own_fingerprint").alias("near_next"))
