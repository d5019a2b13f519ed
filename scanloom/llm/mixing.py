"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1], linear from `start` to `end`. Its integral
fixes the source's share of all words; the inverse of its cumulative demand turns a document's place among its
source's words into a training position; a range sort by position gives the training order. Native: DataFrame
expressions and windows alone.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .shared import SPACE, free_name, quoted, shared_dir, stored

#: A target never exceeds so many passes over its source.
MOST = 3


def word_count(col: str = "text") -> Column:
    """Words of a text (null: 0) as a long."""
    return F.size(F.array_remove(F.split(F.coalesce(F.col(quoted(col)), F.lit("")), SPACE), "")).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """sources with rank, a source's place from 0 by code point, null last. Ranges of sources are ranked each for itself
    and moved by the sizes of those before, so that no task holds all of them. An empty table stays empty."""
    spark = sources.sparkSession
    order = F.col("source").asc_nulls_last()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    placed = stored(sources.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("rank", at), f"{shared_dir(spark)}/ranked")
    part = F.shiftright("rank", 33)
    sizes = sorted(tuple(r) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row per range
    starts = [(p, z - n) for (p, n), z in zip(sizes, accumulate(n for _, n in sizes), strict=True)]
    moved = F.broadcast(spark.createDataFrame(starts, "part long, ahead long"))  # one row per range
    return placed.join(moved, part == F.col("part")).withColumn("rank", F.col("ahead") + F.col("rank").bitwiseAND((1 << 33) - 1)).drop("part", "ahead")


def default_schedule(sources: DataFrame) -> DataFrame:
    """Sources by code point, null last, weigh 1, 2, 3, repeating; odd ranks fade out, even ranks fade in."""
    weight, tilt = (F.col("rank") % 3 + 1).cast("double"), F.when(F.col("rank") % 2 == 0, 0.5).otherwise(-0.5)
    return ranked(sources).withColumn("start", weight * (1 - tilt)).withColumn("end", weight * (1 + tilt)).drop("rank")


def targets(sources: DataFrame) -> DataFrame:
    """sources (source, source_size, start, end), a row each, with weight (the schedule's integral) and target.

    target = min(MOST * source_size, level * weight), where the level makes the targets add up to all words: what
    capped sources cannot take is shared again by weight until none is above its cap. Each round is one aggregate,
    the level only rises, and it stops when no further source reaches its cap. An empty table stays empty.
    """
    s = sources.withColumn("weight", (F.col("start") + F.col("end")) / 2)
    cap = MOST * F.col("source_size").cast("double")
    total, weights = s.agg(F.sum("source_size").cast("double"), F.sum("weight")).first()
    level = total / weights if weights else 0.0
    while weights:
        full = cap < level * F.col("weight")
        capped, free = s.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        higher = (total - (capped or 0.0)) / free if free else level
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    return s.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def position(u: Column, start: Column, end: Column) -> Column:
    """The time t at which a linear schedule has given out the share u of its demand."""
    root = F.sqrt(F.greatest(F.lit(0.0), start * start + (end * end - start * start) * u))
    return F.when(F.abs(end - start) < 1e-12, u).otherwise((root - start) / (end - start))


def positions(name: str = "mix") -> Column:
    """The training positions of a row of mix(), one for each pass."""
    m = F.col(name)
    taken = F.sequence(F.lit(0).cast("long"), m["passes"] - 1)
    return F.when(m["passes"] > 0, F.transform(taken, lambda k: _at(m, k))).otherwise(F.array().cast("array<double>"))


def _at(m: Column, k: Column) -> Column:
    share = F.when(m["target"] > 0, F.least(F.lit(1.0), (k * m["source_size"] + m["before"]) / m["target"])).otherwise(F.lit(0.0))
    return position(share, m["start"], m["end"])


def _fills(placed: DataFrame, at_once: int, uri: str) -> DataFrame:
    """(source, bucket, ranks): documents beyond a source's cut that fill what the cut left open, until no document is left
    that fits. In a round some stand by from each size class (by powers of two), `at_once` in the first and eight times as
    many in each that follows; the largest that still fits is taken first. A round takes at least one for every source that
    has one, and a gap is smaller than the document at the cut, so the rounds are few."""
    source, group = ["source", "bucket"], F.floor(F.log2("size")).cast("int").alias("class")
    gaps = placed.groupBy("source").agg((F.max("rest") - F.coalesce(F.max(F.when(F.col("fits"), F.col("upto"))), F.lit(0))).alias("gap"))
    gaps = stored(gaps, f"{uri}/gaps-0")
    left = placed.filter(~F.col("fits") & (F.col("size") > 0) & (F.col("rest") > 0)).select(*source, "rank", "size", group)
    left = stored(left.join(gaps, "source").filter("size <= gap").drop("gap"), f"{uri}/left-0")
    all_picked, most, k = None, at_once, 0
    # the first of each bucket, then of some neighbouring buckets, then of all, so that few rows of a class meet in the end
    first = lambda *by: F.row_number().over(W.partitionBy("source", "class", *by).orderBy("bucket", "rank"))
    item = F.struct("size", (-F.col("bucket")).alias("b"), (-F.col("rank")).alias("r"))
    while left.take(1):
        k += 1
        spares = left
        for by in (["bucket"], [F.floor(F.col("bucket") / 32)], []):
            spares = spares.withColumn("turn", first(*by)).filter(F.col("turn") <= most)
        per = spares.groupBy("source").agg(F.reverse(F.array_sort(F.collect_list(item))).alias("spares")).join(gaps, "source")
        taken = F.expr("""aggregate(spares, named_struct('gap', gap, 'got', cast(array() AS array<struct<bucket: bigint, rank: int, size: bigint>>)),
            (s, x) -> if(x.size <= s.gap, named_struct('gap', s.gap - x.size, 'got', concat(s.got, array(named_struct('bucket', -x.b, 'rank', -x.r, 'size', x.size)))), s), s -> s.got)""")
        picked = stored(per.select("source", F.inline(taken)), f"{uri}/picked-{k}")
        all_picked = all_picked.unionByName(picked) if all_picked else picked
        filled = picked.groupBy("source").agg(F.sum("size").alias("filled"))
        gaps = stored(gaps.join(filled, "source", "left").select("source", (F.col("gap") - F.coalesce("filled", F.lit(0))).alias("gap")), f"{uri}/gaps-{k}")
        left = stored(left.join(picked.drop("size"), [*source, "rank"], "left_anti").join(gaps, "source").filter("size <= gap").drop("gap"), f"{uri}/left-{k}")
        most *= 8
    none = placed.sparkSession.createDataFrame([], "source string, bucket long, rank int")
    return (all_picked.drop("size") if all_picked else none).groupBy(*source).agg(F.collect_set("rank").alias("ranks"))


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", size_col: str | None = None, schedule=default_schedule, name: str | None = None, spread: list[str] | None = None, fill: int = 8) -> DataFrame:
    """df with one more column, the struct `name` ("mix", or the first free name with underscores after it): size,
    source_size, target, passes (times the mix takes the document), taken (words), before (words of its source before
    it), start and end (its source's schedule).

    A source's documents stand in the order of a hash of `spread` (the id and, if there is one, the text). The target's
    whole passes take every document. The rest takes documents in that order while they fit; then smaller ones from
    beyond the cut fill what stayed open until no document is left that fits (`fill` of a size class stand by at first). Prefix sums go over (source, hash range) buckets, of which a source has some four
    for each task of the cluster: sums of buckets first, then inside each bucket, so no source meets in one task.
    df's columns pass, whatever their names. Null texts have size 0, null sources are a source of their own, null ids are ids; rows with equal ids are told apart
    by text, then size, and equal rows take the places of one another; an empty table gives an empty result.
    """
    spark, uri = df.sparkSession, shared_dir(df.sparkSession)
    name = name or free_name(df, "mix")
    size = F.col(quoted(size_col)).cast("long") if size_col else word_count(text_col)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(2, (4 * n - 1).bit_length())
    # null apart from any text, without null-safe joins, so that windows and joins share one partitioning
    named = F.coalesce(F.concat(F.lit("v"), F.col(quoted(source_col)).cast("string")), F.lit("n"))
    marks = spread or [id_col, *[text_col] * (text_col in df.columns)]
    hashed = F.xxhash64(*map(quoted, marks))
    key = [named.alias("source"), F.shiftrightunsigned(hashed, 64 - bits).alias("bucket"), hashed.alias("hash"), F.coalesce(size, F.lit(0).cast("long")).alias("size")]
    in_order = lambda s, b, *o: W.partitionBy(s, b).orderBy(*o)
    narrow = stored(df.select(*key), f"{uri}/sizes")
    w = in_order("source", "bucket", "hash", "size")
    before = lambda size, w: F.coalesce(F.sum(size).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = narrow.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("ahead", before("words", W.partitionBy("source").orderBy("bucket"))).drop("words")
    source = F.when(F.col("key") != "n", F.substring("key", 2, 2**31 - 1))
    sizes = narrow.groupBy(F.col("source").alias("key")).agg(F.sum("size").cast("long").alias("source_size")).withColumn("source", source)
    per_source = targets(stored(schedule(sizes), f"{uri}/schedule")).drop("source", "weight").withColumnRenamed("key", "source")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = sums.join(per_source, "source").withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = stored(plan, f"{uri}/plan")
    placed = narrow.withColumn("rank", F.row_number().over(w)).withColumn("upto", before("size", w) + F.col("size")).join(plan, ["source", "bucket"])
    placed = placed.withColumn("upto", F.col("upto") + F.col("ahead")).withColumn("fits", (F.col("rest") > 0) & (F.col("upto") <= F.col("rest")))
    fills = stored(_fills(placed, fill, f"{uri}/rounds"), f"{uri}/fills")
    of, planned = free_name(df, f"{name}_of"), free_name(df, f"{name}_plan")
    plan = plan.join(fills, ["source", "bucket"], "left").select(F.struct("source", "bucket").alias(of), F.struct("ahead", "whole", "rest", "ranks", "source_size", "target", "start", "end").alias(planned))
    m = lambda c: F.col(f"{name}.{c}")
    rows = df.withColumn(name, F.struct(*key))
    w = in_order(m("source"), m("bucket"), m("hash"), m("size"))
    rows = rows.withColumn(name, F.struct(*[m(c).alias(c) for c in ("source", "bucket", "hash", "size")], F.row_number().over(w).alias("rank"), before(m("size"), w).alias("inside")))
    rows = rows.join(plan, (m("source") == F.col(f"{of}.source")) & (m("bucket") == F.col(f"{of}.bucket")))
    p = lambda c: F.col(f"{planned}.{c}")
    at = (p("ahead") + m("inside")).cast("long")
    # an empty document rides along with its neighbours
    extra = F.when((p("rest") > 0) & ((at + m("size") <= p("rest")) | F.coalesce(F.array_contains(p("ranks"), m("rank")), F.lit(False))), 1).otherwise(0)
    passes = (p("whole") + extra).cast("long")
    told = F.struct(m("size").alias("size"), p("source_size").alias("source_size"), p("target").alias("target"), passes.alias("passes"), (passes * m("size")).alias("taken"), at.alias("before"), p("start").alias("start"), p("end").alias("end"), m("hash").alias("hash"))
    return rows.select(*map(quoted, df.columns), told.alias(name))


def curriculum(mixed: DataFrame, name: str = "mix", untaken: bool = False) -> DataFrame:
    """mix()'s rows, one for each pass, range-sorted by training position: the struct `name` gains pass (from 0) and
    position. With `untaken`, documents that no pass takes stay, too, one row each with null pass and position, spread
    over all ranges after the others. Ties stand in the order of their hash; an empty table stays empty."""
    k = free_name(mixed, f"{name}_pass")
    passes = F.col(f"{name}.passes")
    taken = F.when(passes > 0, F.sequence(F.lit(0).cast("long"), passes - 1))
    dealt = mixed.select("*", (F.explode_outer if untaken else F.explode)(taken).alias(k))
    n = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    m = F.col(name)
    at = F.when(F.col(k).isNotNull(), _at(m, F.col(k)))
    placed = dealt.withColumn(name, m.withField("pass", F.col(k)).withField("position", at)).drop(k)
    # positions fill [0, 1] by design, so equal ranges of it need no sample, which would compute everything once more
    place = F.least(F.lit(n - 1), F.floor(m["position"] * n))
    part = F.when(m["position"].isNotNull(), place).otherwise(F.pmod(m["hash"], F.lit(n))).cast("int")
    return placed.repartitionById(n, part).sortWithinPartitions(m["position"].asc_nulls_last(), m["hash"], m["pass"])
