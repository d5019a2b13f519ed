"""How filters interact: what each step of every order of five filters removes.

Documents become flags, counted by (part, flags, labels) before anything else, so that what follows is small. A SQL CUBE
over the five failure flags and the part sums these counts. A row of the cube whose grouped flags are all false counts the
documents of a part that pass this subset of filters, whatever the other flags: the subset's survivors. A step of an order
goes from one subset to the subset with one filter more, so a join of such pairs of subsets gives every step of every order.
"""

from __future__ import annotations

from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame, functions as F

from .shared import SPACE, shared_dir, stored, type_of

FILTERS = "ABCDE"


def failures(text: Column) -> dict[str, Column]:
    """The failures that a text shows by itself."""
    words = F.array_remove(F.split(text, SPACE), "")
    without = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
        "C": 100 * without("[A-Z]+").cast("long") > 2 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def flag_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """A row per (part, A, B, C, D, E) that occurs, with the numbers n, good and toxic.

    E marks a text that a smaller id has, too, in any part. Ids of equal texts meet as an aggregate by digest, which tasks
    begin before the shuffle, and the rows of each text's smallest id by (digest, id), so a text of very many copies falls
    to no single task. Null texts are empty, null parts the empty string. A null id is smaller than none and has no label:
    it neither fails E nor makes others fail. Rows of equal ids count each; equal to one another alone they do not fail E.
    Of an id's labels any 1 counts; null labels are none. Columns of other names do not matter; empty tables give no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), *[v.alias(k) for k, v in failures(text).items()])
    marks = labels.select(F.col(id_col).cast(type_of(docs, id_col)).alias("id"), *[F.when(F.col(c) == 1, 1).otherwise(0).alias(k) for c, k in ((good_col, "good"), (toxic_col, "toxic"))])
    marks = marks.filter("id IS NOT NULL").groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    zero = F.lit(0)
    known = own.filter("id IS NOT NULL").join(marks, "id", "left").withColumns({k: F.coalesce(k, zero) for k in ("good", "toxic")})
    kind = ["part", *"ABCD", "good", "toxic"]
    rows = stored(known.groupBy("id", "digest", *kind).agg(F.count(F.lit(1)).alias("n")), f"{shared_dir(docs.sparkSession)}/flags")
    total = F.sum("n").alias("n")
    first = rows.join(rows.groupBy("digest").agg(F.min("id").alias("id")), ["digest", "id"]).groupBy(*kind).agg(total)
    copies = rows.groupBy(*kind).agg(total).unionByName(first.withColumn("n", -F.col("n"))).groupBy(*kind).agg(total)
    no_id = own.filter("id IS NULL").groupBy("part", *"ABCD").agg(F.count(F.lit(1)).alias("n")).withColumns({"good": zero, "toxic": zero})
    counted = copies.withColumn("E", F.lit(True)).unionByName(first.unionByName(no_id).withColumn("E", F.lit(False))).filter("n > 0")
    return counted.groupBy("part", *FILTERS).agg(total, F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def survivors(counts: DataFrame) -> DataFrame:
    """A row per part and subset of filters that some document of the part passes: part, passed (the subset's letters), n,
    good, toxic. The empty subset's row counts all of a part's documents."""
    cube = counts.cube("part", *FILTERS).agg(*[F.sum(c).alias(f"sum_{c}") for c in ("n", "good", "toxic")], *[F.grouping(c).alias(f"out_{c}") for c in ("part", *FILTERS)])
    clean = " AND ".join(f"(out_{c} = 1 OR NOT {c})" for c in FILTERS)
    subset = F.concat(*[F.when(F.col(f"out_{c}") == 0, c).otherwise("") for c in FILTERS])
    return cube.filter(f"out_part = 0 AND {clean}").select("part", subset.alias("passed"), *[F.col(f"sum_{c}").alias(c) for c in ("n", "good", "toxic")])


def _letters(names) -> str:
    return "".join(sorted(names))


def moves(passed: DataFrame) -> DataFrame:
    """A row per part, subset of filters (`before`) and further filter: documents of the part that pass both (kept), that
    the filter removes (removed; good_lost and toxic_lost among them) and orders, the number of orders with this step."""
    spark, counted = passed.sparkSession, ("n", "good", "toxic")
    subsets = [_letters(s) for k in range(len(FILTERS) + 1) for s in combinations(FILTERS, k)]
    whole = passed.filter("passed = ''").select("part", F.explode(F.array(*map(F.lit, subsets))).alias("passed"))
    whole = whole.join(passed, ["part", "passed"], "left").select("part", "passed", *[F.coalesce(c, F.lit(0)).alias(c) for c in counted])
    pairs = [(s, f, _letters(s + f), factorial(len(s)) * factorial(len(FILTERS) - 1 - len(s))) for s in subsets for f in FILTERS if f not in s]
    pairs = F.broadcast(spark.createDataFrame(pairs, "passed string, filter string, after string, orders long"))  # 80 rows
    after = whole.select("part", F.col("passed").alias("after"), *[F.col(c).alias(f"{c}_after") for c in counted])
    lost = lambda c: F.col(c) - F.col(f"{c}_after")
    both = whole.join(pairs, "passed").join(after, ["part", "after"])
    return both.select("part", F.col("passed").alias("before"), "filter", F.col("n_after").alias("kept"), lost("n").alias("removed"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), "orders")


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """A row per part, order of the five filters and step: kept, removed, redundant (failing, but removed earlier),
    unique_fails (failing this filter only), good_lost and toxic_lost among the removed, shapley (removed by the step's
    filter, summed over all orders). Nulls, repeated rows, ties and columns of other names as in flag_counts(); a part
    whose documents all fail has zeros; empty tables give no rows."""
    spark = docs.sparkSession
    step = stored(moves(survivors(stored(flag_counts(docs, labels, **columns), f"{shared_dir(spark)}/counts"))), f"{shared_dir(spark)}/moves")
    alone = F.when(F.length("before") == len(FILTERS) - 1, F.col("removed"))
    of_filter = step.groupBy("part", "filter").agg(F.max(F.when(F.col("before") == "", F.col("removed"))).alias("fails"), F.max(alone).alias("unique_fails"), F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    orders = [("".join(o), k + 1, o[k], _letters(o[:k])) for o in permutations(FILTERS) for k in range(len(FILTERS))]
    orders = F.broadcast(spark.createDataFrame(orders, "filter_order string, step int, filter string, before string"))  # 600 rows
    rows = step.join(of_filter, ["part", "filter"]).join(orders, ["filter", "before"])
    return rows.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
