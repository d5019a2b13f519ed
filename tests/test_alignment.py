"""Word alignments against a plain dynamic program."""

import random

from pyspark.sql import functions as F

from scanloom.operators import alignment as A
from scanloom.plans import profiles, queries as Q


def _plain(ref, hyp):
    """(steps, gaps) of the best alignment, cell by cell."""
    row = [(j, j) for j in range(len(hyp) + 1)]
    for i, w in enumerate(ref, 1):
        now = [(i, i)]
        for j, v in enumerate(hyp, 1):
            d, g = row[j - 1]
            now.append(min((d + (w != v), g), (row[j][0] + 1, row[j][1] + 1), (now[j - 1][0] + 1, now[j - 1][1] + 1)))
        row = now
    steps, gaps = row[-1]
    inserted, deleted = (gaps + len(hyp) - len(ref)) // 2, (gaps - len(hyp) + len(ref)) // 2
    return len(ref), len(hyp), len(ref) - deleted - (steps - gaps), steps - gaps, inserted, deleted


def test_counts_are_those_of_a_plain_program():
    r = random.Random(1)
    for _ in range(400):
        a, b = (r.choices("abcd", k=r.randrange(14)) for _ in range(2))
        assert A.aligned(a, b) == _plain(a, b), (a, b)
    long = [f"w{k % 700}" for k in range(6000)]
    other = [w for k, w in enumerate(long) if k % 50] + ["x"] * 3
    n, m, same, sub, ins, dele = A.aligned(long, other)
    assert (n, m) == (6000, 5883) and same + sub + dele == n and same + sub + ins == m and ins + dele + sub <= 123


def test_alignment_of_a_table(spark):
    rows = [(1, "a b c", "a x c d"), (2, None, "a"), (3, "", None), (4, " a \n b ", "a b"), (4, " a \n b ", "a b")]
    df = spark.createDataFrame(rows, "id long, ref string, hyp string").withColumn("words_", F.lit(1))
    got = sorted(tuple(x) for x in A.alignment(df).collect())
    assert got == [(1, 1, 3, 4, 2, 1, 1, 0), (2, 1, 0, 1, 0, 0, 1, 0), (3, 1, 0, 0, 0, 0, 0, 0), (4, 1, 2, 2, 2, 0, 0, 0), (4, 1, 2, 2, 2, 0, 0, 0)]
    assert A.alignment(df.limit(0)).count() == 0


def test_query_over_all_turns(spark, sf):
    turns = {(x["conv_id"], x["turn"]): x["text"] for x in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    want = {f"{c}-{t}": _plain(x.split()[:10**6], turns[c, t + 1].split()) for (c, t), x in turns.items() if (c, t + 1) in turns and len(x) + len(turns[c, t + 1]) < 4000}
    got = {x["pair"]: tuple(x)[1:] for x in Q.QUERIES["word_alignment"](spark, sf).collect()}
    assert want and all(got[k] == v for k, v in want.items()) and len(got) == sum((c, t + 1) in turns for c, t in turns)


def test_edit_distances_of_many_pairs_are_those_of_spark(spark):
    r = random.Random(3)
    sizes = [0, 1, 5, 63, 64, 65, 128, 129, 200]
    text = lambda: "".join(r.choice("abcdé😀 ") for _ in range(r.choice(sizes)))
    rows = [(k, text(), text()) for k in range(400)] + [(400 + k, t, t[:100] + "x" + t[101:]) for k, t in enumerate(text() for _ in range(200))] + [(-1, None, "a"), (-2, "a", None)]
    df = spark.createDataFrame(rows, "k long, ref string, hyp string")
    want = {x[0]: x[1] for x in df.select("k", F.levenshtein("ref", "hyp")).collect()}
    assert {x["k"]: x["edits"] for x in A.with_edits(df).collect()} == want and want[-1] is None
    assert A.with_edits(df.limit(0)).count() == 0


def test_variants_are_compared_in_many_tasks(spark, sf):
    plan = profiles.QUERIES["ocr_variant_matrix"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "levenshtein" not in plan
