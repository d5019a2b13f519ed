"""Toxicity, filter audit and compaction: whole results against plain versions, held-out accuracy, and odd rows."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from scanloom.llm import compaction, filter_audit, queries, toxicity
from scanloom.llm.shared import shared_dir


def _split(t):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", t or "") if w]


# toxicity


def _grams(text):
    """The n-grams of each word of a text, as bytes, blanks around the word included."""
    out = []
    for w in toxicity.flat(text).split():
        b = b" " + w + b" "
        out.append([b[i : i + n] for n in toxicity.SIZES for i in range(len(b) - n + 1)])
    return out


def _bucket(gram):
    h = 0
    for c in gram:
        h = (h * int(toxicity.STEP) + c) % 2**64
    return (h * int(toxicity.MIX) % 2**64) >> (64 - toxicity.BITS)


def test_margins_are_those_of_a_plain_sum():
    r = np.random.default_rng(1)
    shares = r.normal(size=1 << toxicity.BITS).astype(np.float32)
    texts = ["", " .,! \n", "a", "You IDIOT, you", "ä ö\tü Straße. x" * 3, "one two three four five six seven eight nine ten", "x" * 5000, "\x1c b\x00c ¿qué?"]
    got = toxicity.margins(texts, shares, -0.5)
    for t, z in zip(texts, got, strict=True):
        words = _grams(t)
        k = min(len(words), toxicity.WINDOW)
        means = [sum(float(shares[_bucket(g)]) for w in words[i : i + k] for g in w) / max(1, sum(len(w) for w in words[i : i + k])) for i in range(len(words) - k + 1)] if words else [0.0]
        assert z == pytest.approx(max(means) - 0.5, abs=1e-6), t
    assert len(toxicity.margins([], shares, 0.0)) == 0


def _toxic_rows(n, seed, bad):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ta", "ren", "so", "lim", "ek", "or", "an"]) for _ in range(r.randrange(1, 4)))
    rows = []
    for i in range(n):
        ws = [word() for _ in range(r.choice([5, 40, 400]))]
        toxic = i % 4 == 0
        for _ in range(toxic * max(1, len(ws) // 60)):
            ws.insert(r.randrange(len(ws) + 1), r.choice(bad))
        rows.append((i, " ".join(ws), int(toxic)))
    return rows


def test_toxicity_finds_unseen_misspellings_and_lets_clean_texts_be(spark):
    bad = ["scoundrel", "blockhead", "dunderklumpen"]
    rows = _toxic_rows(600, 1, bad)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"), sample=150)
    unseen = _toxic_rows(200, 2, ["scoundrell", "sc0undrel", "blokhead", "blockheads", "dunderklumpn", "dunderklumppen"])
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(unseen, "doc_id long, text string, y int"), model).collect()}
    hit = sum((got[i] >= 0.5) == bool(y) for i, _, y in unseen)
    assert hit >= 0.95 * len(unseen) and sum(got[i] >= 0.5 for i, _, y in unseen if not y) <= 2
    again = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"), sample=150)
    assert np.array_equal(model.shares(), again.shares())


def test_toxicity_on_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " ,. \n"), (4, "fine words"), (4, "fine words"), (None, "fine words"), (5, "blockhead " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("clash"), "score": F.lit(9), "_label": F.lit(1)}).repartition(2)
    labels = spark.createDataFrame([(4, 0), (5, 1), (7, None), (None, 1), (8, 1)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    got = toxicity.score(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["score"])
    assert by[1] == by[2] == by[3] and by[4] == by[None] and len(by[4]) == 1 and max(by[5]) > 0.5 > max(by[4])
    one = toxicity.train(df, labels.filter("toxic = 0"))
    assert {round(r["score"], 9) for r in toxicity.score(df, one).collect()} == {1 / 4}  # two clean rows: (0 + 1) / (2 + 2)
    assert toxicity.score(df.limit(0), one).count() == 0 and toxicity.train(df.limit(0), labels).margin_of_nothing() == 0


def test_toxicity_query_on_held_out_rows(spark, sf):
    docs = {r["doc_id"]: r for r in queries.op11_toxicity(spark, sf).collect()}
    assert len(docs) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for i, r in docs.items())


# filter audit


def _audit(docs, labels):
    """Every document through every order."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, x in labels if i is not None and x == 1}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    rows = []
    for i, t, s in docs:
        ws, t = _split(t), t or ""
        fails = [len(ws) < 200, 100 * len(set(ws)) < 50 * len(ws), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > least[t]]
        rows.append((s or "", {f for f, x in zip("ABCDE", fails, strict=True) if x}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            left, gone = own, []
            for k, f in enumerate(order):
                lost = [r for r in left if f in r[1]]
                out[part, "".join(order), k + 1] = [len(left) - len(lost), len(lost), sum(f in r[1] for r in gone), sum(r[1] == {f} for r in own), sum(r[2] for r in lost), sum(r[3] for r in lost)]
                left, gone = [r for r in left if f not in r[1]], gone + lost
    by = Counter()
    for (part, order, k), v in out.items():
        by[part, order[k - 1]] += v[1]
    return {(*key, *v, by[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def test_audit_is_that_of_every_document_through_every_order(spark):
    r = random.Random(3)
    texts = [" ".join(f"w{r.randrange(n)}" for _ in range(m)) for n, m in [(500, 250), (20, 250), (500, 30), (9, 30)]]
    texts += [t.upper() for t in texts] + [t + " |" for t in texts] + ["", None, " \n\t\x0b\x0c\r", "é" * 70_000, "A\x1cB", "É É"]
    docs = [(i if i % 17 else None, r.choice(texts), r.choice(["a", "b", "c", "", None])) for i in range(300)]
    docs += docs[:20] + [(5, texts[0], "b"), (5, texts[0], "a"), (10_000, texts[0], "hot")] + [(20_000 + i, texts[0], "hot") for i in range(60)] + [(3, texts[1], "only fails")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 300, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (99_999, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"part": F.lit("x"), "id": F.lit(1), "A": F.lit(True), "n": F.lit(0)}).repartition(5)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    rows = filter_audit.audit(df, lab).collect()
    got = {(x["part"], x["filter_order"], x["step"], x["kept"], x["removed"], x["redundant"], x["unique_fails"], x["good_lost"], x["toxic_lost"], x["shapley"]) for x in rows}
    assert len(rows) == len(got) and got == _audit(docs, labels)
    assert filter_audit.audit(df.limit(0), lab).count() == 0
    none = filter_audit.audit(df.limit(9), lab.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(none) == (0, 0)


# compaction


def _compact(rows, by=200, small=750, most=400):
    size = lambda x: 1 + len(rows) // x
    day = lambda r: None if r[2] is None else (r[2] - datetime(1970, 1, 1)).days
    of_day, files = Counter(day(r) for r in rows), defaultdict(list)
    for r in rows:
        h, d = zlib.crc32(("" if r[0] is None else str(r[0])).encode()), day(r)
        files[d, (h // 16) % (1 + of_day[d] // size(by)), min(h % 4, (h // 4) % 4)].append(r)
    out = []
    for k in files:
        files[k].sort(key=lambda r: ((r[2] is not None, r[2] or datetime.min), (r[0] is not None, r[0] or 0)))
    for d in of_day:
        groups = []
        for k in sorted((k for k in files if k[0] == d), key=lambda k: (-len(files[k]), k[1:])):
            n = len(files[k])
            if n >= size(small) or n > size(most):
                groups.append([math.inf, [k]])
            elif g := next((g for g in groups if g[0] + n <= size(most)), None):
                g[0], g[1] = g[0] + n, [*g[1], k]
            else:
                groups.append([n, [k]])
        for _, ks in groups:
            own = [r for k in ks for r in files[k]]
            ids = [r[0] for r in own]
            known = [i for i in ids if i is not None]
            cents = sum(math.floor(100 * r[5] + 0.5) for r in own if r[5] is not None and math.isfinite(r[5]))
            out.append((d, *ks[0][1:], len(own), min(known, default=None), max(known, default=None), cents, ",".join(f"{a}-{b}" for _, a, b in ks), hashlib.sha256(",".join("" if i is None else str(i) for i in ids).encode()).hexdigest(), len(ks) > 1))
    return Counter(out)


FIELDS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
TOLD = ["day", "lot", "piece", "n_rows", "min_click_id", "max_click_id", "cents", "sources", "ids_sha256", "rewritten"]


def _clicks(n, seed=1):
    r = random.Random(seed)
    start = datetime(2024, 1, 1)
    at = lambda i: start + timedelta(days=2) if r.random() < 0.4 else start + timedelta(minutes=r.randrange(60 * 24 * 30))
    rows = [(i, start, at(i), i % 7, "view", r.choice([None, 1.005, -3.25, float("nan"), float("inf"), r.random() * 100]), "x" * r.randrange(20)) for i in range(n)]
    return rows + rows[:30] + [(None, start, at(0), None, None, None, None)] * 5 + [(-i, None, None, 1, "late", 2.0, None) for i in range(1, 40)] + [(n + 1, start, datetime(1969, 12, 31, 23, 59), 1, "old", 0.5, "")]


@pytest.mark.parametrize("sizes", [{}, {"lot_rows": 20, "small": 60, "most": 25}, {"lot_rows": 50, "small": 10, "most": 100}])
def test_compaction_writes_the_planned_files(spark, sizes):
    rows = _clicks(3000)
    df = spark.createDataFrame(rows, FIELDS).repartition(5)
    got = compaction.compact(df, **sizes).collect()
    assert Counter(tuple(r[c] for c in TOLD) for r in got) == _compact(rows, *[sizes[k] for k in ("lot_rows", "small", "most")] if sizes else [])
    folder = os.path.dirname(got[0]["path"])
    found = [os.path.join(d, f) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")]
    assert sorted(found) == sorted(r["path"] for r in got)
    back = []
    for r in got:
        t = pq.ParquetFile(r["path"]).read()
        assert ",".join(t.column_names) == r["columns"] == ",".join(df.columns) and t.num_rows == r["n_rows"]
        back += [repr(tuple(x.values())) for x in t.to_pylist()]
    assert Counter(back) == Counter(map(repr, rows))


def test_compaction_of_odd_tables(spark):
    df = spark.createDataFrame(_clicks(400, 5), FIELDS)
    odd = df.select(*[F.col(c).alias({"kind": "day", "props": "lot", "client_id": "Piece", "ts": "a.b", "value": "grp"}.get(c, c)) for c in df.columns]).withColumns({"row": F.lit(1), "ordinal": F.lit("o"), "n": F.lit(None).cast("int"), "n_files": F.lit(2)})
    got = compaction.compact(odd, value_col="grp").collect()
    want = compaction.compact(df).collect()
    assert Counter(tuple(r[c] for c in TOLD) for r in got) == Counter(tuple(r[c] for c in TOLD) for r in want)
    assert {r["columns"] for r in got} == {",".join(odd.columns)}
    texts = df.select(F.col("click_id").cast("string").alias("click_id"), F.col("arrived_at").cast("timestamp").alias("arrived_at"))
    named = compaction.compact(texts, value_col=None).collect()
    assert sum(r["n_rows"] for r in named) == df.count() and {r["cents"] for r in named} == {0}
    assert compaction.compact(df.limit(0)).count() == 0


def test_first_fit_takes_the_earliest_group_with_room():
    r = random.Random(4)
    for _ in range(200):
        most, sizes = r.randrange(5, 40), []
        sizes = [r.randrange(0, most + 1) for _ in range(r.randrange(1, 60))]
        packer, room = compaction.FirstFit(most, len(sizes)), []
        for n in sizes:
            g = next((i for i, left in enumerate(room) if left >= n), len(room))
            room += [most] * (g == len(room))
            room[g] -= n
            assert packer.put(n) == g


def test_settling_goes_on_after_a_failure(spark):
    """Moves that stopped halfway are finished by doing them again, and done once more they change nothing."""
    df = spark.createDataFrame(_clicks(1500, 9), FIELDS)
    uri, work = shared_dir(spark), shared_dir(spark)
    days = df.groupBy(compaction.day_of(F.col("arrived_at")).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    rows = df.count()
    keys = compaction.write_lots(df, uri, days, rows, "click_id", "arrived_at")
    files = spark.read.schema("day long, lot long, piece long").parquet(uri).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    planned = spark.createDataFrame(compaction.plan(files, compaction.share(rows, 750), compaction.share(rows, 400)).collect(), compaction.PLAN)
    grp = compaction.merge(df, uri, keys, planned, f"{work}/merged")
    some = planned.filter("day % 2 = 0")
    first = compaction.settle(some, uri, f"{work}/merged", keys, grp).collect()
    both = compaction.settle(planned, uri, f"{work}/merged", keys, grp).collect()
    again = compaction.settle(planned, uri, f"{work}/merged", keys, grp).collect()
    assert Counter(both) == Counter(again) and set(first) <= set(both)
    told = compaction.contents(spark, uri, "click_id", "value").collect()
    assert sum(r["n_rows"] for r in told) == rows and {r["name"] for r in told} == {r["name"] for r in both}
