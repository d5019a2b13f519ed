"""Languages and names found in texts, against plain versions and on odd rows."""

import random
import re
from collections import Counter
from math import log

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scanloom.functions import text as T
from scanloom.operators import entities as E, language as G
from scanloom.plans import documents as D


def _grams(text):
    t = " " + re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip() + " " if text is not None else ""
    return [t[i : i + 3] for i in range(len(t) - 2)]


ROWS = [(1, "Der Hund schläft. Der Hund!", "de"), (2, "the dog sleeps, the dog", "en"), (3, "the cat 123", "en"), (4, None, "en"), (5, "", "de"), (6, "12 34 !?", None), (7, "der Hund", None), (7, "und der Hund", None), (None, "the dog", None), (8, "ÉTÉ the", None)]


def test_scores_are_those_of_a_plain_count(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").withColumn("gram", F.lit("clash"))
    p = G.profile(df, least=1)
    assert p.langs == ("de", "en")
    counts = {x: Counter(g for _, t, y in ROWS if y == x for g in _grams(t)) for x in p.langs}
    both = counts["de"] + counts["en"]
    size = {x: sum(c.values()) for x, c in counts.items()}
    weight = {g: [round(1e6 * (log((counts[x][g] + 0.5) / (size[x] + 0.5 * len(both))) - log((n + 0.5) / (sum(size.values()) + 0.5 * len(both))))) for x in p.langs] for g, n in both.items()}
    assert {r["gram"]: r["weights"] for r in p.table.collect()} == weight
    want = {}
    for i in {r[0] for r in ROWS}:
        gs = [g for j, t, _ in ROWS if j == i for g in _grams(t)]
        sums = [sum(weight[g][k] for g in gs if g in weight) for k in (0, 1)]
        want[i] = (len(gs), sums, None if not gs else "de" if sums[0] >= sums[1] else "en")
    got = G.scores(df, p).collect()
    assert {r["doc_id"]: (r["grams"], r["scores"], r["lang"]) for r in got} == want and len(got) == len(want)
    assert want[7][2] == "de" and want[None][2] == "en" and want[4] == want[6] == (0, [0, 0], None)


def test_languages_without_rows(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    none = G.profile(df.limit(0))
    assert none.langs == () and {r["lang"] for r in G.scores(df, none).collect()} == {None}
    assert G.scores(df.limit(0), G.profile(df)).count() == 0


def test_pages_get_the_language_they_lack(spark):
    pages = spark.createDataFrame([("/a/x.jpg", "the dog sleeps", None), ("/a/y.jpg", "the dog", "nl"), ("/a/z.jpg", None, None)], "path string, text string, lang string")
    p = G.profile(spark.createDataFrame(ROWS, "doc_id long, text string, lang string"))
    assert {r["path"]: r["lang"] for r in G.with_language(pages, p).collect()} == {"/a/x.jpg": "en", "/a/y.jpg": "nl", "/a/z.jpg": None}
    got = D.regex_documents(G.with_language(pages, p)).select("file_name", "ground_truth.gt_parse.language").collect()
    assert {r[0]: r[1] for r in got} == {"x": "en", "y": "nl", "z": "unknown"}


def test_language_accuracy_on_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    p = G.profile(docs.filter("doc_id % 5 <> 0"))
    rows = docs.filter("doc_id % 5 = 0").select("doc_id", F.col("lang").alias("want")).join(G.scores(docs, p), "doc_id").collect()
    assert sum(r["lang"] == r["want"] for r in rows) >= 0.97 * len(rows) and {r["want"] for r in rows} == {"de", "en", "es", "fr"}


def _tokens(t, fold=True):
    return re.findall(r"[^\W_]+", t.lower() if fold else t)


def _plain(text, names, fold=True):
    known = {}
    for n in sorted((n for n in names if n), reverse=True):
        if _tokens(n, fold):
            known[tuple(_tokens(n, fold))] = n
    ws, i, out = _tokens(text or "", fold), 0, []
    while i < len(ws):
        n = max((len(k) for k in known if tuple(ws[i : i + len(k)]) == k), default=0)
        if n:
            out.append((i, n, known[tuple(ws[i : i + n])]))
        i += n or 1
    return out


@pytest.mark.parametrize("fold, broadcast", [(True, True), (False, True), (True, False)])
def test_longest_names_from_the_left(spark, fold, broadcast):
    r = random.Random(5)
    words = ["alpha", "Beta", "gamma", "Delta", "of", "AG", "Ä"]
    names = [" ".join(r.choices(words, k=r.randrange(1, 5))) for _ in range(25)] + [None, "", " - ", "alpha", "Alpha", "Beta-gamma", "Beta gamma"]
    texts = [(k, ", ".join(r.choices([*words, "x", "BETA"], k=r.randrange(40)))) for k in range(60)] + [(100, None), (101, ""), (102, "alpha beta " * 3000), (103, "alpha"), (103, "beta alpha"), (103, "alpha"), (None, "Delta of alpha")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before if broadcast else "-1")
    try:
        df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("node", F.lit(1)).repartition(3)
        nodes = E.trie(spark.createDataFrame([(n,) for n in names], "name string"), fold=fold)
        got = Counter(tuple(x) for x in E.matches(df, nodes, fold=fold).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == Counter((i, *m) for i, t in dict.fromkeys(texts) for m in _plain(t, names, fold))


def test_organisations_of_documents_come_from_names(spark):
    names = spark.createDataFrame([("Muster Werke AG",), ("Werke",), ("Antrag Nord",), (None,)], "name string")
    pages = spark.createDataFrame([("/in/a_page1.jpg", "Brief der MUSTER WERKE AG an Werke", "de", True), ("/in/a_page2.jpg", "Muster Werke AG, Antrag Nord", "de", True), ("/in/b.jpg", None, "de", False), ("/in/c.jpg", "nichts", "de", False)], "path string, text string, lang string, has_boxes boolean")
    got = D.rule_documents(E.with_organisations(pages, E.trie(names))).select("file_name", "ground_truth.gt_parse.entities.organizations").collect()
    assert {r[0]: r[1] for r in got} == {"a": ["Muster Werke AG", "Werke"], "c": []}
    assert E.matches(pages.withColumnRenamed("path", "doc_id"), E.trie(names.limit(0))).count() == 0


def test_invoices_are_spread_over_tasks(spark, sf):
    from scanloom.sources import views as V

    assert V.view(spark, sf, V.INVOICES).select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_only_starts_that_open_a_name_are_joined(spark):
    nodes = E.trie(spark.createDataFrame([("Acme Bau",), ("Bonn",)], "name string"))
    at = spark.createDataFrame([(k, w) for k, w in enumerate([["lieferung", "von"], ["acme", "x"], ["von", "acme"], ["bonn"], ["bau"]])], "pos long, ahead array<string>")
    assert sorted(x["pos"] for x in E.opening(at, nodes).collect()) == [1, 3]
    texts = spark.createDataFrame([(1, "Lieferung von ACME Bau von Bonn")], "doc_id long, text string")
    assert sorted((x["pos"], x["name"]) for x in E.matches(texts, nodes).collect()) == [(2, "Acme Bau"), (5, "Bonn")]


def test_letters_beyond_the_basic_plane_are_one_character_each(spark):
    df = spark.createDataFrame([(1, "\U0001d51e\U0001d51f der", "de"), (2, "the \U0001d51e", "en"), (3, "\U0001d51e", None), (4, " - ", None)], "doc_id long, text string, lang string")
    p = G.profile(df, least=1)
    assert {r["gram"] for r in p.table.collect()} == {g for t in (" \U0001d51e\U0001d51f der ", " the \U0001d51e ") for g in (t[i : i + 3] for i in range(len(t) - 2))}
    assert {r["doc_id"]: r["grams"] for r in G.scores(df, p).collect()} == {1: 6, 2: 5, 3: 1, 4: 0}


def _operators(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_scores_make_no_row_per_trigram(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    plan = _operators(G.scores(df, G.profile(df)))
    assert "Generate" not in plan and "Join" not in plan


def test_a_profile_too_large_for_tasks_is_joined(spark, monkeypatch):
    rows = [*ROWS, (9, " ".join("abcdefghijklm"[i % 13] * (i % 7) for i in range(900)), "fr"), (None, None, None), (10, " \t", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    p = G.profile(df, least=1)
    told = {tuple(map(str, r)) for r in G.scores(df, p).collect()}
    monkeypatch.setattr(G, "TOLD", 0)
    joined = G.scores(df, p)
    assert "Join" in _operators(joined) and {tuple(map(str, r)) for r in joined.collect()} == told and len(told) == 11


@pytest.mark.parametrize("places", [G.PLACES, 0])
def test_steps_and_tables_change_no_count_and_no_sum(monkeypatch, places):
    monkeypatch.setattr(G, "PLACES", places)
    r = random.Random(7)
    texts = [None, " ", " a ", *[" " + " ".join("".join(r.choices("abcé日\U0001d51e", k=r.randrange(1, 6))) for _ in range(r.randrange(1, 9))) + " " for _ in range(40)], " ", None]
    langs = [r.choice(["de", "en", "fr"]) for _ in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(langs), pa.array(texts, pa.string())], ["key", "text"])
    cut = [[t[i : i + 3] for i in range(len(t) - 2)] if t else [] for t in texts]
    every = Counter((x, g) for x, gs in zip(langs, cut, strict=True) for g in gs)
    known = sorted({g for gs in cut for g in gs})[::2]
    w = {g: [r.randrange(-9, 9) for _ in range(2)] for g in known}
    tables = G._Weights(known, np.array([[w[g][k] for g in known] for k in (0, 1)]))
    for step in (1, 7, 10_000):
        got = Counter()
        for b in G._counts(True, False, step)(iter([batch])):
            for x in b.to_pylist():
                got[x["key"], x["gram"]] += x["n"]
        assert got == every
        sums = [s.tolist() for _, points, sizes in G._slices(batch, step) for s in tables.sums(points, sizes, step)]
        assert sums == [[sum(w[g][k] for g in gs if g in w) for k in (0, 1)] for gs in cut]


def test_no_text_is_exchanged_for_the_codes_of_languages(spark, tmp_path):
    from scanloom.plans import detection

    texts = {1: "der Hund", 2: "12 FINANZAMT 3", 3: "12", 4: " \n", 5: None, 6: "Finanzamt", 7: "  12"}
    df = spark.createDataFrame([(i, t, None) for i, t in texts.items()], "doc_id long, text string, lang string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = detection.QUERIES["language_detected"](spark, str(tmp_path))
    none = F.lit(None).cast("string")
    want = df.select("doc_id", D.T.language_code(none, legacy=True), D.T.language_or_guess(none, F.col("text")), D.T.language_model(none), D.T.language_or_unknown(none, F.col("text")))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    plan = _operators(got)
    assert "THEN finanzamt" in plan.split("Join", 1)[1]  # below the join


@pytest.mark.parametrize("told", [E.TOLD, 0])
def test_names_in_tasks_or_joined_are_the_same(spark, monkeypatch, told):
    monkeypatch.setattr(E, "TOLD", told)
    names = ["Acme Bau", "Bau", "Acme", "Acme Bau Nord AG", "Nord", " - ", None, "acme  BAU"]
    texts = [(k, " ".join(random.Random(k).choices(["Acme", "BAU", "nord", "AG", "von", "x1"], k=k % 23))) for k in range(120)] + [(7, "Bau"), (7, "Bau"), (None, "Nord"), (500, None), (501, "")]
    nodes = E.trie(spark.createDataFrame([(n,) for n in names], "name string"))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    found = E.matches(df, nodes)
    assert Counter(tuple(x) for x in found.collect()) == Counter((i, *m) for i, t in dict.fromkeys(texts) for m in _plain(t, names))
    assert ("Join" in _operators(found)) == (told == 0)
    pages = df.select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string")).alias("path"), "text", F.lit(1).alias("k"))
    orgs = E.with_organisations(pages, nodes)
    want = Counter((i and f"/in/{i}" if i != 0 else "/in/0", t, 1, tuple(m[2] for m in _plain(t, names))) for i, t in texts)
    assert Counter((r["path"], r["text"], r["k"], tuple(r["organizations"])) for r in orgs.collect()) == want and ("Join" in _operators(orgs)) == (told == 0)
    assert E.matches(df, E.trie(spark.createDataFrame([], "name string"))).count() == 0


def test_notes_are_read_once_for_their_organisations(spark, sf):
    from scanloom.plans import detection

    plan = _operators(detection.QUERIES["organisation_documents"](spark, sf))
    # of vendors to lines alone: names join no pages
    assert plan.count("Join ") == 1 and plan.count("MapInArrow") == 1
    rows = spark.createDataFrame([(t,) for t in ("Das FINANZAMT Bonn Nord 5", "xfinanzamt Finanzamt", "Fin", "", None)], "t string")
    assert [r[0] for r in rows.select(T.tax_office(F.col("t"))).collect()] == ["FINANZAMT Bonn Nord", "Finanzamt", "", "", ""]
