import json
import random

import pytest
from pyspark.sql import functions as F

from scanloom import schemas
from scanloom.functions import patterns as P, text as T
from scanloom.operators import geometry, layout, linking, records
from scanloom.plans import documents as D, queries as Q
from scanloom.sources import files
from scanloom.streaming.curation import curate_stream


def _one(spark, value, f, ddl="string"):
    return spark.createDataFrame([(value,)], f"t {ddl}").select(f(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("f", "value", "expected"),
    [
        (T.dates_regex, "15.11.2023, 15-nov-23 und 3. Juli 2024", ["15.11.2023", "15-nov-23"]),
        (lambda t: T.dates_regex(t, literal=True), "15.11.2023", []),
        (T.is_valid_date, "15-nov-23", True),
        (T.is_valid_date, "2023-11-15", True),
        (T.is_valid_date, "letni", False),
        (T.dates_rules, "am 28.06.24 und 03. Juli 2024, 5 märz 1999, Mai 3, 2020", ["28.06.24", "03. Juli 2024", "5 märz 1999", "Mai 3, 2020"]),
        (T.dates, "5  MARCH 2024", ["5  MARCH 2024"]),
        (T.document_numbers_regex, "Rechnung Nr. 100039", ["100039"]),
        (T.document_numbers, "339/2962/4644", ["339/2962"]),
        (T.amounts, "Summe: 1.234,56", ["Summe: 1.23"]),
        (T.document_ids, "2024,39.039 und CAP/UCF/24/017R, kenmerk: AB-2024/7", ["2024.39.039", "CAP/UCF/24/017R", "kenmerkAB-2024/7"]),
        (T.emails_rules, "a@example.com b@mail1.example.com", ["b@mail1.example.com"]),
        (T.phones_regex, "0612345678", ["061 234 56 78"]),
        (T.receiver, "Belastingdienst x\nPostbus 2536\n6401 DA Heerlen", P.TAX_OFFICE),
        (T.sender, "x\nJan Jansen\nKerkstraat 12\n1234 AB Amsterdam", "Jan Jansen\nKerkstraat 12\n1234 AB Amsterdam"),
        (lambda t: T.line_with(t, P.SENDER_WORDS), "a\nAbsender: B\nfrom: C", "Absender: B"),
        (lambda t: T.parties(t, literal=True)["sender"], "Absender: B", ""),
        (T.recipient_name, "Bescheid für Frau Müller", "für Frau Müller"),
        (T.recipient_name, "Steuer 12", ""),
        (T.recipient_address, "Hauptstr 12, 10115 Berlin", "Hauptstr 12, 10115 Berlin"),
        (T.recipient_address, "nichts", None),
        (T.layout_class, "Year 2024", "Phone"),
        (T.layout_class, "x@y.com 123 456 789", "Email"),
        (T.layout_class, "wort", None),
        (T.field_type, "x@y.com 123 456 789", "Phone"),
        (T.field_type, "x@y.com 123-456-789", "DocumentNumber"),
        (T.name_from_file, "Anna_Nowak_2024", "Anna Nowak"),
        (T.name_from_file, "12", None),
        (T.without_stars, "** a *b** ", "a b"),
        (T.colour, "nothing", P.COLOURS["Unknown"]),
        (T.dates_regex, None, None),
        (T.document_ids, "", []),
    ],
)
def test_rules(spark, f, value, expected):
    assert _one(spark, value, f) == expected


def test_dates_parse_with_pivot(spark):
    got = _one(spark, ["28.06.24", "28/06/2024", "1-2-85", "31-02-2024", "01.01.1999"], lambda t: F.transform(t, lambda x: T.parse_date(x).cast("string")), "array<string>")
    assert got == ["2024-06-28", None, "1985-02-01", None, "1999-01-01"]


def test_ranks_are_stable(spark):
    assert _one(spark, ["1-1-2020", "2-1-2021", "01.01.2020", "x"], T.latest, "array<string>") == ["2-1-2021", "1-1-2020", "01.01.2020"]
    assert _one(spark, ["aa", "bbb", "cc", "ddd"], T.longest, "array<string>") == ["bbb", "ddd", "aa"]


def test_organisations(spark):
    found = ["Finanzamt Berlin", "Beispiel GmbH", "die Firma", "Haus 12", "klein", "Beispiel GmbH", "Müller & Co"]
    assert _one(spark, found, T.organisations, "array<string>") == ["Beispiel GmbH", "Müller  Co"]
    assert _one(spark, found, T.sending_organisation, "array<string>") == "Finanzamt Berlin" and _one(spark, [], T.sending_organisation, "array<string>") == ""


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_similarity_counts_characters(spark):
    a, b = "Grüße aus Köln", "Grüsse aus Koln"
    assert _one(spark, a, lambda t: T.similarity(t, F.lit(b))) == pytest.approx(1 - _distance(a, b) / 15)
    assert _one(spark, "", lambda t: T.similarity(t, F.lit(""))) == 1.0


def test_document_records(spark):
    pages = [("/in/rechnung/a_page1.jpg", "Absender: X\nDatum: 01-02-2024", "de", True), ("/in/rechnung/a_page_2.jpg", "", None, False), ("/in/rechnung/a_page3.jpg", None, None, None), ("/in/brief/a.jpg", None, None, None)]
    df = spark.createDataFrame(pages, "path string, text string, lang string, has_boxes boolean")
    rows = {(r["file_name"], r["ground_truth"]["metadata"]["document_type"]): r for r in D.regex_documents(df).collect()}
    a = rows["a", "rechnung"]
    assert set(rows) == {("a", "rechnung"), ("a", "brief")} and a["pages"] == 3
    assert a["ground_truth"]["gt_parse"]["entities"]["parties"]["sender"] == "Absender: X" and a["ground_truth"]["gt_parse"]["language"] == "de"
    assert rows["a", "brief"]["ground_truth"]["gt_parse"]["language"] == "unknown"
    (b,) = D.rule_documents(df).collect()
    assert b["pages"] == 3 and b["ground_truth"]["gt_parse"]["entities"]["dates"] == ["01-02-2024"] and b["ground_truth"]["metadata"]["bboxes_available"]
    literal = D.regex_documents(df, literal=True).first()["ground_truth"]["gt_parse"]["entities"]
    assert literal["dates"] == [] and literal["parties"]["sender"] == ""
    assert D.regex_documents(df.limit(0)).count() == 0 and D.rule_documents(df.limit(0)).count() == 0


def test_organisations_come_from_the_pages(spark):
    pages = [("/in/brief/a_page1.jpg", "Finanzamt Berlin", ["Finanzamt Berlin", "Beispiel GmbH", "Haus 12"]), ("/in/brief/a_page2.jpg", "x", ["Beispiel GmbH", "Müller & Co", None]), ("/in/brief/a_page3.jpg", None, ["Fehlt AG"]), ("/in/brief/a_page4.jpg", "y", None)]
    df = spark.createDataFrame(pages, "path string, text string, organizations array<string>").selectExpr("*", "'de' AS lang", "true AS has_boxes")
    named = lambda d: D.rule_documents(d).first()["ground_truth"]["gt_parse"]["entities"]["organizations"]
    assert named(df) == ["Beispiel GmbH", "Müller  Co"] and named(df.drop("organizations")) == []


def test_json_round_trips(spark, tmp_path):
    pages = spark.createDataFrame([("/in/brief/ä.jpg", "An: Ä\n5 €", "de", True)], "path string, text string, lang string, has_boxes boolean")
    for f, ddl in ((D.regex_documents, schemas.REGEX_DOCUMENT), (D.rule_documents, schemas.RULE_DOCUMENT)):
        df = f(pages)
        files.write_documents(df, f"{tmp_path}/d", ordered=True)
        back = files.read_documents(spark, f"{tmp_path}/d", ddl)
        assert [json.dumps(r.asDict(True)) for r in back.collect()] == [json.dumps(r.asDict(True)) for r in df.collect()]
    (tmp_path / "a.json").write_text(json.dumps({"i1": {"image_id": "i1", "image_path": "p", "annotations": [{"field": "Date", "value": "v", "bbox": [1, 2, 3, 4], "confidence": 0.5}]}}))
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "r.json").write_text(json.dumps({"count": 1, "entries": [{"suggested_name": "n", "confidence": 0.4, "original": {"value": "x"}, "needs_review": True}]}))
    (tmp_path / "t.json").write_text(json.dumps([{"image_path": "p", "language": "de", "entities": {"a": 1}}]))
    assert files.read_annotations(spark, f"{tmp_path}/a.json").first()["annotations"][0]["bbox"] == [1, 2, 3, 4]
    assert files.read_annotations(spark, f"{tmp_path}/bad.json").count() == 0 and files.read_annotations(spark, f"{tmp_path}/none.json").count() == 0
    r = files.read_reviews(spark, f"{tmp_path}/r.json").first()
    assert (r["entry_id"], r["original"]["value"]) == (0, "x") and files.read_reviews(spark, f"{tmp_path}/none.json").count() == 0
    assert files.read_training(spark, f"{tmp_path}/t.json").first()["entities"] == '{"a": 1}'  # kept as written
    assert files.read_results(spark, f"{tmp_path}/none").count() == 0


def test_files_and_providers(spark, tmp_path):
    (tmp_path / "in" / "brief").mkdir(parents=True)
    for name, body in (("a.jpg", b"ein wort"), ("b.PNG", b"!"), ("c.pdf", b"p1|p2"), ("d.txt", b"x")):
        (tmp_path / "in" / "brief" / name).write_bytes(body)
    every = files.convertible(spark, f"{tmp_path}/in")
    assert {r["path"].rsplit("/", 1)[1]: r["kind"] for r in every.collect()} == {"a.jpg": "image", "b.PNG": "image", "c.pdf": "pdf"}

    def ocr(content):
        if content == b"!":
            raise ValueError("unreadable")
        return [(w, 0, 0, 1, 1, 90.0) for w in content.decode().split(" ")] + [(" ", 0, 0, 1, 1, 90.0)]

    read = files.words(every.filter("kind = 'image'"), ocr)
    assert sorted((r["text"] or "", r["error"] or "") for r in read.collect()) == [("", "ValueError: unreadable"), ("ein", ""), ("wort", "")]
    assert sorted(r["text"] for r in files.texts(read).collect()) == ["", "ein wort"]
    pages = files.page_images(every.filter("kind = 'pdf'"), lambda b: b.split(b"|"))
    assert sorted((r["page"], bytes(r["content"])) for r in pages.collect()) == [(1, b"p1"), (2, b"p2")]
    out = every.select(files.output_path(F.col("path"), f"{tmp_path}/in", "/out", "jpg").alias("o")).collect()
    assert {r["o"] for r in out} == {"/out/brief/a.jpg", "/out/brief/b.jpg", "/out/brief/c.jpg"}
    assert [r[0] for r in spark.createDataFrame([("a", 2, 3), ("b", 1, 1)], "b string, p int, n int").select(files.page_name(F.col("b"), F.col("p"), F.col("n"))).collect()] == ["a_page2", "b"]


def test_stream_resumes_and_curates_once(spark, tmp_path):
    ddl = "doc_id long, ordinal long, value string"
    source = lambda: spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    run = lambda: sorted(map(tuple, curate_stream(source(), f"{tmp_path}/out", f"{tmp_path}/state").select("doc_id", "ordinal", "valid").collect()))
    spark.createDataFrame([(1, 1, "v"), (1, 2, " "), (1, 1, "v")], ddl).coalesce(1).write.json(f"{tmp_path}/in")
    assert run() == [(1, 1, True), (1, 2, False)]
    spark.createDataFrame([(1, 2, "late"), (2, 1, "w")], ddl).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    assert run() == run() == [(1, 1, True), (1, 2, False), (2, 1, True)]


def test_links_take_the_first_word(spark):
    words = spark.createDataFrame([(1, 0, "ab", 1, 2, 3, 4), (1, 1, "xabx", 5, 6, 7, 8), (2, 0, "zz", 0, 0, 1, 1)], "image_id long, word_idx long, text string, x long, y long, w long, h long")
    entities = spark.createDataFrame([(1, "k", 0, "ab"), (1, "k", 1, "abx"), (2, "k", 0, "q"), (3, "k", 0, None)], "image_id long, kind string, pos long, value string")
    left = {(r["image_id"], r["pos"]): r["word_idx"] for r in linking.link(entities, words).collect()}
    assert left == {(1, 0): 0, (1, 1): 1, (2, 0): None, (3, 0): None}
    assert linking.link(entities, words, "inner").count() == 2


def test_hits_and_scale(spark):
    boxes = spark.createDataFrame([(1, 0, 0, 10, 10)], "image_id long, x1 long, y1 long, x2 long, y2 long")
    points = spark.createDataFrame([(1, 20, 20), (1, 21, 20), (2, 1, 1)], "image_id long, px long, py long")
    assert [r["px"] for r in geometry.hits(boxes, points, 2.0).collect()] == [20]


def test_review_errors_and_search(spark):
    entries = spark.createDataFrame([(0, "Müller", True), (1, "x", False)], "entry_id long, name string, needs_review boolean")
    assert records.unmatched_corrections(entries, spark.createDataFrame([(5, "c"), (1, "d")], "entry_id long, user_correction string")).count() == 1
    assert records.search(entries, "MÜLL", ["name"]).count() == 1 and records.search(entries, "x", ["name"], only_open=True).count() == 0


def test_fields_equal_a_plain_version(spark, sf):
    """Blocks and fields of a whole table from lines, by plain loops."""
    lined = layout.lines(layout.confident(layout.ocr_words(spark.read.parquet(f"{sf}/documents.parquet")))).cache()
    by = {}
    for r in lined.collect():
        by.setdefault((r["image_id"], r["line"]), []).append(r)
    texts, want = [], set()
    for (image, line), ws in by.items():
        ws.sort(key=lambda r: (r["x"], r["y"], r["word_idx"]))
        gaps = [b["x"] - a["x"] - a["w"] for a, b in zip(ws, ws[1:])]
        mean, width = (sum(gaps) / len(gaps) if gaps else 0), sum(r["w"] for r in ws) / len(ws)
        cut = len(ws) >= 2 and (mean > 2 * width or len(ws) <= 3)
        parts = [[ws[0]]]
        for g, r in zip(gaps, ws[1:]):
            if cut and g > max(2 * mean, 3 * width):
                parts.append([])
            parts[-1].append(r)
        for k, part in enumerate(parts):
            texts.append((image, line, k, " ".join(r["text"] for r in part), part))
    kinds = {(r["i"], r["l"], r["b"]): r["c"] for r in spark.createDataFrame([t[:4] for t in texts], "i long, l long, b long, t string").select("i", "l", "b", T.layout_class(F.col("t")).alias("c")).collect()}
    for image, line, k, text, part in texts:
        kind = kinds[image, line, k]
        if len(text.strip()) < 2 or (kind is None and len(part) < 2):
            continue
        x1, y1, x2, y2 = min(r["x"] for r in part), min(r["y"] for r in part), max(r["x"] + r["w"] for r in part), max(r["y"] + r["h"] for r in part)
        px, py = int((x2 - x1) * 0.05), int((y2 - y1) * 0.05)
        want.add((image, line, k, text, kind or "Unknown", max(0, x1 - px), max(0, y1 - py), x2 + px, y2 + py, round(sum(r["conf"] for r in part) / len(part), 6)))
    got = {tuple(r) for r in Q.QUERIES["field_annotations"](spark, sf).collect()}
    assert want and got == want


def test_only_parts_that_open_values_are_candidates(spark):
    words = spark.createDataFrame([(i, k, x, k, 0, 5, 5) for i in (1, 2) for k, x in enumerate(["Rechnungsnummer", "unterschreiben", "", "ab", "Rechnung"])], "image_id long, word_idx long, text string, x long, y long, w long, h long")
    opened = lambda *vs: spark.createDataFrame([(v,) for v in vs], "_g string").select(linking._slot("_g").alias("_slot"), F.length("_g").alias("_n"))
    found = lambda o: sorted((r["image_id"], r["_t"], r["_g"]) for r in linking.candidates(words, o).collect())
    assert found(opened("Rec")) == [(i, x, "Rec") for i in (1, 2) for x in ("Rechnung", "Rechnungsnummer")]
    assert [x for x in found(opened("", "ab")) if x[0] == 1] == [(1, "", ""), (1, "Rechnung", ""), (1, "Rechnungsnummer", ""), (1, "ab", ""), (1, "ab", "ab"), (1, "unterschreiben", "")]
    assert found(opened("Rec").limit(0)) == []


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_languages_are_counted_without_looking_for_entities(spark, sf):
    from scanloom.plans import profiles

    assert "regexp_extract_all" not in _optimized(profiles.QUERIES["summary_by_language"](spark, sf))


def test_pages_are_cleaned_once(spark):
    from scanloom.plans import documents

    pages = spark.createDataFrame([("/in/a/b_page1.jpg", "Rechnung Nr. 1", "de", True)], "path string, text string, lang string, has_boxes boolean")
    assert _optimized(documents.regex_documents(pages)).count(r"[\x00-\x08") == 1


def test_organisations_are_found_without_looking_for_entities(spark):
    rows = [("/in/a/x.jpg", "Finanzamt Bonn\nAcme Bau 01.02.2024 Hauptstr 12, 10115 Berlin", "de", True, ["Acme Bau"]), ("/in/a/y.jpg", None, None, True, None)]
    pages = spark.createDataFrame(rows, "path string, text string, lang string, has_boxes boolean, organizations array<string>")
    g = F.col("ground_truth.gt_parse")
    read = lambda docs: docs.select("file_name", "pages", g["entities"]["organizations"].alias("o"), g["content"]["header"]["tax_office"].alias("t"), "ground_truth.raw_text")
    few = D.rule_documents(pages, entities=False)
    assert read(few).collect() == read(D.rule_documents(pages)).collect()
    assert few.select(g["entities"]["dates"]).first()[0] == [] and P.RECIPIENT not in _optimized(few)


def test_images_take_no_exchange_beside_that_of_their_boxes(spark, sf):
    from scanloom.plans import files as Q

    plan = Q._images(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_rules_find_what_the_plain_patterns_find(spark):
    r = random.Random(5)
    bits = ["12.03.2024", "3. märz 2024", "5 Mai 1999", "ſep 3, 2020", "1.1.19", "２.3.2024", "Für Herrn Muster", "sehr geehrte Anna", "Steuer", "Ünal", "Hauptstr 12, 10115 Berlin", "10115 Ulm", "a.b@example.com", "x@mail.example.org", "y@@z.de", "é@x.fr v@w.nl", "+49 171 123 456", "0612345678", "(030)12345", "040/123456", "IdNr 92 047 135 123", "Steuernummer 123/4567/8901", "2024,39.039", "CAP/UCF/24/017R", "kenmerk: AB-2024/7", "“x”", "ﬁn", "\\n", "Finanzamt Bad Muster"]
    texts = [(r.choice([" ", "\n", ""]).join(r.choice(bits) for _ in range(r.randrange(0, 14))),) for _ in range(1500)]
    ok = lambda x: ~T.contains_any(x, P.RECIPIENT_BARRED)
    size = lambda x: F.length(F.regexp_replace(x, r"[^\d+]", ""))
    plain = {
        T.dates_rules: lambda t: F.slice(F.array_distinct(F.concat(T.hits(t, P.either(P.RULE_DATE_ENTITIES)), F.filter(T.all_of(t, P.RULE_DATES), lambda x: x.rlike(r"(19|20)\d{2}")))), 1, 10),
        T.phones_rules: lambda t: F.slice(F.filter(T.all_of(t, P.RULE_PHONES, T.EXACT), lambda x: size(x).between(6, 15)), 1, 3),
        T.emails_rules: lambda t: F.slice(F.array_distinct(T.hits(t, P.RULE_EMAIL.format(P.EMAIL_NOT_EXAMPLE))), 1, 2),
        T.recipient_name: lambda t: T.first(F.filter(F.concat(T.hits(t, P.RECIPIENT, T.EXACT), T.hits(t, P.TITLE_WORD, T.EXACT)), ok)),
        T.recipient_address: lambda t: T.first(T.hits(t, P.RECIPIENT_ADDRESS, T.EXACT), None),
        T.tax_office: lambda t: T.first(T.tax_organisations(t)),
        lambda t: T.hits(t, T.hoisted(P.RULE_IDS), T.EXACT): lambda t: T.hits(t, P.either(P.RULE_IDS), T.EXACT),
    }
    df = spark.createDataFrame([*texts, (None,)], "t string")
    t = F.col("t")
    for k, (f, g) in enumerate(plain.items()):
        assert df.filter(~f(t).eqNullSafe(g(t))).count() == 0, k


def test_a_text_is_read_once_for_equal_pages(spark):
    rows = [(f"/in/a/x_page{k}.jpg", t, "de", b) for k, (t, b) in enumerate([("am 1.2.2024", True), ("am 1.2.2024", False), (None, True), ("am 3.4.2024", True), (None, False)], 1)]
    df = spark.createDataFrame(rows, "path string, text string, lang string, has_boxes boolean")
    out = D.rule_pages(df)
    got = {x["page"]: (x["text"], x["dates"], x["has_boxes"], x["content"]["header"] and x["content"]["header"]["date"]) for x in out.collect()}
    assert got == {1: ("am 1.2.2024", ["1.2.2024"], True, "1.2.2024"), 2: ("am 1.2.2024", ["1.2.2024"], False, None), 3: (None, None, True, ""), 4: ("am 3.4.2024", ["3.4.2024"], True, "3.4.2024"), 5: (None, None, False, None)}
    plan = D.rule_pages(df)._jdf.queryExecution().executedPlan().toString()
    assert "_pages" in plan and plan.count("Exchange") == 1


def test_layout_classes_are_tried_where_a_digit_or_an_at_is(spark):
    rows = [(t,) for t in ("12.03.2024", "5 May 1999", "AB-123/2024", "ID 12345", "REF: 1234", "a@b.org", "+49 171 123 456", "२२.०३.२०२४", "no sign", "May", "", "x 7", None)]
    df, t = spark.createDataFrame(rows, "t string"), F.col("t")
    assert df.filter(~T.layout_class(t).eqNullSafe(T._class(t, P.LAYOUT_CLASSES, None))).count() == 0
    assert r"[\d@]" in df.select(T.layout_class(t))._jdf.queryExecution().optimizedPlan().toString()


def test_runs_tried_from_their_start_find_what_plain_patterns_find(spark):
    r = random.Random(4)
    bits = ["a", "B", "ab", "a.b", "@", "@", ".de", "_", "+", "-", "/", "/", "1", "22", "333", "4444", ".", ",", " €", "€", " ", "\n", "12-03-2024", "1. Mai 2024", "2024.05", "ſ", "٣", "Summe: ", "31", "(0)", "a@b.de", "x@y.com", "ab/cd/1/2"]
    rows = [("".join(r.choices(bits, k=r.randrange(25))),) for _ in range(800)] + [("a@b.com_x@y.org a@b.deab/cd/1/2ab/c/3/4", ), ("",), (None,)]
    t = F.col("t")
    pairs = {
        "emails": (T.emails_regex(t), T.hits(t, P.REGEX_EMAIL, "")),
        "numbers": (T.document_numbers_regex(t), F.concat(T.all_of(t, P.REGEX_NUMBERS), T.hits(t, P.REGEX_NUMBER_BARE, T.ANY, 1))),
        "amounts": (T.amounts(t), T.all_of(t, P.REGEX_AMOUNTS)),
        "dates": (T.dates_regex(t), F.array_distinct(F.filter(T.hits(t, P.either(P.REGEX_DATES)), T.is_valid_date))),
        "phones": (T.phones_regex(t), F.transform(T.hits(t, P.REGEX_PHONE, T.EXACT), T.clean_phone)),
        "spaces": (T.clean_spaces(F.concat(t, t)), F.trim(F.regexp_replace(F.concat(t, t), r"(?U)\s+", " "))),
        "line": (T.line_with(t, ["ab", "€"]), T.first(F.filter(F.split(t, "\n"), lambda x: T.contains_any(x, ["ab", "€"])))),
        "language": (T.language_or_unknown(F.lit("de"), t), F.when(F.coalesce(T.strip(t), F.lit("")) == "", "unknown").otherwise("de")),
    }
    df = spark.createDataFrame(rows, "t string")
    for name, (a, b) in pairs.items():
        got = df.select(t, a.alias("a"), b.alias("b"))
        assert got.filter(~F.col("a").eqNullSafe(F.col("b"))).collect() == [], name
    assert df.select(T.emails_regex(t).alias("x")).filter("size(x) > 0").count() > 20


def test_regex_profile_reads_a_text_once_for_all_its_pages(spark):
    pages = spark.createDataFrame([(f"/in/brief/a_page{k}.jpg", x, "de") for k, x in ((1, "x@y.de"), (2, "x@y.de"), (3, "z@y.de"), (4, None), (5, "x@y.de"))], "path string, text string, lang string")
    read = D._by_text(D._keyed(pages), "page")
    assert sorted((r["text"] or "", len(r["_pages"])) for r in read.collect()) == [("", 1), ("x@y.de", 3), ("z@y.de", 1)] and "_pages" in _optimized(D.regex_documents(pages))
    got = D.regex_documents(pages).first()
    assert got["pages"] == 5 and got["ground_truth"]["raw_text"] == "x@y.de\nx@y.de\nz@y.de\nx@y.de" and got["ground_truth"]["gt_parse"]["entities"]["contact_data"]["emails"] == ["x@y.de", "z@y.de"]


def test_pages_are_dealt_with_their_invoices(spark, sf):
    from scanloom.plans import profiles

    plan = profiles._pages(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [o_orderkey") == 2
