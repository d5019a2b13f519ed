"""Token automata against a plain search on random tokens."""

import random
import re

import pytest
from pyspark.sql import functions as F

from scanloom.functions import patterns as P
from scanloom.operators import token_patterns as N

CHARS = {"A": lambda t: t == "a", "B": lambda t: t == "b", "X": lambda t: t in "ab"}


def _ends(ts, pattern, at, step=0):
    """Every place where the pattern from `step` on may end, when it starts at `at`."""
    if step == len(pattern):
        return {at}
    test, optional, repeats = pattern[step]
    out = _ends(ts, pattern, at, step + 1) if optional else set()
    k = at
    while k < len(ts) and CHARS[test](ts[k]):
        k += 1
        out |= _ends(ts, pattern, k, step + 1)
        if not repeats:
            break
    return out


def _plain(ts, patterns):
    at, out = 0, []
    while at < len(ts):
        ends = [e for p in patterns for e in _ends(ts, p, at) if e > at]
        if ends:
            out.append(" ".join(ts[at : max(ends)]))
        at = max(ends, default=at + 1)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_automata_find_what_a_plain_search_finds(spark, seed):
    r = random.Random(seed)
    patterns = [[(r.choice("ABX"), r.random() < 0.4, r.random() < 0.4) for _ in range(r.randrange(1, 5))] for _ in range(r.randrange(1, 3))]
    steps = [[N.Step({"A": N.letters(words=["a"]), "B": N.letters(words=["b"]), "X": N.letters(words=["a", "b"])}[t], o, m) for t, o, m in p] for p in patterns]
    rows = [(k, " ".join(r.choices("aabbc", k=r.randrange(14)))) for k in range(80)] + [(900, None), (901, ""), (902, "a b " * 2000)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {x["id"]: x["found"] for x in df.select("id", N.search(N.tokens(F.col("text")), steps).alias("found")).collect()}
    assert got[900] is None
    for k, t in rows:
        if t is not None:
            assert got[k] == _plain(t.split(), patterns), (patterns, t)


def test_tokens_know_their_borders(spark):
    df = spark.createDataFrame([("Nr.12a, Ä x",)], "text string")
    got = [tuple(t) for t in df.select(N.tokens(F.col("text")).alias("t")).first()["t"]]
    assert got == [("Nr", "nr", "letters", True, True, True), (".", ".", "sign", True, True, True), ("12", "12", "figures", True, True, False), ("a", "a", "letters", True, False, True), (",", ",", "sign", True, True, True), ("Ä", "ä", "letters", False, True, True), ("x", "x", "letters", False, True, True)]


def test_id_forms(spark):
    texts = ["Akte 2024.05.123 und 2024,05,123 nicht 2024.05.1234, 12024.05.123 oder 2024 .05.123", "AB/CDE/24/123 AB/CDE/24/1234R ABCDE/AB/24/123 AB/CD/24/123RR ab/CD/24/123", "IdNr 92 047 135 123, IdNr: 92 047 135 123; Id-Nr. 92 047 135 123 Steuernummer 92 047 135 123", "Steuernr 123/4567/8901 Steuernummer 123/4567/89012 xSteuernr 123/4567/8901"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in df.select(N.search(N.tokens(F.col("text")), N.id_patterns())).collect()]
    assert got == [["2024.05.123", "2024,05,123"], ["AB/CDE/24/123", "AB/CDE/24/1234R"], ["IdNr 92 047 135 123", "IdNr: 92 047 135 123", "Id-Nr. 92 047 135 123", "Steuernummer 92 047 135 123"], ["Steuernr 123/4567/8901"]]
    assert got == [[m[0] for m in re.finditer(P.either(P.RULE_IDS), t)] for t in texts]


def _both(spark, texts, patterns):
    """What search() and found_in() find."""
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    toks = N.tokens(F.col("text"))
    one = {r["id"]: tuple(r)[1:] for r in df.select("id", *[N.search(toks, p).alias(k) for k, p in patterns.items()]).collect()}
    rows = N.found_in(df, patterns, ["id"]).collect()
    assert len(rows) == len(texts)
    return one, {r["id"]: tuple(r)[1:] for r in rows}


def test_arrays_find_what_the_column_finds(spark):
    r = random.Random(11)
    bits = ["a", "b", "Ab", "ÄB", "ﬁ", "12", "2024", ".", "/", "-", "€", "\U00010400\U00010428", "٣", " ", "  ", "\t", "\n", " ", "nr", "NR", "\0"]
    texts = ["".join(r.choices(bits, k=r.randrange(18))) for _ in range(250)] + [None, "", " ", "\n", "a " * 3000, "nr 2024 " * 500]
    tests = [N.letters(), N.letters(2), N.letters(1, 2, upper=True), N.letters(words=["nr", "ab"]), N.title(), N.title(2), N.figures(2), N.figures(1, 4), N.sign("./-€"), N.sign("a"), N.also(N.letters(), glued=False), N.also(N.figures(1, 9), ends=True), N.also(N.letters(), starts=True, glued=True)]
    patterns = {f"p{k}": [[N.Step(r.choice(tests), r.random() < 0.35, r.random() < 0.35) for _ in range(r.randrange(1, 5))] for _ in range(r.randrange(1, 4))] for k in range(12)}
    column, arrays = _both(spark, texts, patterns)
    assert column == arrays and sum(len(x) for v in arrays.values() for x in v if x) > 1000
    assert N.found_in(spark.createDataFrame([], "id long, text string"), patterns, ["id"]).count() == 0


def test_arrays_find_the_rule_profile(spark):
    texts = ["Akte 2024.05.123 und 2024,05,123\tIdNr:  92 047 135 123", "Für  Herrn Muster\nFÜR FRAU Ärmel, Hauptstr 12 , 10115\n Berlin Finanzamt Köln  Nord 5 finanzamt", "Id-Nr. 92 047 135 123 xSteuernr 123/4567/8901 AB/CDE/24/1234R", None]
    column, arrays = _both(spark, texts, {"ids": N.id_patterns(), "addresses": N.address_patterns(), "recipients": N.recipient_patterns(), "offices": N.office_patterns()})
    assert column == arrays and arrays[1][3] == ["Finanzamt Köln Nord", "finanzamt"] and arrays[3] == (None,) * 4
