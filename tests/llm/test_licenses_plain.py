"""Licence scans: whole results against a plain TF-IDF scan and a walk up the directories."""

import math
import random
import re
from collections import Counter

import pytest

from scanloom.llm import licenses as Lic


def _terms(t):
    return [x for x in re.split("[^a-z0-9]+", t.lower()) if x]


def _scan(rows, threshold=0.6):
    n, df = len(rows), Counter(t for _, _, text in rows for t in set(_terms(text or "")))
    idf = lambda t: math.log((n + 1) / (df[t] + 1)) + 1
    shapes = []
    for _, text in Lic.ALL:
        tf = Counter(_terms(text))
        norm = math.sqrt(sum((c * idf(t)) ** 2 for t, c in tf.items()))
        shapes.append({t: c * idf(t) / norm for t, c in tf.items()})

    def cosine(ws, k):
        tf = Counter(ws)
        norm = math.sqrt(sum((c * idf(t)) ** 2 for t, c in tf.items()))
        return round(sum(c * idf(t) * shapes[k].get(t, 0) for t, c in tf.items()) / norm, 9) if norm else 0

    own = []
    for _, path, text in rows:
        text, ws, found = text or "", _terms(text or ""), []
        if re.search(Lic.ANCHOR, text):
            is_file = bool(re.match(Lic.LICENCE_FILE, (path or "").rsplit("/", 1)[-1]))
            found += [(cosine(_terms(x), k), -k) for x in text.split("\n") if re.search(Lic.ANCHOR, x) for k in range(Lic.SHORT)]
            found += [(cosine(ws, k), -k) for k in range(len(Lic.ALL))] if is_file else []
            for p, w in enumerate(ws):
                w = w.replace("licenc", "licens")
                found += [(cosine(ws[max(0, p - at) : p - at + size], k), -k) for k, mark, at, size in Lic.laid() if mark == w]
        best = max(found, default=(0, 0))
        own.append((Lic.ALL[-best[1]][0], best[0]) if best[0] >= threshold else None)
    given = {}
    for (i, path, _), mine in sorted(zip(rows, own, strict=True), key=lambda x: x[0][0]):
        if path is not None and mine and re.match(Lic.LICENCE_FILE, path.rsplit("/", 1)[-1]):
            given.setdefault(path.rpartition("/")[0], mine)
    out = []
    for (i, path, _), mine in zip(rows, own, strict=True):
        at = None if mine or path is None else path.rpartition("/")[0]
        while at is not None and at not in given:
            at = at.rpartition("/")[0] if at else None
        if mine:
            out.append((i, path, mine[0], mine[1], "own", None))
        else:
            out.append((i, path, given[at][0], given[at][1], "inherited", at) if at is not None else (i, path, None, None, None, None))
    return out


def test_scans_are_those_of_a_plain_walk(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice(["ta", "ren", "so", "the", "of", "work", "lic"]) for _ in range(r.randrange(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for i in range(240):
        kind, (_, text) = i % 8, r.choice(Lic.TEMPLATES + Lic.HEADERS)
        ws = text.split()
        near = " ".join(w for w in ws if r.random() > 0.15)
        body = [prose(60), f"{prose(9)} {text} {prose(9)}", f"{prose(5)}\n{near}\n{prose(5)}", text.replace(" ", "\n", 4), None, prose(3) + " licence of permission " + prose(20), "", near.upper()][kind]
        folder = "/".join(["repo", *[f"d{r.randrange(3)}" for _ in range(r.randrange(4))]][r.randrange(2) :])
        name = "LICENSE" if i % 5 == 0 else r.choice(["a.txt", "Copying.md", "licence-mit.txt", "notlicense"])
        if i % 20 == 0:
            body = r.choice([Lic.TEXTS["MIT"], Lic.TEXTS["ISC"], Lic.TEXTS["BSD-2-Clause"] + prose(30)])
        rows.append((i, None if i % 31 == 0 else f"{folder}/{name}" if folder else name, body))
    rows += rows[:6]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").repartition(4)
    got = sorted((tuple(x) for x in Lic.scan_licenses(df, "doc_id", "path").select("doc_id", "path", "license", "score", "origin", "from_dir").collect()), key=repr)
    want = sorted(_scan(rows), key=repr)
    assert Counter(x[4] for x in want)["own"] > 50 and Counter(x[4] for x in want)["inherited"] > 20
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3] and g[4:] == w[4:] and (g[3] == pytest.approx(w[3], abs=1e-8) if w[3] is not None else g[3] is None), (g, w)
