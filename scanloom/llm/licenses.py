"""Licence scans: sparse TF-IDF cosine of licence passages to templates, then inheritance from the nearest ancestor
directory that has a licence file, by joins on paths. Native: DataFrame expressions and joins alone.

A passage is a line that names a licence, copyright or the like (an anchor), the whole text of a licence file, or a window
of a statement's or header's length laid over the text's words, whatever its line breaks, so that a mark ("license",
"permission") falls on its place in that template. Windows are compared with their template, lines with statements and
headers, whole files also with the whole texts of the licences (`license_texts`). Terms
are weighed by their document frequency over the whole table: all terms are counted, in one table that is joined by term.
"""

from __future__ import annotations

import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

from .shared import removed, shared_dir, stored

#: Short statements by which texts name public licences, and the titles of the licences' own texts.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under the CC0 1.0 Universal license."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and its license terms."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]
#: Whole texts by licence, and the standard headers that source files carry, cut from the texts that recommend them.
TEXTS = {f.stem: f.read_text() for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def _cut(name: str, start: str, end: str) -> str:
    at = TEXTS[name].index(start)
    return TEXTS[name][at : TEXTS[name].index(end, at) + len(end)]


_GPL3 = _cut("GPL-3.0", "This program is free software", "gnu.org/licenses/>.")
HEADERS = [
    ("AGPL-3.0", _GPL3.replace("GNU General", "GNU Affero General")),
    ("Apache-2.0", _cut("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License")', "limitations under the License.")),
    ("GPL-2.0", _cut("GPL-2.0", "This program is free software", "FITNESS FOR A PARTICULAR PURPOSE.  See the") + " GNU General Public License for more details."),
    ("GPL-3.0", _GPL3),
    ("LGPL-2.1", _cut("LGPL-2.1", "This library is free software", "License for more details.")),
    ("LGPL-3.0", _GPL3.replace("GNU General", "GNU Lesser General")),
    ("MPL-2.0", _cut("MPL-2.0", "This Source Code Form is subject to the terms", "mozilla.org/MPL/2.0/.")),
]
#: Statements and headers, then whole texts, with which whole files alone are compared.
ALL = [*TEMPLATES, *HEADERS, *TEXTS.items()]
SHORT = len(TEMPLATES) + len(HEADERS)
ANCHOR = r"(?i)licen[cs]|copyright|spdx|public domain|permission|redistribution|cc0"
#: Terms at which windows are laid; both spellings are one.
MARKS = ["cc0", "copyright", "domain", "license", "licensed", "licenses", "permission", "redistribution", "redistributions", "spdx"]
#: Whole texts up to so many terms stand in source files as headers, too.
HEADER_TERMS = 300
LICENCE_FILE = r"(?i)^((un)?licen[cs]e|copying)([-._][a-z0-9.-]+)?$"


def terms(text: str) -> list[str]:
    return [t for t in re.split("[^a-z0-9]+", text.lower()) if t]


def _terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def laid() -> list[tuple[int, str, int, int]]:
    """(template, mark, its first place, length): where a window of the template's length lies around a mark of a text."""
    out = []
    for k, (_, text) in enumerate(ALL):
        t = terms(text)
        if k < SHORT or len(t) <= HEADER_TERMS:
            out += [(k, m, t.index(m), len(t)) for m in MARKS if m in t]
    return out


def windows(rows: DataFrame, weights: list[tuple[int, str, float]], threshold: float) -> DataFrame:
    """_row, passage, only (the template to compare with) and terms of the windows at a row's spots that can reach the threshold.

    Of unit vectors, the template's part that a window shares is at least as long as their cosine; shorter ones are left out."""
    spark = rows.sparkSession
    of: dict[int, list[tuple[str, float]]] = {}
    for k, t, w in weights:
        of.setdefault(k, []).append((t, w * w))
    shapes = [(n, k, mark, at, size, [t for t, _ in of[k]], [w for _, w in of[k]]) for n, (k, mark, at, size) in enumerate(laid())]
    # sized by the templates alone
    lay = F.broadcast(spark.createDataFrame(shapes, "lay int, only int, mark string, place int, size int, own array<string>, squares array<double>"))
    spots = rows.select("_row", F.posexplode("spots").alias("spot", "s")).select("_row", "spot", "s.*").join(lay, "mark")
    start = F.greatest(F.lit(1), F.col("at") - F.col("place"))
    cut = F.slice("around", start, F.col("size") - (start - (F.col("at") - F.col("place"))))
    shared = F.aggregate(F.arrays_zip("own", "squares"), F.lit(0.0), lambda a, x: a + F.when(F.array_contains("shared", x["own"]), x["squares"]).otherwise(0.0))
    spots = spots.withColumn("terms", cut).withColumn("shared", F.array_intersect("terms", "own")).filter(shared >= threshold * abs(threshold) - 1e-9)
    return spots.select("_row", (-1 - F.col("lay") - F.col("spot").cast("long") * len(shapes)).alias("passage"), "only", "terms")


def document_frequencies(df: DataFrame, text_col: str) -> DataFrame:
    """term and n, the rows whose text has it, for every term of the table; the empty term's n counts all rows."""
    marks = F.array_distinct(_terms(F.coalesce(F.col(text_col), F.lit(""))))
    return df.select(F.explode(F.concat(F.array(F.lit("")), marks)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def template_frequencies(counts: DataFrame) -> tuple[int, dict[str, int]]:
    """Rows, and for each template term the rows whose text has it."""
    known = sorted({t for _, text in ALL for t in terms(text)})
    # the templates' own terms alone come to the driver
    asked = F.broadcast(counts.sparkSession.createDataFrame([(t,) for t in ["", *known]], "term string"))
    found = {r["term"]: r["n"] for r in counts.join(asked, "term").collect()}
    return found.get("", 0), {t: found.get(t, 0) for t in known}


def template_weights(n: int, df: dict[str, int]) -> list[tuple[int, str, float]]:
    """(template, term, weight) of unit-length templates."""
    idf = {t: math.log((n + 1) / (k + 1)) + 1 for t, k in df.items()}
    rows = []
    for k, (_, text) in enumerate(ALL):
        tf: dict[str, int] = {}
        for t in terms(text):
            tf[t] = tf.get(t, 0) + 1
        norm = math.sqrt(sum((c * idf[t]) ** 2 for t, c in tf.items()))
        rows += [(k, t, c * idf[t] / norm) for t, c in tf.items()]
    return rows


def scan_licenses(df: DataFrame, id_col: str, path_col: str, text_col: str = "text", threshold: float = 0.6) -> DataFrame:
    """One row per input row: id_col, path, license, score (cosine), origin ('own', 'inherited' or null), from_dir.

    Whole texts are read. A row's own licence is that of its passage most like a template, at least `threshold`; ties
    go to the earlier template. Others take the licence of the nearest directory at or above theirs that holds a licence
    file with one (the smallest id's, if several). Null texts have none of their own, null paths inherit nothing, rows of
    equal paths count each for themselves; an empty table gives an empty result; other columns are ignored.
    """
    spark, at = df.sparkSession, shared_dir(df.sparkSession)
    counts = stored(document_frequencies(df, text_col), f"{at}/terms")
    n, own_terms = template_frequencies(counts)
    weights = template_weights(n, own_terms)
    name = F.element_at(F.split(F.coalesce(F.col(path_col), F.lit("")), "/"), -1)
    rows = df.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), name.rlike(LICENCE_FILE).alias("is_file"))
    named = F.col("text").rlike(ANCHOR)
    rows = rows.withColumn("terms", F.when(named, _terms(F.col("text"))).otherwise(F.array().cast("array<string>")))
    before, after = max(at for _, _, at, _ in laid()), max(size - at for _, _, at, size in laid())
    marks = ", ".join(f"'{m}'" for x in MARKS for m in sorted({x, x.replace("licens", "licenc")}))
    spots = F.expr(f"""transform(filter(transform(terms, (t, i) -> if(t IN ({marks}), i + 1, 0)), p -> p > 0), p -> struct(replace(element_at(terms, p), 'licenc', 'licens') AS mark,
        slice(terms, greatest(1, p - {before}), least(p - 1, {before}) + {after}) AS around, least(p, {before + 1}) AS at))""")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(ANCHOR))
    rows = rows.select("_row", "id", "path", "is_file", F.transform(lines, lambda x: F.struct(x.alias("_text"), F.lit(False).alias("whole"))).alias("lines"), F.when(F.col("is_file") & named, F.array(F.struct(F.col("text").alias("_text"), F.lit(True).alias("whole")))).alias("whole"), spots.alias("spots"))
    rows = rows.select("_row", "id", "path", "is_file", "spots", F.concat("lines", F.coalesce("whole", F.array())).alias("passages"))
    rows = stored(rows, f"{at}/rows")
    passages = rows.select("_row", F.posexplode("passages").alias("passage", "p")).select("_row", "passage", F.when(~F.col("p.whole"), -1).alias("only"), _terms(F.col("p._text")).alias("terms"))
    passages = passages.withColumn("passage", F.col("passage").cast("long")).unionByName(windows(rows, weights, threshold))
    # compared with: a window its template, a line (-1) the short ones, a whole file (null) all
    tf = passages.select("_row", "passage", "only", F.explode("terms").alias("term")).groupBy("_row", "passage", "only", "term").agg(F.count(F.lit(1)).alias("tf"))
    # every term of a passage is one of its text and so has a count
    known = counts.select("term", (F.log((n + 1) / (F.col("n") + 1)) + 1).alias("idf"))
    # sized by the templates alone
    shapes = F.broadcast(spark.createDataFrame(weights, "template int, term string, w double"))
    weighed = tf.join(known, "term").withColumn("x", F.col("tf") * F.col("idf"))
    norms = weighed.groupBy("_row", "passage").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = weighed.join(shapes, "term").filter(F.col("only").isNull() | (F.col("only") == F.col("template")) | ((F.col("only") == -1) & (F.col("template") < SHORT))).groupBy("_row", "passage", "template").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    likeness = dots.join(norms, ["_row", "passage"]).select("_row", "template", F.round(F.col("dot") / F.col("norm"), 9).alias("score")).filter(F.col("score") >= threshold)
    best = likeness.groupBy("_row").agg(F.max(F.struct(F.col("score"), (-F.col("template")).alias("t"))).alias("b"))
    names = F.array(*[F.lit(k) for k, _ in ALL])
    own = best.select("_row", F.col("b.score").alias("score"), F.get(names, -F.col("b.t")).alias("own"))
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    placed = stored(rows.drop("passages", "spots").join(own, "_row", "left").withColumn("dir", folder), f"{at}/own")
    removed(spark, f"{at}/terms", f"{at}/rows")
    given = placed.filter("is_file AND own IS NOT NULL").groupBy("dir").agg(F.min_by(F.struct("own", "score"), "id").alias("g")).select(F.col("dir").alias("from_dir"), F.col("g.own").alias("inherited"), F.col("g.score").alias("its_score"))
    # each directory once, with its ancestors; then each file takes its directory's nearest
    dirs = placed.filter("path IS NOT NULL").select("dir").distinct()
    above = dirs.select("dir", F.explode(F.expr("transform(sequence(0, size(split(dir, '/'))), i -> struct(i AS depth, array_join(slice(split(dir, '/'), 1, i), '/') AS up))")).alias("a")).select("dir", "a.depth", F.col("a.up").alias("from_dir"))
    nearest = above.join(given, "from_dir").groupBy("dir").agg(F.max_by(F.struct("from_dir", "inherited", "its_score"), "depth").alias("g")).select(F.col("dir").alias("_dir"), "g.*")
    out = placed.join(nearest, F.col("dir") == F.col("_dir"), "left")
    has = F.col("own").isNotNull()
    origin = F.when(has, "own").when(F.col("inherited").isNotNull(), "inherited")
    return out.select(F.col("id").alias(id_col), "path", F.coalesce("own", "inherited").alias("license"), F.when(has, F.col("score")).otherwise(F.col("its_score")).alias("score"), origin.alias("origin"), F.when(~has, F.col("from_dir")).alias("from_dir"))
