"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation estimates each rule's accuracy
from votes and abstentions, and a document's posterior probability of being good decides.

Native: statistics, votes and verdicts are DataFrame expressions. The one thing collected is the count of each
pattern of votes, at most 2 ** len(RULES) rows however many documents there are.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .shared import SPACE, free_name, quoted, shared_dir, stored

#: name, votes good (else bad), condition over the statistics. Bad rules look for one defect each; good rules for signs of prose.
RULES: list[tuple[str, bool, str]] = [
    ("few_words", False, "n_words < 20"),
    ("symbols", False, "n_symbols > 0.1 * n_words"),
    ("no_letters", False, "n_letters < 0.8 * word_chars"),
    ("capitals", False, "n_capitals > 0.3 * n_letters"),
    ("exclaims", False, "n_exclaims > 0.2 * n_words"),
    ("bars", False, "n_bars > 0.2 * n_words"),
    ("repeats", False, "n_repeat_words > 0.3 * n_words"),
    ("few_kinds", False, "n_kinds < 0.15 * n_words AND n_words >= 20"),
    ("dup_lines", False, "n_dup_lines >= 3 AND n_dup_lines > 0.3 * n_lines"),
    ("long_words", False, "word_chars > 15 * n_words"),
    ("plain", True, "n_words >= 20 AND n_symbols < 0.02 * n_words"),
    ("letters", True, "n_words >= 20 AND n_letters > 0.9 * word_chars"),
    ("small", True, "n_letters > 0 AND n_capitals < 0.15 * n_letters"),
    ("fresh", True, "n_words >= 20 AND n_repeat_words < 0.1 * n_words"),
    ("sentences", True, "n_stops BETWEEN 0.02 * n_words AND 0.3 * n_words"),
]


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_kinds", "n_letters", "n_capitals", "n_exclaims", "n_bars", "n_stops")


def text_statistics(df: DataFrame, text_col: str = "text", name: str = "quality") -> DataFrame:
    """df with a struct column `name` of counts (COUNTS, longs) of each whole text; it must be no column of df.

    Repeated windows are found inside the row: 64-bit hashes of three words each are compared, and only where two
    are equal are they sorted with their places, so a text costs memory in proportion to its length. Null texts have
    no words; all counts of empty texts are 0; repeated rows have equal counts; an empty table stays empty; other
    columns pass, whatever their names.
    """
    text, words, lines, hashes, places = (free_name(df, x) for x in ("_text", "_words", "_lines", "_hashes", "_places"))
    without = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    n = F.length(text)
    first = df.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    # each step's arrays are used more than once in the next, so the optimizer keeps them computed once
    step = first.withColumn(words, F.array_remove(F.split(text, SPACE), "")).withColumn(lines, F.expr(rf"filter(split({text}, '\n'), x -> translate(x, ' \t\n\u000b\u000c\r', '') <> '')"))
    step = step.withColumn(hashes, F.expr(f"CASE WHEN size({words}) >= 3 THEN transform(sequence(0, size({words}) - 3), i -> xxhash64({words}[i], {words}[i + 1], {words}[i + 2])) ELSE array(0L) END"))
    step = step.withColumn(places, F.expr(f"CASE WHEN size(array_distinct({hashes})) < size({hashes}) THEN array_sort(transform({hashes}, (x, i) -> struct(x AS h, i AS i))) END"))
    again = f"array_sort(transform(filter({places}, (x, j) -> (j > 0 AND {places}[greatest(j - 1, 0)].h = x.h) OR (j < size({places}) - 1 AND {places}[least(j + 1, size({places}) - 1)].h = x.h)), x -> x.i))"
    covered = F.expr(f"CASE WHEN {places} IS NULL THEN 0L ELSE aggregate({again}, struct(-3 AS last, 0L AS n), (a, p) -> struct(p AS last, a.n + least(3, p - a.last) AS n), a -> a.n) END")
    counts = [
        F.size(words), without(SPACE), n - without(r"[#*$%&|<>]+"), F.size(lines), F.size(lines) - F.size(F.array_distinct(lines)), covered,
        F.size(F.array_distinct(words)), n - without(r"\p{L}+"), n - without(r"\p{Lu}+"), n - without("!+"), n - without(r"[|]+"), n - without("[.?]+"),
    ]
    told = F.struct(*[c.cast("long").alias(k) for k, c in zip(COUNTS, counts, strict=True)])
    return step.withColumn(name, told).drop(text, words, lines, hashes, places)


def votes(stats: DataFrame, name: str = "quality") -> DataFrame:
    """text_statistics()'s rows whose struct also has `votes`, a character per rule: 1 voted, 0 abstained."""
    counted = re.compile(rf"\b({'|'.join(COUNTS)})\b")
    marks = [F.when(F.expr(counted.sub(rf"`{name}`.\1", condition)), "1").otherwise("0") for _, _, condition in RULES]
    return stats.withColumn(name, F.col(name).withField("votes", F.concat(*marks)))


@dataclass(frozen=True)
class Fit:
    """prior: share of good documents. on_good, on_bad: how often each rule votes on either class. accuracy: the share of
    a rule's votes that are right. objective: the penalised log-likelihood after each round. posterior: by pattern of votes."""

    prior: float
    on_good: list[float]
    on_bad: list[float]
    accuracy: list[float]
    objective: list[float]
    posterior: dict[str, float]


def fit(patterns: dict[str, int], rounds: int = 200, smoothing: float = 0.02) -> Fit:
    """The model of the patterns of votes and how often each occurs, by expectation-maximisation.

    Model: a document is good or bad, and given that, each rule votes or abstains on its own; abstentions count as
    evidence like votes. Smoothing: every rate starts from pseudo-documents, `smoothing` of all documents (10 at least),
    on which a rule votes for its own class 30 times in a hundred and for the other once, and of which nine in ten are
    good; nothing else bounds a rate. The first round takes documents without a bad vote for good. The objective (the
    log-likelihood with the pseudo-documents') never falls; it stops when it no longer rises. No patterns: the smoothing alone.
    """
    total = sum(patterns.values())
    s = max(10.0, smoothing * total)
    start = [(0.3, 0.01) if is_good else (0.01, 0.3) for _, is_good, _ in RULES]
    bad = [i for i, (_, is_good, _) in enumerate(RULES) if not is_good]
    good = {p: 0.1 if any(p[i] == "1" for i in bad) else 0.95 for p in patterns}
    objective: list[float] = []
    log = lambda rate, vote: math.log(rate if vote else 1 - rate)
    for _ in range(max(1, rounds)):
        share = sum(good[p] * n for p, n in patterns.items())
        prior = (share + 0.9 * s) / (total + s)
        on_good, on_bad = [], []
        for i, (a, b) in enumerate(start):
            voted = sum(n for p, n in patterns.items() if p[i] == "1")
            voted_good = sum(good[p] * n for p, n in patterns.items() if p[i] == "1")
            on_good.append((voted_good + a * s) / (share + s))
            on_bad.append((voted - voted_good + b * s) / (total - share + s))
        value = s * (0.9 * math.log(prior) + 0.1 * math.log(1 - prior))
        value += s * sum(a * log(g, True) + (1 - a) * log(g, False) + b * log(x, True) + (1 - b) * log(x, False) for (a, b), g, x in zip(start, on_good, on_bad, strict=True))
        for p, n in patterns.items():
            up = math.log(prior) + sum(log(r, c == "1") for r, c in zip(on_good, p, strict=True))
            down = math.log(1 - prior) + sum(log(r, c == "1") for r, c in zip(on_bad, p, strict=True))
            most = max(up, down)
            both = most + math.log(math.exp(up - most) + math.exp(down - most))
            value += n * both
            good[p] = math.exp(up - both)
        objective.append(value)
        if len(objective) > 1 and value - objective[-2] <= 1e-10 * abs(value):
            break
    right = [(prior * g, (1 - prior) * b) if is_good else ((1 - prior) * b, prior * g) for (_, is_good, _), g, b in zip(RULES, on_good, on_bad, strict=True)]
    return Fit(prior, on_good, on_bad, [r / (r + w) for r, w in right], objective, good)


def judge(df: DataFrame, text_col: str = "text", threshold: float = 0.5, name: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """df's columns (those of `carry`, if given) and one more, the struct `name` ("quality", or the first free name with
    underscores after it): counts, votes, base_failed, posterior (probability of good) and kept.

    The statistics are computed once, into a table of the shared folder. Null, empty and very short texts fail the base
    rule. Repeated rows get equal verdicts, ties at the threshold are kept; on an empty table nothing is judged; other
    columns pass, whatever their names.
    """
    name = name or free_name(df, "quality")
    told = votes(text_statistics(df, text_col, name), name).select(*map(quoted, df.columns if carry is None else carry), quoted(name))
    voted = stored(told, f"{shared_dir(df.sparkSession)}/votes")
    return with_posterior(voted, fit(_patterns(voted, name)).posterior, threshold, name)


def _patterns(voted: DataFrame, name: str) -> dict[str, int]:
    """How often each pattern of votes occurs: a row per pattern, 2 ** len(RULES) at most."""
    return {r["v"]: r["n"] for r in voted.groupBy(F.col(f"{name}.votes").alias("v")).agg(F.count(F.lit(1)).alias("n")).collect()}


def with_posterior(voted: DataFrame, posterior: dict[str, float], threshold: float = 0.5, name: str = "quality") -> DataFrame:
    """votes()'s rows whose struct also has base_failed, posterior and kept; a pattern without posterior is not kept."""
    of, value = free_name(voted, f"{name}_of"), free_name(voted, f"{name}_value")
    known = voted.sparkSession.createDataFrame(sorted(posterior.items()), f"{of} string, {value} double")
    m = F.col(name)
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    told = m.withField("base_failed", failed).withField("posterior", F.col(value)).withField("kept", ~failed & (F.coalesce(F.col(value), F.lit(0.0)) >= threshold))
    return voted.join(F.broadcast(known), m["votes"] == F.col(of), "left").withColumn(name, told).drop(of, value)


def accepted(df: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of df whose documents the rules keep, with df's columns; nulls, ties, repeated rows, empty tables and
    clashing names as in judge(). The statistics are computed once for the model and once for the rows, so that no table
    of texts is left behind for the result to read."""
    name = free_name(df, "quality")
    voted = votes(text_statistics(df, text_col, name), name)
    # always true, but the optimizer does not know: moved into the filter, the statistics would be computed over and over
    marked = voted.withColumn(name, F.when(F.rand(0) >= 0, F.col(name)))
    return with_posterior(marked, fit(_patterns(voted, name)).posterior, threshold, name).filter(f"{quoted(name)}.kept").select(*map(quoted, df.columns))
