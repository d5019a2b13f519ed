"""Language identification by character trigrams: profiles counted in Spark, texts scored by the profile's weights.

A text is its letters in lower case, every run of anything else one blank, with a blank at both ends. A trigram's weight
for a language is its smoothed log-odds, log P(trigram | language) - log P(trigram), in millionths and rounded, so that sums
are whole numbers: the same whatever the order in which tasks add them. A text's score for a language is the sum of its
trigrams' weights, those that the profile lacks counting nothing; the language of the highest score is its language.

Tasks number a batch's trigrams as arrays, many texts at once, and add up before a row is made: a row per trigram and batch
for the profile, a row per text for the scores. Texts follow each other with a blank at either end, so a trigram that
reaches over the end of its text is one with two blanks side by side, which no text has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..sources.files import kept, workspace

N = 3
#: Weights are in these parts of a natural logarithm.
PARTS = 1_000_000
#: Characters that a task counts, or looks up, at once; a longer text is taken in several steps. Counts are a row per trigram
#: and step, so they take larger ones; what is looked up stays in a processor's caches.
COUNT_STEP, SUM_STEP = 1 << 21, 1 << 17
#: Trigrams of few letters are counted and looked up in a table with a place for each, of this many places at most; others by sorting.
PLACES = 1 << 22
#: A profile of this many numbers (32 MB) goes to the tasks whole; a larger one is joined.
TOLD = 1 << 22
_POINTS = 0x110000


@dataclass(frozen=True)
class Profile:
    """langs in order of code; table: gram, weights (a number per language, in that order)."""

    langs: tuple[str, ...]
    table: DataFrame


def letters(text: Column) -> Column:
    """Letters in lower case between single blanks, with a blank at both ends; one blank for a text without letters. a-z are
    named beside the class, which they are in, since they are told sooner."""
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), r"[^a-z\p{L}]+", " ")


def _slices(batch: pa.RecordBatch, step: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of `step` characters at most, or a row that has more; their code points and two blanks, and the texts' lengths."""
    texts = pc.fill_null(batch["text"], "")
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + step, "right")))
        points = np.frombuffer(("".join(texts.slice(at, to - at).to_pylist()) + "  ").encode("utf-32-le"), "<u4")
        yield batch.slice(at, to - at), points, sizes[at:to]
        at = to


def _counted(points: np.ndarray, owner: np.ndarray, owners: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Trigrams of code points, the owners of their first characters, and how often an owner has them."""
    seen = np.zeros(_POINTS, bool)
    seen[points] = True
    alphabet = np.flatnonzero(seen)
    place, a = np.zeros(_POINTS, np.int64), len(alphabet)
    place[alphabet] = np.arange(a)
    p = place[points]
    code = (p[:-2] * a + p[1:-1]) * a + p[2:]
    if a**3 * owners <= PLACES:
        table = np.bincount(code * owners + owner, minlength=1)
        key = np.flatnonzero(table)
        code, owner, n = key // owners, key % owners, table[key]
    else:
        kinds, code = np.unique(code, return_inverse=True)
        key, n = np.unique(code * owners + owner, return_counts=True)
        code, owner = kinds[key // owners], key % owners
    grams = alphabet[np.stack([code // a // a, code // a % a, code % a], 1)].astype("<u4")
    blank = grams == ord(" ")
    inside = ~((blank[:, 0] | blank[:, 2]) & blank[:, 1])
    return pa.array(np.ascontiguousarray(grams[inside]).view(f"<U{N}").ravel(), pa.string()), owner[inside], n[inside]


def _counts(by_value: bool, outer: bool, step: int = COUNT_STEP) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From key and text to key, gram and n: a row per trigram of what a step has of a key's value, or of each row's text.
    With `outer` a text without trigrams gives a row without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, points, sizes in _slices(batch, step):
                keys, numbers = rows["key"], np.arange(len(sizes))
                if by_value:
                    told = pc.dictionary_encode(keys, null_encoding="encode")
                    keys, numbers = told.dictionary, told.indices.to_numpy()
                owner = np.repeat(numbers.astype(np.int64), sizes)
                for at in range(0, len(owner), step):
                    grams, of, n = _counted(points[at : at + step + N - 1], owner[at : at + step], len(keys))
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(of)), grams, pa.array(n, pa.int64())], ["key", "gram", "n"])
                if outer and (none := np.flatnonzero(sizes < N)).size:
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(none)), pa.nulls(len(none), pa.string()), pa.array(np.zeros(len(none), np.int64))], ["key", "gram", "n"])

    return run


def _grams(df: DataFrame, by_value: bool, outer: bool) -> DataFrame:
    """key, gram and n of df's key and text."""
    rows = df.select("key", letters(F.col("text")).alias("text"))
    return rows.mapInArrow(_counts(by_value, outer), StructType([StructField("key", rows.schema["key"].dataType), StructField("gram", StringType()), StructField("n", LongType())]))


def profile(samples: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 2, smoothing: float = 0.5) -> Profile:
    """The profile of samples' languages over the trigrams that occur `least` times or more in them.

    Counts are summed by trigram inside tasks first, so what is exchanged is as large as the alphabets' trigrams and not as
    the texts; to the driver go the languages and one number for each. Rows without language or text teach nothing; repeated
    rows count as often as they occur; without rows there are no languages and no text is given one."""
    rows = samples.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("key"), F.col(text_col).alias("text"))
    langs = tuple(sorted(r[0] for r in rows.select("key").distinct().collect()))  # a row per language
    of = [f"n{i}" for i in range(len(langs))]
    sums = [F.coalesce(F.sum(F.when(F.col("key") == x, F.col("n"))), F.lit(0)).cast("long").alias(c) for x, c in zip(langs, of, strict=True)]
    counted = _grams(rows, True, False).groupBy("gram").agg(F.sum("n").alias("n"), *sums)
    counted = kept(counted.filter(F.col("n") >= least), f"{workspace(samples.sparkSession)}/counts")
    kinds, total, *sizes = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), *[F.coalesce(F.sum(c), F.lit(0)) for c in of]).first()
    rate = lambda n, size: F.log((F.col(n) + smoothing) / F.lit(max(size, 1) + smoothing * kinds))
    weights = F.array(*[F.round((rate(c, size) - rate("n", total)) * PARTS).cast("long") for c, size in zip(of, sizes, strict=True)]).cast("array<bigint>")
    # a table, so that Spark knows its size
    return Profile(langs, kept(counted.select("gram", weights.alias("weights")), f"{workspace(samples.sparkSession)}/profile"))


class _Weights:
    """A profile's weights by the number of a trigram's letters; place 0 is for letters and trigrams that it lacks."""

    def __init__(self, grams: list[str], weights: np.ndarray):
        points = np.frombuffer("".join(grams).encode("utf-32-le"), "<u4").reshape(-1, N)
        alphabet = np.unique(points)
        self.base = len(alphabet) + 1
        few = self.base**3 <= PLACES
        self.place = np.zeros(_POINTS, np.int32 if few else np.int64)
        self.place[alphabet] = np.arange(1, self.base)
        code = self._codes(self.place[points.T])
        order = np.argsort(code)
        self.codes, self.table = code[order], None
        if few:
            self.table = np.zeros(self.base**3, np.int32)
            self.table[self.codes] = np.arange(1, len(order) + 1)
        self.by_lang = [np.r_[0, w[order]] for w in weights]

    def _codes(self, p: tuple[np.ndarray, ...] | np.ndarray) -> np.ndarray:
        return (p[0] * self.base + p[1]) * self.base + p[2]

    def _ranks(self, points: np.ndarray) -> np.ndarray:
        p = self.place[points]
        code = self._codes((p[:-2], p[1:-1], p[2:]))
        if self.table is not None:
            return self.table[code]
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, at + 1, 0)

    def sums(self, points: np.ndarray, sizes: np.ndarray, step: int) -> np.ndarray:
        """The weights' sums, a row per text and a column per language. Only a text by itself has more than one step."""
        out, some = np.zeros((len(sizes), len(self.by_lang)), np.int64), np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[some]
        for at in range(0, int(sizes.sum()), step):
            ranks = self._ranks(points[at : at + step + N - 1])
            for k, w in enumerate(self.by_lang):
                out[some, k] += np.add.reduceat(w[ranks], starts)
        return out


def _told(df: DataFrame, p: Profile, step: int = SUM_STEP) -> DataFrame:
    """key, grams and scores, a row for each of df's."""
    known, langs = p.table.toArrow(), len(p.langs)
    weights = known["weights"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, langs).T if langs else np.zeros((0, len(known)), np.int64)
    told = df.sparkSession.sparkContext.broadcast((known["gram"].to_pylist(), weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = _Weights(*told.value)
        for batch in batches:
            for rows, points, sizes in _slices(batch, step):
                sums = w.sums(points, sizes, step)
                scores = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * langs, pa.int32()), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([rows["key"], pa.array(np.maximum(sizes - N + 1, 0)), scores], ["key", "grams", "scores"])

    rows = df.select("key", letters(F.col("text")).alias("text"))
    return rows.mapInArrow(run, StructType([StructField("key", rows.schema["key"].dataType), StructField("grams", LongType()), StructField("scores", ArrayType(LongType()))]))


def scores(df: DataFrame, p: Profile, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, grams (the text's trigrams), scores (in the order of p.langs) and lang: a row per id. Tasks sum a text's weights
    before anything is exchanged, where the profile is small enough to go to each; else a text's different trigrams are
    dealt by trigram and joined. Of equal scores the first language counts. Rows of one id are one text (null ids, too);
    a text without trigrams has none, zero scores and no language; an empty table gives none; other columns are ignored."""
    rows = df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    if p.table.count() * (len(p.langs) + 1) <= TOLD:
        told, times = _told(rows, p), lambda i: F.get("scores", F.lit(i))
    else:
        told = _grams(rows, False, True).withColumnRenamed("n", "grams").join(p.table, "gram", "left")
        times = lambda i: F.get("weights", F.lit(i)) * F.col("grams")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    told = told.groupBy("key").agg(total("grams").alias("grams"), F.array(*[total(times(i)) for i in range(len(p.langs))]).cast("array<bigint>").alias("scores"))
    best = F.get(F.array(*map(F.lit, p.langs)).cast("array<string>"), (F.array_position("scores", F.array_max("scores")) - 1).cast("int"))
    return told.select(F.col("key").alias(id_col), "grams", "scores", F.when(F.col("grams") > 0, best).alias("lang"))


def with_language(pages: DataFrame, p: Profile, key: str = "path") -> DataFrame:
    """pages whose null lang is the language of their text, where it has letters; other columns and rows stay as they are."""
    found = scores(pages.filter("lang IS NULL"), p, key).select(F.col(key).alias("_key"), F.col("lang").alias("_lang"))
    names = [F.coalesce("lang", "_lang").alias("lang") if c == "lang" else F.col(c) for c in pages.columns]
    return pages.join(found, F.col(key).eqNullSafe(F.col("_key")), "left").select(*names)
