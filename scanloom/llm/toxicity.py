"""Toxicity by subword bags: embeddings of character n-grams, averaged over a window of words, go into a linear softmax.

A word is the bag of the n-grams of its letters and the blanks around it, so a misspelling that training never saw
shares most vectors of the word it stands for. A window's embedding is the mean of its words' n-gram vectors; a text is as
toxic as its worst window, so that a long text does not thin out a few words. Embeddings and softmax are fitted jointly in
numpy. The softmax is linear, so an n-gram's share of a class margin is one number: scoring sums these numbers, with the
n-grams of all positions of a slice of texts hashed at once, and costs time in proportion to the text.

Fitting takes a bounded sample of labelled rows (`sample` of either class, those of the smallest hashes of their ids) to
the driver; scoring is one pass over the texts with one number for each bucket broadcast.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import slices, type_of

BITS, SIZES, WINDOW = 18, (3, 4, 5, 6), 4
#: ASCII white space and these marks count as blanks.
GAPS = b"\t\n\v\f\r.,;:!?\"()[]{}<>|"
BLANKS = bytes.maketrans(GAPS, b" " * len(GAPS))
#: So many ways to misspell each word are tried in training.
VARIANTS = 4
MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)


@dataclass(frozen=True)
class Subwords:
    """embeddings: a row per bucket; softmax: a column per class (clean, toxic); bias: per class."""

    embeddings: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray

    def shares(self) -> np.ndarray:
        """What an n-gram of each bucket adds to the margin of toxic over clean."""
        return (self.embeddings @ (self.softmax[:, 1] - self.softmax[:, 0])).astype(np.float32)

    def margin_of_nothing(self) -> float:
        return float(self.bias[1] - self.bias[0])


def flat(text: str) -> bytes:
    """A text in lower case with blanks before and after every word."""
    return b" " + text.lower().encode("utf-8", "replace").translate(BLANKS) + b" "


def buckets(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size: where in the bytes an n-gram starts that lies in one word (blanks at its ends count), and its bucket."""
    a = np.frombuffer(data, np.uint8)
    blanks = np.cumsum(a == 32, dtype=np.int32)
    h = np.zeros(len(a), np.uint64)
    for n in range(1, max(SIZES) + 1):
        m = len(a) - n + 1
        if m <= 0:
            return
        h = h[:m] * STEP + a[n - 1 :].astype(np.uint64)
        if n in SIZES:
            inner = blanks[n - 2 : n - 2 + m] - blanks[:m]  # of the bytes between the first and the last
            at = np.flatnonzero(inner == 0)
            yield at, ((h[at] * MIX) >> np.uint64(64 - BITS)).astype(np.int32)


def words(data: bytes) -> np.ndarray:
    """Where the words of flat bytes start, at the blank before each."""
    blank = np.frombuffer(data, np.uint8) == 32
    return np.flatnonzero(blank[:-1] & ~blank[1:])


def windows(sums: np.ndarray, counts: np.ndarray, first: np.ndarray, n: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The mean share of every window of `width` words (of fewer in shorter texts), the text that it lies in, and its
    first word and the one after its last; `first` and `n` are the texts' first words and their numbers."""
    each = np.maximum(n - width + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(n)), each)
    start = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each) + first[text]
    stop = start + np.minimum(n[text], width)
    s, c = np.concatenate([[0.0], np.cumsum(sums, dtype=np.float64)]), np.concatenate([[0], np.cumsum(counts)])
    return (s[stop] - s[start]) / np.maximum(1, c[stop] - c[start]), text, start, stop


def margins(texts: list[str], shares: np.ndarray, nothing: float) -> np.ndarray:
    """The margin of each text's worst window; a text without words has that of nothing."""
    flats = [flat(t) for t in texts]
    data = b"".join(flats)
    ends = np.cumsum([len(f) for f in flats])
    at = words(data)
    total, count = np.zeros(len(data) + 1), np.zeros(len(data) + 1, np.int64)
    for where, bucket in buckets(data):
        total[where] += shares[bucket]  # a size has one n-gram at a place at most
        count[where] += 1
    edges = np.concatenate([at, [len(data)]])
    total, count = np.concatenate([[0.0], np.cumsum(total)]), np.concatenate([[0], np.cumsum(count)])
    sums, counts = total[edges[1:]] - total[edges[:-1]], count[edges[1:]] - count[edges[:-1]]
    first = np.searchsorted(at, ends - [len(f) for f in flats])
    n = np.diff(np.concatenate([first, [len(at)]]))
    z, text, _, _ = windows(sums, counts, first, n)
    out, full = np.zeros(len(texts)), np.flatnonzero(n)
    if len(full):
        out[full] = np.maximum.reduceat(z, np.searchsorted(text, full))
    return out + nothing


def misspelt(word: bytes, r: random.Random) -> bytes:
    """A word with one byte put in, left out, doubled, changed or swapped with the next."""
    i, other = r.randrange(len(word)), bytes([97 + r.randrange(26)])
    head, own, rest = word[:i], word[i : i + 1], word[i + 1 :]
    return r.choice([head + other + own + rest, head + rest, head + own + own + rest, head + other + rest, head + rest[:1] + own + rest[1:]]) or word


def fit(texts: list[str], labels: np.ndarray, rank: int = 8, rounds: int = 4, steps: int = 240, rate: float = 0.6, batch: int = 64, seed: int = 7) -> Subwords:
    """Cross-entropy by Adagrad in small batches, over each text and a copy of misspelt words.

    A text's margin is the soft maximum of its windows', which starts close to their mean and hardens round by round, so
    the shares first find the words that toxic texts have in common and then single out windows. Both classes weigh the
    same, whatever their sizes. Without texts of both classes, the smoothed share of toxic ones.
    """
    r = np.random.default_rng(seed)
    softmax, embeddings, bias = r.normal(0, rank**-0.5, (rank, 2)), r.normal(0, 1e-3, (1 << BITS, rank)), np.zeros(2)
    filled = np.array([i for i, t in enumerate(texts) if flat(t).strip()], np.int64)
    if len(set(labels[filled].tolist())) < 2:
        bias[1] = np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))
        return Subwords(np.zeros_like(embeddings, np.float32), softmax, bias)
    known: dict[bytes, int] = {}
    tokens: list[np.ndarray] = []
    odd: list[dict[bytes, int]] = [{} for _ in range(VARIANTS)]
    r_words = random.Random(seed)
    for i, t in enumerate(texts):
        own, other = flat(t).split(), odd[i % VARIANTS]
        tokens.append(np.array([known.setdefault(w, len(known)) for w in own], np.int64))
        for w in dict.fromkeys(w for w in own if w not in other):
            other[w] = known.setdefault(misspelt(w, r_words) if r_words.random() < 0.5 else w, len(known))
        tokens.append(np.array([other[w] for w in own], np.int64))
    data = b" " + b" ".join(known) + b" "
    at = words(data)
    found = [(np.searchsorted(at, where, "right") - 1, bucket) for where, bucket in buckets(data)]
    of, bucket = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
    bucket = bucket[np.argsort(of, kind="stable")]
    counts = np.bincount(of, minlength=len(known))
    first_gram = np.concatenate([[0], np.cumsum(counts)])
    y = np.repeat(labels.astype(np.float64), 2)
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    seen, seen_softmax, seen_bias = np.full(len(embeddings), 1e-6), np.full(softmax.shape, 1e-6), 1e-6
    filled = np.concatenate([2 * filled, 2 * filled + 1])
    for turn in range(rounds):
        hard = 4.0**turn / 2
        order = np.concatenate([r.permutation(filled) for _ in range(-(-steps * batch // (rounds * len(filled))))])  # so many steps, however few the rows are
        for k in range(0, len(order), batch):
            part = order[k : k + batch]
            n = np.array([len(tokens[i]) for i in part])
            first = np.cumsum(n) - n
            own, word = np.unique(np.concatenate([tokens[i] for i in part]), return_inverse=True)
            size = counts[own]
            gram = bucket[np.repeat(first_gram[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            to_word = np.repeat(np.arange(len(own)), size)
            u = softmax[:, 1] - softmax[:, 0]
            sums = np.bincount(to_word, (embeddings @ u)[gram], len(own))
            z, text, start, stop = windows(sums[word], size[word], first, n)
            top = np.maximum.reduceat(z, edge := np.searchsorted(text, np.arange(len(part))))
            e = np.exp(np.minimum(0, hard * (z - top[text])))
            mass = np.add.reduceat(e, edge)
            margin = top + np.log(mass / np.bincount(text)) / hard + bias[1] - bias[0]
            slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[part]) * weight[part] / len(part)
            # back through the soft maximum, the windows' means, the words, the n-grams
            many = np.concatenate([[0], np.cumsum(size[word])])
            back = slope[text] * e / mass[text] / np.maximum(1, many[stop] - many[start])
            lines = np.bincount(start, back, len(word) + 1) - np.bincount(stop, back, len(word) + 1)
            by_word = np.bincount(word, np.cumsum(lines)[:-1], len(own))
            by_gram = np.bincount(gram, by_word[to_word], 1 << BITS)
            cell = np.flatnonzero(by_gram)
            step_u = embeddings[cell].T @ by_gram[cell]
            g = by_gram[cell]
            seen[cell] += g * g
            embeddings[cell] -= (rate * g / np.sqrt(seen[cell]))[:, None] * u[None, :]
            g = np.stack([-step_u, step_u], axis=1)
            seen_softmax += g * g
            softmax -= 0.1 * rate * g / np.sqrt(seen_softmax)
            seen_bias += float(slope.sum()) ** 2
            bias += np.array([1, -1]) * 0.5 * rate * float(slope.sum()) / seen_bias**0.5
    return Subwords(embeddings.astype(np.float32), softmax, bias)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 1000) -> Subwords:
    """A classifier from at most `sample` labelled rows of docs of either class. Rows without a label, null ids and null
    labels teach nothing; null texts are empty; an id that docs or labels have several times teaches each pair of its rows;
    of ties at the sample's end the smallest id comes first; without rows of both classes it gives the smoothed share of
    toxic ones; other columns are ignored, whatever their names."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).filter("_id IS NOT NULL AND _label IS NOT NULL")
    of_class = [known.filter(F.col("_label") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample) for y in (0, 1)]
    marks = F.broadcast(of_class[0].unionByName(of_class[1]))  # 2 * sample rows at most
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(marks, F.col("id") == F.col("_id"))
    got = sorted((r["text"], r["_label"]) for r in rows.select("text", "_label").collect())  # the same classifier whatever the order of arrival
    return fit([t for t, _ in got], np.array([y for _, y in got], np.int64))


def score(df: DataFrame, model: Subwords, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score (0 to 1, higher: more likely toxic) of every row, by the worst window of its whole text. Null and
    empty texts, and those without letters or figures, have the score of no evidence; null ids, ties and repeated rows
    stay; an empty table gives an empty result; other columns are ignored, whatever their names. Batches are scored in
    slices of a few MB."""
    told = df.sparkSession.sparkContext.broadcast((model.shares(), model.margin_of_nothing()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares, nothing = told.value
        for b in (s for b in batches for s in slices(b, 2_000_000)):
            z = margins(b.column(1).to_pylist(), shares, nothing)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=[id_col, "score"])

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {type_of(df, id_col)}, score double")
