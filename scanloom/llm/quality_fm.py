"""A quality classifier: a factorisation machine over hashed words, structure statistics and document metadata.

Metadata are columns that the caller names: each is a field whose value is hashed like a word, numbers by their magnitude
in half powers of two. A machine keeps the names, so that rows are scored with the columns it was fitted with.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairwise interactions
of low rank, in time linear in a document's distinct words by the sum-of-squares identity.

Fitting takes a bounded sample of labelled rows (`sample`, those of the smallest hashes of their ids) to the driver
as compact features; scoring is one pass over the texts with the weights broadcast (buckets * (rank + 1) floats).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType, StructField, StructType

from .shared import slices, type_of, worker_state

BUCKETS = 1 << 16
UPPER, LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
STATS = 17


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        b = self[word] = xxhash.xxh3_64_intdigest(word) % BUCKETS
        return b


@dataclass(frozen=True)
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    meta: tuple[str, ...] = ()


def fields(df: DataFrame, meta: Sequence[str]) -> Column:
    """A row's metadata as name=value texts; null ones are left out."""

    def value(c: str) -> Column:
        if not isinstance(df.schema[c].dataType, NumericType):
            return F.col(c).cast("string")
        return F.concat(F.when(F.col(c) < 0, "-").otherwise(""), F.floor(2 * F.log2(1 + F.abs(F.col(c).cast("double")))).cast("string"))

    return F.array_compact(F.array(*[F.concat(F.lit(f"{c}="), value(c)) for c in meta]).cast("array<string>"))


def features(text: bytes, meta: Sequence[str] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Indices (words' buckets, statistics, buckets of metadata) and values; words have norm 1, statistics lie in [0, 1]."""
    known: _Buckets = worker_state("quality_fm").setdefault("buckets", _Buckets())
    if len(known) > 300_000:
        known.clear()
    words = text.split()
    n, size = len(words), max(1, len(text))
    idx, count = np.unique(np.fromiter(map(known.__getitem__, words), np.int32, n), return_counts=True)
    x = 1 + np.log(count)
    x /= max(1e-9, float(np.sqrt((x * x).sum())))
    letters = len(text) - len(text.translate(None, LETTERS))
    capitals = len(text) - len(text.translate(None, UPPER))
    lines = [t for t in text.split(b"\n") if t.strip()]
    share = lambda a, b: min(1.0, a / max(1, b))
    symbols = sum(map(text.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    stats = [
        1.0, min(1.0, np.log1p(n) / 12), min(1.0, np.log1p(len(text)) / 16), share(size / max(1, n), 20), share(letters, size), share(capitals, letters), share(symbols, n), share(text.count(b"|"), n), share(text.count(b"!"), n),
        share(text.count(b"."), n), share(text.count(b","), n), share(len(text) - len(text.translate(None, b"0123456789")), size), share(len(idx), n), share(int(count.max()) if n else 0, n), share(len(lines) - len(set(lines)), len(lines)), share(len(lines), n), float(n < 50),
    ]
    of = [known[b" " + m.encode()] for m in meta]  # no word has a space
    return np.concatenate([idx, np.arange(BUCKETS, BUCKETS + STATS, dtype=np.int32), np.array(of, np.int32)]), np.concatenate([x, stats, np.ones(len(of))]).astype(np.float32)


def margin(m: Machine, idx: np.ndarray, x: np.ndarray) -> float:
    vx = m.factors[idx] * x[:, None]
    s = vx.sum(axis=0)
    return m.bias + float(m.linear[idx] @ x) + 0.5 * float((s * s).sum() - (vx * vx).sum())


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = 8, steps: int = 700, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Logistic loss by Adagrad in small batches. Without labels, or with one class alone, the smoothed share of label 1."""
    n, dim = len(rows), BUCKETS + STATS
    ones = float(labels.sum())
    bias = float(np.log((ones + 1) / (n - ones + 1)))
    rng = np.random.default_rng(seed)
    linear, factors = np.zeros(dim, np.float32), rng.normal(0, 0.01, (dim, rank)).astype(np.float32)
    if not n or ones in (0, n):
        return Machine(bias, linear, np.zeros((dim, rank), np.float32))
    seen = np.full((dim, rank + 1), 1e-2, np.float32)
    seen_bias = 1e-2
    for _ in range(-(-steps // -(-n // 128))):  # so many batches, however few the rows are
        order = rng.permutation(n)
        for at in range(0, n, 128):
            part = order[at : at + 128]
            lens = np.array([len(rows[i][0]) for i in part])
            idx, x = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
            first, of = np.cumsum(lens) - lens, np.repeat(np.arange(len(part)), lens)
            vx = factors[idx] * x[:, None]
            s = np.add.reduceat(vx, first, axis=0)
            z = bias + np.add.reduceat(linear[idx] * x, first) + 0.5 * ((s * s).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), first))
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) / len(part)).astype(np.float32)
            slopes = np.concatenate([(g[of] * x)[:, None], (g[of] * x)[:, None] * (s[of] - vx)], axis=1)
            o = np.argsort(idx, kind="stable")
            cells, starts = np.unique(idx[o], return_index=True)
            total = np.add.reduceat(slopes[o], starts, axis=0) + decay * np.concatenate([linear[cells, None], factors[cells]], axis=1)
            seen[cells] += total * total
            step = rate * total / np.sqrt(seen[cells])
            linear[cells] -= step[:, 0]
            factors[cells] -= step[:, 1:]
            seen_bias += float(g.sum()) ** 2
            bias -= rate * float(g.sum()) / seen_bias**0.5
    return Machine(bias, linear, factors)


def crc_mod(id_col: str, by: int) -> Column:
    """crc32 of an id's text modulo `by`; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % by


def _with_fields(df: DataFrame, id_col: str, text_col: str, meta: Sequence[str]) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), fields(df, meta).alias("fields"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 6000, meta: Sequence[str] = ()) -> Machine:
    """A machine from at most `sample` labelled rows of docs, with the columns `meta` as metadata. Rows without a label,
    null ids and labels that are null teach nothing; null texts are empty; an id that docs or labels have several times
    teaches each pair of its rows; of ties at the sample's end the smallest id and label come first; without a row, or
    with one class alone, the machine gives the smoothed share of label 1; other columns are ignored, whatever their names."""
    marks = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    marks = marks.orderBy(F.xxhash64("_id"), "_id", "_label").limit(sample)
    rows = _with_fields(docs, id_col, text_col, meta)
    texts = rows.join(F.broadcast(marks), F.col("id") == F.col("_id")).select("text", "_label", "fields")  # at most `sample` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(t, m) for t, m in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([i.astype("<i4").tobytes() for i, _ in got], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in got], pa.binary()), b.column(1)], names=["i", "x", "y"])

    rows = texts.mapInArrow(run, "i binary, x binary, y int").collect()
    rows.sort(key=lambda r: (bytes(r["i"]), bytes(r["x"]), r["y"]))  # the same machine whatever the order of arrival
    machine = fit([(np.frombuffer(r["i"], "<i4"), np.frombuffer(r["x"], "<f4")) for r in rows], np.array([r["y"] for r in rows], dtype=np.float32))
    return replace(machine, meta=tuple(meta))


def score(df: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score (0 to 1) of every row. Null and empty texts are scored by their statistics and metadata alone;
    null ids, ties and repeated rows stay; an empty table gives an empty result; columns that are not the machine's metadata
    are ignored. A batch is scored in slices of a few MB."""
    told = df.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = told.value
        for b in (s for b in batches for s in slices(b)):
            z = np.array([margin(m, *features(t, f)) for t, f in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True)], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=[id_col, "score"])

    return _with_fields(df, id_col, text_col, machine.meta).mapInArrow(run, f"`{id_col}` {type_of(df, id_col)}, score double")


def accepted(df: DataFrame, machine: Machine, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of df whose text scores at least the threshold, with df's columns, in one pass without a shuffle. Null texts
    are empty; null ids, ties at the threshold and repeated rows stay; an empty table stays empty; other columns pass,
    whatever their names. A batch is scored in slices of a few MB of text."""
    told, names = df.sparkSession.sparkContext.broadcast(machine), df.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, limit = told.value, np.log(threshold / (1 - threshold))
        for b in (s for b in batches for s in slices(b, of=at)):
            texts = b.column(at).cast(pa.binary()).to_pylist()
            found = b.column(len(names)).to_pylist()
            keep = pa.array([i for i, t in enumerate(texts) if margin(m, *features(t or b"", found[i])) >= limit], pa.int64())
            yield pa.RecordBatch.from_arrays([c.take(keep) for c in b.columns[: len(names)]], names=plain)  # a filter of batches would use threads, which a forked worker lacks

    # plain names on the way, as a name with a dot in it cannot pass
    plain = [f"c{i}" for i in range(len(names))]
    schema = StructType([StructField(c, f.dataType) for c, f in zip(plain, df.schema.fields, strict=True)])
    return df.select("*", fields(df, machine.meta)).toDF(*plain, "fields").mapInArrow(run, schema).toDF(*names)
