"""How the words of a reading differ from those of a reference text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

#: A step of an alignment costs so much if it changes a word, and one more if it puts one in or leaves one out: so the
#: cheapest alignment has the fewest steps, and of these the most changes of one word into another.
STEP = 1 << 32
COUNTS = ["words", "read", "same", "substituted", "inserted", "deleted"]


def aligned(ref: list, hyp: list) -> tuple[int, ...]:
    """COUNTS of the cheapest alignment of two lists of words, one row of costs at a time: memory in proportion to the
    longer list, time to the product of what is left without the words that both begin and end with."""
    n, m = len(ref), len(hyp)
    a = 0
    while a < min(n, m) and ref[a] == hyp[a]:
        a += 1
    z = 0
    while z < min(n, m) - a and ref[n - 1 - z] == hyp[m - 1 - z]:
        z += 1
    known: dict = {}
    left, right = (np.array([known.setdefault(w, len(known)) for w in x], np.int64) for x in (ref[a : n - z], hyp[a : m - z]))
    if len(left) > len(right):
        left, right = right, left  # costs are the same both ways
    one = STEP + 1
    along = one * np.arange(len(right) + 1, dtype=np.int64)
    row = along.copy()
    for w in left:
        now = row + one
        now[1:] = np.minimum(now[1:], row[:-1] + STEP * (right != w))
        row = np.minimum.accumulate(now - along) + along
    steps, gaps = divmod(int(row[-1]), STEP)
    inserted, deleted = (gaps + m - n) // 2, (gaps - m + n) // 2
    return n, m, n - deleted - (steps - gaps), steps - gaps, inserted, deleted


def alignment(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """pairs without their two texts, with COUNTS: words of the reference and of the reading, and how many are the same,
    substituted, inserted and deleted in an alignment of the fewest steps. Words are what stands between white space. A null
    text has no words; equal rows have equal counts; an empty table stays empty; other columns pass."""
    keep = [c for c in pairs.columns if c not in (ref, hyp)]
    schema = StructType([*[pairs.schema[c] for c in keep], *[StructField(c, LongType()) for c in COUNTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [aligned((r or "").split(), (h or "").split()) for r, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            counts = [pa.array([g[i] for g in got], pa.int64()) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([*b.columns[2:], *counts], names=[*keep, *COUNTS])

    return pairs.select(ref, hyp, *keep).mapInArrow(run, schema)


#: Pairs of texts are compared so many at a time.
PAIRS = 1000
_ONE, _TOP = np.uint64(1), np.uint64(63)


def edits(ref: list[str], hyp: list[str]) -> np.ndarray:
    """The edit distance of each pair of texts. The columns of the cost table are kept as their differences in bits, 64 rows to a
    number (Myers 1999, Hyyro 2003), and a step goes over one column of all pairs: time is n / 64 * m steps of numpy for the
    longest of them, so pairs of like lengths belong together."""
    n, m = (np.array([len(t) for t in x], np.int64) for x in (ref, hyp))
    out = np.maximum(n, m)
    live = np.flatnonzero((n > 0) & (m > 0))
    live = live[np.lexsort((n[live], -m[live]))]  # the longest first, so a step goes over the pairs that are not yet through
    if not len(live):
        return out
    n, m = n[live], m[live]
    left, right = (np.frombuffer("".join(x[i] for i in live).encode("utf-32-le", "surrogatepass"), np.uint32) for x in (ref, hyp))
    signs, left = np.unique(left, return_inverse=True)
    at = np.minimum(np.searchsorted(signs, right), len(signs) - 1)
    right = np.where(signs[at] == right, at, len(signs))  # a sign that no reference has is the last one
    blocks = (int(n.max()) + 63) // 64
    pair, place = np.repeat(np.arange(len(n)), n), np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
    same = np.zeros((len(n), len(signs) + 1, blocks), np.uint64)
    np.bitwise_or.at(same, (pair, left, place // 64), _ONE << (place % 64).astype(np.uint64))
    columns = np.full((len(n), int(m.max())), len(signs))
    columns[np.repeat(np.arange(len(n)), m), np.arange(len(right)) - np.repeat(np.cumsum(m) - m, m)] = right
    up, down = np.full((blocks, len(n)), ~np.uint64(0)), np.zeros((blocks, len(n)), np.uint64)
    last, bit, cost = (n - 1) // 64, ((n - 1) % 64).astype(np.uint64), n.copy()
    through = np.searchsorted(-m, -np.arange(int(m.max())), side="left")  # pairs with more columns than so many
    for j in range(int(m.max())):
        k = int(through[j])
        mask = same[np.arange(k), columns[:k, j]]
        plus, minus = np.ones(k, np.uint64), np.zeros(k, np.uint64)  # the differences that come in from above
        for b in range(blocks):
            eq, pv, mv = mask[:, b], up[b, :k], down[b, :k]
            xv = eq | mv
            eq = eq | minus
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            here = last[:k] == b
            cost[:k] += np.where(here, (ph >> bit[:k] & _ONE).astype(np.int64) - (mh >> bit[:k] & _ONE).astype(np.int64), 0)
            out_plus, out_minus = ph >> _TOP, mh >> _TOP
            ph, mh = ph << _ONE | plus, mh << _ONE | minus
            up[b, :k], down[b, :k] = mh | ~(xv | ph), ph & xv
            plus, minus = out_plus, out_minus
    out[live] = cost
    return out


def distances(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """edits() of two columns, null where a text is null: pairs of like lengths are compared together."""
    known = np.flatnonzero(np.logical_and(ref.is_valid().to_numpy(zero_copy_only=False), hyp.is_valid().to_numpy(zero_copy_only=False)))
    left, right = (c.take(pa.array(known)).to_pylist() for c in (ref, hyp))
    out, order = np.zeros(len(ref), np.int64), np.lexsort(([len(t) for t in right], [len(t) // 64 for t in left]))
    for k in range(0, len(order), PAIRS):
        some = order[k : k + PAIRS]
        out[known[some]] = edits([left[i] for i in some], [right[i] for i in some])
    missing = np.ones(len(ref), bool)
    missing[known] = False
    return pa.array(out, mask=missing)


def with_edits(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp", name: str = "edits") -> DataFrame:
    """pairs without their two texts, with the edit distance in characters of these; null where one is null. Other columns and
    rows pass; an empty table stays empty."""
    keep = [c for c in pairs.columns if c not in (ref, hyp)]
    schema = StructType([*[pairs.schema[c] for c in keep], StructField(name, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[2:], distances(b.column(0), b.column(1))], names=schema.names)

    return pairs.select(ref, hyp, *keep).mapInArrow(run, schema)
