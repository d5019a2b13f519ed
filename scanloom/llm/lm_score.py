"""Perplexity under an interpolated modified Kneser-Ney n-gram model of the corpus itself.

Counting goes order by order. Tasks sum what their texts hold up to a memory bound and send sorted compressed blobs of
keys to shards; what one order's exchange wrote is gone before the next begins. The model is sorted arrays in the shared
folder, which workers map into memory and search, so a model may exceed memory:

- words: 64-bit hashes; a word's id is its place.
- pairs: hashes that are a bijection of (word id, word id), so that the pairs of a frequent word spread over all shards.
- n-grams of order three and more: place of the first n-1 words in the order below, then the last word's id. A shard has
  all that follows the contexts of the shard below, so the contexts' sums are made where their n-grams are.
- of the last two, the lower 32 bits in order and where each value of the upper ones begins; counts in a byte each, with
  a side table for larger ones.

Orders below the highest count how many words stand before an n-gram (how often it occurs, at the start of a text, where
nothing does). Every n-gram of every training text is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .jaccard import M2, _large, _pack, _small, _unpack
from .quality_fm import crc_mod
from .shared import map_array, put_array, shared_dir, slices, stored, texts_of, type_of, worker_state

M1 = 0x9E3779B97F4A7C15
#: A number for each byte, one for both cases of a letter, and whether it is white space.
BYTES = np.array([xxhash.xxh3_64_intdigest(bytes([b]).lower()) for b in range(256)], np.uint64)
IS_SPACE = np.array([bytes([b]).isspace() for b in range(256)])
#: The end of a text, which also stands before its first word.
END = xxhash.xxh3_64_intdigest(b"\n")


class Powers:
    """Powers of an odd number and of its inverse, as many as were asked for."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            for name, x in (("up", M1), ("down", pow(M1, -1, 1 << 64))):
                powers = np.full(n, x, np.uint64)
                powers[0] = 1
                setattr(cls, name, np.cumprod(powers))
        return cls.up, cls.down


def _hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first places of the words in bytes that end with white space: sums of each byte's number times a power
    of its place, all words at once."""
    space = IS_SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    edges = np.append(0, edge) if len(data) and not space[0] else edge
    start, end = edges[0::2], edges[1::2]
    up, down = Powers.of(len(data) + 1)
    sums = np.cumsum(BYTES[data] * up[: len(data)])
    h = sums[end - 1] - np.where(start > 0, sums[start - 1], np.uint64(0))
    h = h * down[start] + (end - start).astype(np.uint64) * M2
    h = (h ^ (h >> np.uint64(31))) * M2
    return h ^ (h >> np.uint64(29)), start


def token_hashes(texts: list[bytes], size: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words and its end, and the number of tokens of each text. Words are runs of
    anything but ASCII white space, ASCII capitals lowered."""
    data = b"\n".join([*texts, b""])
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    whole = np.frombuffer(data, np.uint8)
    parts, at = [], 0
    while at < len(data):  # a piece ends at white space; one without any is taken whole
        to = min(at + size, len(data))
        while to < len(data) and not IS_SPACE[whole[at:to]].any():
            to = min(to + size, len(data))
        if to < len(data):
            to = at + int(np.flatnonzero(IS_SPACE[whole[at:to]])[-1]) + 1
        h, start = _hashes(whole[at:to])
        parts.append((h, start + at))
        at = to
    h = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
    start = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
    words = np.diff(np.searchsorted(start, ends), prepend=0)
    out = np.full(len(h) + len(texts), END, np.uint64)
    out[np.arange(len(h)) + np.repeat(np.arange(len(texts)), words)] = h
    return out, words + 1


#: So many counts a task sums before it sends them.
HELD = 2_000_000
INVERSE = np.uint64(pow(int(M2), -1, 1 << 64))


def _mixed(x: np.ndarray, bits: int) -> np.ndarray:
    """A bijection of the numbers of so many bits that spreads neighbours apart."""
    mask, by = np.uint64((1 << bits) - 1), np.uint64((bits + 1) // 2)
    for _ in range(2):
        x = (x * M2) & mask
        x = x ^ (x >> by)
    return x


def _unmixed(x: np.ndarray, bits: int) -> np.ndarray:
    mask, by = np.uint64((1 << bits) - 1), np.uint64((bits + 1) // 2)
    for _ in range(2):
        x = ((x ^ (x >> by)) * INVERSE) & mask
    return x


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys with the sums of their counts."""
    keys = np.concatenate([p[0] for p in parts])
    o = np.argsort(keys)
    keys = keys[o]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    n = np.concatenate([p[1] for p in parts])[o].astype(np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


SENT = "shard int, kind int, keys binary, n binary"


def _record(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    return _record(rows, [pa.int32(), pa.int32(), pa.binary(), pa.binary()], ["shard", "kind", "keys", "n"])


def _dealt(kind: int, keys: np.ndarray, n: np.ndarray, cuts: np.ndarray) -> list[tuple]:
    """A blob for each shard of sorted keys; cuts are the shards' first keys."""
    edges = [*np.searchsorted(keys, cuts).tolist(), len(keys)]
    return [(k, kind, _pack(keys[a:z]), _small(n[a:z])) for k, (a, z) in enumerate(pairwise(edges)) if z > a]


def _counting(rows: DataFrame, keys_of: Callable[[list[bytes]], list[np.ndarray]], cuts: np.ndarray) -> DataFrame:
    """Blobs of the keys that keys_of finds in texts, one array for each kind, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        for b in (s for b in batches for s in slices(b)):
            found = [np.unique(k, return_counts=True) for k in keys_of(texts_of(b))]
            held = held or [[] for _ in found]
            for kind, x in enumerate(found):
                held[kind].append(x)
            if sum(len(k) for x in held for k, _ in x) > HELD:
                yield _blobs([r for kind, x in enumerate(held) for r in _dealt(kind, *_summed(x), cuts)])
                held = []
        if held:
            yield _blobs([r for kind, x in enumerate(held) for r in _dealt(kind, *_summed(x), cuts)])

    return rows.mapInArrow(run, SENT)


def _per_shard(sent: DataFrame, shards: int, keep: Callable[[int, dict], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str) -> DataFrame:
    """keep(shard, {kind: (keys, counts)}) where a shard's blobs are; every shard, those without any too, has a task of its own."""
    every = sent.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit(-1).alias("kind"), F.lit(b"").alias("keys"), F.lit(b"").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[int, list]] = {}
        for b in batches:
            for shard, kind, keys, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                of = held.setdefault(shard, {})
                if kind >= 0:
                    of.setdefault(kind, []).append((keys, n))
        while held:
            shard, kinds = held.popitem()
            yield keep(shard, {kind: _summed([(_unpack(k), _large(n)) for k, n in kinds.pop(kind)]) for kind in list(kinds)})

    return sent.unionByName(every).repartitionById(shards, "shard").mapInArrow(run, schema)


def hash_cuts(shards: int, bits: int = 64) -> np.ndarray:
    """The smallest hash of each shard."""
    return np.array([-(-(k << bits) // shards) for k in range(shards)], np.uint64)


def pair_bits(v: int) -> int:
    """Bits of a pair of word ids."""
    return max(2, (v * v).bit_length())


def _put_keys(uri: str, keys: np.ndarray) -> None:
    upper = keys >> np.uint64(32)
    put_array(f"{uri}-starts.npy", np.searchsorted(upper, np.arange(int(upper[-1]) + 2 if len(upper) else 1, dtype=np.uint64)).astype(np.uint64))
    put_array(f"{uri}.npy", keys.astype(np.uint32))


class Keys:
    """Sorted keys: the lower 32 bits in order, and where each value of the upper ones begins."""

    def __init__(self, uri: str):
        self.low, self.starts = map_array(f"{uri}.npy"), map_array(f"{uri}-starts.npy")

    def __len__(self) -> int:
        return len(self.low)

    def find(self, q: np.ndarray) -> np.ndarray:
        """Places of sorted keys, -1 for unknown ones."""
        out, upper = np.full(len(q), -1, np.int64), (q >> np.uint64(32)).astype(np.int64)
        low = q.astype(np.uint32)
        edges = [0, *(np.flatnonzero(upper[1:] != upper[:-1]) + 1).tolist(), len(q)]
        for a, z in pairwise(edges):
            if z > a and upper[a] < len(self.starts) - 1:
                first = int(self.starts[upper[a]])
                if len(own := self.low[first : int(self.starts[upper[a] + 1])]):
                    p = np.minimum(np.searchsorted(own, low[a:z]), len(own) - 1)
                    out[a:z] = np.where(own[p] == low[a:z], p + first, -1)
        return out

    def all(self) -> np.ndarray:
        upper = np.repeat(np.arange(len(self.starts) - 1, dtype=np.uint64), np.diff(self.starts.astype(np.int64)))
        return (upper << np.uint64(32)) + self.low


class Hashes:
    """Sorted hashes, whole."""

    def __init__(self, uri: str):
        self.own = map_array(f"{uri}.npy")

    def __len__(self) -> int:
        return len(self.own)

    def find(self, q: np.ndarray) -> np.ndarray:
        p = np.minimum(np.searchsorted(self.own, q), len(self.own) - 1)
        return np.where(self.own[p] == q, p, -1)


def _put_counts(uri: str, *columns: np.ndarray) -> None:
    c = np.stack(columns, axis=1)
    large = np.flatnonzero(c > 254)
    put_array(f"{uri}.npy", np.minimum(c, 255).astype(np.uint8))
    put_array(f"{uri}-at.npy", large.astype(np.uint64))
    put_array(f"{uri}-large.npy", c.ravel()[large].astype(np.uint64))


NONE = (np.zeros(0, np.uint64), np.zeros(0, np.int64))


class Counts:
    """Rows of counts of a byte each, 255 meaning: see the side table."""

    def __init__(self, uri: str):
        self.low, self.at, self.large = (map_array(f"{uri}{x}.npy") for x in ("", "-at", "-large"))

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        c = self.low[at].astype(np.int64)
        if len(more := np.flatnonzero(c == 255)):
            width = c.shape[1]
            c.ravel()[more] = self.large[np.searchsorted(self.at, (at[more // width] * width + more % width).astype(np.uint64))]
        return c


#: What a context has: the sum of the counts of what follows it, and of how many the count is 1, 2, or more.
CONTEXT = ("total", "once", "twice", "more")


def _context_sums(parents: np.ndarray, n: np.ndarray, size: int) -> list[np.ndarray]:
    """CONTEXT of `size` contexts from the contexts and counts of n-grams."""
    of = lambda some: np.bincount(parents[some], minlength=size)
    total = np.bincount(parents, weights=n, minlength=size).astype(np.int64)
    return [total, of(n == 1), of(n == 2), of(n > 2)]


def _seen(n: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(n, 5), minlength=6)[1:5].tolist()


class Tables:
    """The model's files, mapped. sizes[k - 1]: the numbers of n-grams of order k in the shards."""

    def __init__(self, uri: str, shards: int, sizes: list[list[int]]):
        self.uri, self.shards = uri, shards
        self.bases = [np.cumsum([0, *s]).astype(np.int64) for s in sizes]
        self.v = int(self.bases[0][-1])
        self.bits = pair_bits(self.v)
        self.keys = [[(Keys if k else Hashes)(f"{uri}/{k + 1}-{i}") if n else () for i, n in enumerate(s)] for k, s in enumerate(sizes)]
        self.files: dict[str, list] = {}

    def counts(self, order: int, name: str) -> list[Counts]:
        key = f"{order}-{name}"
        if key not in self.files:
            self.files[key] = [Counts(f"{self.uri}/{key}-{i}") if len(k) else None for i, k in enumerate(self.keys[order - 1])]
        return self.files[key]

    def cuts(self, order: int) -> np.ndarray:
        """The first key of each shard of an order."""
        if order < 3:
            return hash_cuts(self.shards, self.bits if order == 2 else 64)
        return self.bases[order - 2][:-1].astype(np.uint64) * np.uint64(self.v)

    def find(self, order: int, keys: np.ndarray, name: str = "", width: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Places of keys in an order, -1 for unknown ones, and their rows of the counts of that name."""
        h = _mixed(keys, self.bits) if order == 2 else keys
        o = np.argsort(h)
        q, cuts = h[o], self.cuts(order)
        at, told = np.full(len(q), -1, np.int64), np.zeros((len(q), width), np.int64)
        for i, (a, z) in enumerate(pairwise([*np.searchsorted(q, cuts).tolist(), len(q)])):
            if z > a and len(own := self.keys[order - 1][i]):
                p = own.find(q[a:z] - cuts[i] if order > 1 else q[a:z])
                hit = np.flatnonzero(p >= 0)
                at[a + hit] = p[hit] + self.bases[order - 1][i]
                if name:
                    told[a + hit] = self.counts(order, name)[i][p[hit]]
        out, out_told = np.empty_like(at), np.empty_like(told)
        out[o], out_told[o] = at, told
        return out, out_told

    def words(self, ids: np.ndarray) -> np.ndarray:
        """Rows (raw count, count, CONTEXT) of ascending word ids."""
        out = np.zeros((len(ids), 2 + len(CONTEXT)), np.int64)
        for i, (a, z) in enumerate(pairwise(np.searchsorted(ids, self.bases[0]).tolist())):
            if z > a:
                local = ids[a:z] - self.bases[0][i]
                out[a:z, :1] = self.counts(1, "raw")[i][local]
                out[a:z, 1:] = self.counts(1, "stats")[i][local]
        return out

    def tokens(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids (-1: unknown) of all tokens, each text's words and its end; each text's first token; each token's place in its text."""
        hashes, sizes = token_hashes(texts)
        distinct, back = np.unique(hashes, return_inverse=True)
        ids = self.find(1, distinct)[0][back]
        starts = np.cumsum(sizes) - sizes
        return ids, starts, np.arange(len(ids)) - np.repeat(starts, sizes)

    def end(self) -> int:
        return int(self.find(1, np.array([END], np.uint64))[0][0])

    def key(self, context: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return context.astype(np.uint64) * np.uint64(self.v) + ids.astype(np.uint64)


def _shifted(x: np.ndarray, by: int, within: np.ndarray, least: int, fill: int) -> np.ndarray:
    """x by tokens further on; fill where a token has not at least so many tokens of its text before it."""
    out = np.full_like(x, fill)
    out[by:] = x[: len(x) - by] if by < len(x) else x[:0]
    return np.where(within >= least, out, fill)


def _mapped(uri: str, shards: int, sizes: list[list[int]]) -> Tables:
    state = worker_state("lm_score")
    if state.get("key") != (uri, len(sizes)):
        state.clear()
        state.update(key=(uri, len(sizes)), tables=Tables(uri, shards, sizes))
    return state["tables"]


def _places(m: Tables, ids: np.ndarray, within: np.ndarray, order: int) -> np.ndarray:
    """The place in `order` of the n-gram that ends at each token, -1 where there is none."""
    at = _shifted(ids, 1, within, 1, m.end())
    for k in range(2, order + 1):
        known = np.flatnonzero((at >= 0) & (ids >= 0))
        found = np.full(len(ids), -1, np.int64)
        found[known] = m.find(k, m.key(at[known], ids[known]))[0]
        at = _shifted(found, 1, within, 1, -1) if k < order else found
    return at if order > 1 else ids


def discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 1, 2, and 3 or more, from the numbers of n-grams seen 1 to 4 times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else k * 0.5 for k in (1, 2, 3)]
    return np.array([0.0, *[min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d, strict=True)]])


class Model:
    """Discounts and totals beside the mapped arrays. seen: for each order, how many n-grams have counts of 1 to 4.
    kinds: words by the number of different words before them (1, 2, 3 or more). links: all different pairs."""

    def __init__(self, uri: str, shards: int, sizes: list[list[int]], tokens: int, seen: list[list[int]], kinds: list[int], links: int):
        self.uri, self.shards, self.sizes, self.tokens = uri, shards, sizes, tokens
        self.order = len(sizes)
        self.d = [discounts(n) for n in seen]
        self.links = max(1, links)
        self.spare = float(self.d[0][1:] @ np.array(kinds)) / self.links if links else 1.0

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, known tokens, unigram score and Kneser-Ney score (log10) of each text."""
        m = _mapped(self.uri, self.shards, self.sizes)
        ids, starts, within = m.tokens(texts)
        distinct, back = np.unique(ids, return_inverse=True)
        known = distinct >= 0
        of_word = np.zeros((len(distinct), 2 + len(CONTEXT)), np.int64)
        of_word[known] = m.words(distinct[known])
        count, kinds = of_word[:, 0], of_word[:, 1]
        p = (np.maximum(kinds - self.d[0][np.minimum(kinds, 3)], 0) / self.links + self.spare / (m.v + 1))[back]
        base = np.log10((count + 0.1) / (self.tokens + 0.1 * (m.v + 1)))[back]
        context = _shifted(ids, 1, within, 1, m.end())
        at = np.searchsorted(distinct, context)
        has = (context >= 0) & (distinct[np.minimum(at, len(distinct) - 1)] == context) if len(distinct) else context >= 0
        sums = np.where(has[:, None], of_word[np.minimum(at, len(distinct) - 1), 2:], 0) if len(distinct) else np.zeros((0, len(CONTEXT)), np.int64)
        for k in range(2, self.order + 1):
            d, some = self.d[k - 1], np.flatnonzero(sums[:, 0] > 0)
            p[some] *= (sums[some, 1:] @ d[1:]) / sums[some, 0]
            asked = some[ids[some] >= 0]
            found, told = m.find(k, m.key(context[asked], ids[asked]), *(("count", 1) if k == self.order else ("stats", 1 + len(CONTEXT))))
            hit = found >= 0
            c = told[hit, 0]
            p[asked[hit]] += (c - d[np.minimum(c, 3)]) / sums[asked[hit], 0]
            if k < self.order:
                places, after = np.full(len(ids), -1, np.int64), np.zeros((len(ids), len(CONTEXT)), np.int64)
                places[asked], after[asked] = found, told[:, 1:]
                context = _shifted(places, 1, within, 1, -1)
                sums = np.zeros_like(after)
                sums[1:] = after[:-1]
                sums[context < 0] = 0
        add = lambda x: np.add.reduceat(x, starts) if len(starts) else x[:0]
        return np.diff(np.append(starts, len(ids))), add((ids >= 0).astype(np.int64)), add(base), add(np.log10(p))


def build(train: DataFrame, order: int = 3) -> Model:
    """The model of a column of texts (id, text), of order two or more. An empty table gives a model that knows nothing.
    A shard's n-grams of one order are held by one task, so spark.sql.shuffle.partitions grows with the input."""
    if order < 2:
        raise ValueError("the order is two or more")
    spark = train.sparkSession
    uri, shards = shared_dir(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = hash_cuts(shards)

    def word_keys(texts: list[bytes]) -> list[np.ndarray]:
        return [token_hashes(texts)[0]]

    def keep_words(k: int, kinds: dict) -> pa.RecordBatch:
        h, n = kinds.get(0, NONE)
        put_array(f"{uri}/1-{k}.npy", h)
        _put_counts(f"{uri}/1-raw-{k}", n)
        return _record([(k, len(h), int(n.sum()))], [pa.int32(), pa.int64(), pa.int64()], ["shard", "size", "tokens"])

    words = {r["shard"]: r for r in _per_shard(_counting(train, word_keys, cuts), shards, keep_words, "shard int, size long, tokens long").collect()}
    sizes = [[words[k]["size"] if k in words else 0 for k in range(shards)]]
    v = sum(sizes[0])
    tokens = sum(r["tokens"] for r in words.values())
    bases, bits = np.cumsum([0, *sizes[0]]), pair_bits(v)
    pair_cuts = hash_cuts(shards, bits)
    seen: list[list[int]] = [[0] * 4 for _ in range(order)]

    def to_words(ids: np.ndarray, columns: list[np.ndarray], first: int) -> list[tuple]:
        """Blobs of sums for words, of kind `first` and up, to the words' shards."""
        out = []
        for c, n in enumerate(columns):
            some = np.flatnonzero(n)
            out += _dealt(first + c, ids[some].astype(np.uint64), n[some], bases[:-1].astype(np.uint64))
        return out

    def word_sums(parents: np.ndarray, n: np.ndarray) -> list[tuple]:
        """The contexts' sums of some pairs by their first word."""
        ids, back = np.unique(parents, return_inverse=True)
        return to_words(ids, _context_sums(back, n, len(ids)), 1)

    def pair_keys(texts: list[bytes]) -> list[np.ndarray]:
        m = _mapped(uri, shards, sizes)
        ids, _, within = m.tokens(texts)
        return [_mixed(m.key(_shifted(ids, 1, within, 1, m.end()), ids), bits)]

    def keep_pairs(k: int, kinds: dict) -> pa.RecordBatch:
        h, n = kinds.get(0, NONE)
        _put_keys(f"{uri}/2-{k}", h - pair_cuts[k])
        _put_counts(f"{uri}/2-{'count' if order == 2 else 'raw'}-{k}", n)
        keys = _unmixed(h, bits)
        after, kinds_before = np.unique(keys % np.uint64(max(1, v)), return_counts=True)
        out = to_words(after, [kinds_before], 0)
        if order == 2:
            out += word_sums((keys // np.uint64(max(1, v))).astype(np.int64), n)
        return _blobs([*out, (-1, k, np.array([len(h)], "<i8").tobytes(), np.array(_seen(n), "<i8").tobytes())])

    if v >= 1 << 32:
        raise ValueError("keys of pairs hold vocabularies below 2 ** 32")
    partial = [stored(_per_shard(_counting(train, pair_keys, pair_cuts), shards, keep_pairs, SENT), f"{uri}/partial-2")]

    def told(df: DataFrame, mark: int) -> tuple[list[int], list[int]]:
        """Sizes of an order's shards and how often its counts are 1 to 4: a row for each shard."""
        rows = sorted((r["kind"], *[np.frombuffer(r[c], "<i8") for c in ("keys", "n")]) for r in df.filter(f"shard = {mark}").collect())
        return [int(x[0]) for _, x, _ in rows], np.sum([x for _, _, x in rows], axis=0).tolist()

    size, seen[1] = told(partial[0], -1)
    sizes.append(size)
    links = sum(sizes[1])
    for k in range(3, order + 1):
        if sum(sizes[-1]) * max(1, v) >= 1 << 64:
            raise ValueError("keys hold contexts times words below 2 ** 64")
        partial.append(stored(_higher(train, uri, shards, [list(s) for s in sizes], k, k == order, word_sums if k == 3 else None), f"{uri}/partial-{k}"))
        size, seen[k - 1] = told(partial[-1], -1)
        seen[k - 2] = told(partial[-1], -2)[1]
        sizes.append(size)

    def keep_stats(k: int, kinds: dict) -> pa.RecordBatch:
        columns = [np.zeros(sizes[0][k], np.int64) for _ in range(1 + len(CONTEXT))]
        for c, (ids, n) in kinds.items():
            columns[c][ids.astype(np.int64) - bases[k]] = n
        _put_counts(f"{uri}/1-stats-{k}", *columns)
        before = columns[0]
        return _record([(k, *_seen(before), int((before > 2).sum()))], [pa.int32()] + [pa.int64()] * 5, ["shard", "a", "b", "c", "d", "more"])

    sums = partial[0] if order == 2 else partial[0].unionByName(partial[1])
    rows = _per_shard(sums.filter("shard >= 0"), shards, keep_stats, "shard int, a long, b long, c long, d long, more long").collect()
    seen[0] = [sum(r[i] for r in rows) for i in range(1, 5)]
    return Model(uri, shards, sizes, tokens, seen, [seen[0][0], seen[0][1], sum(r["more"] for r in rows)], links)


def _higher(train: DataFrame, uri: str, shards: int, sizes: list[list[int]], k: int, last: bool, word_sums: Callable | None) -> DataFrame:
    """Count order k: its n-grams go to their context's shard and, for the words before each n-gram of the order below, to
    that n-gram's. Rows: (-1, shard, size, seen) and (-2, shard, -, seen below), and the sums for words if word_sums is given."""
    v = max(1, sum(sizes[0]))
    cuts = np.cumsum([0, *sizes[k - 2]])[:-1].astype(np.uint64) * np.uint64(v)

    def keys_of(texts: list[bytes]) -> list[np.ndarray]:
        m = _mapped(uri, shards, sizes)
        ids, _, within = m.tokens(texts)
        below = _places(m, ids, within, k - 1)
        some = np.flatnonzero(within >= k - 2)
        context = _shifted(below, 1, within, 1, -1)[some]
        first = _shifted(ids, k - 1, within, k - 1, m.end())[some]
        return [m.key(context, ids[some]), m.key(below[some], first)]

    def keep(i: int, kinds: dict) -> pa.RecordBatch:
        m = _mapped(uri, shards, sizes)
        size, cut = sizes[k - 2][i], cuts[i]
        keys, n = kinds.pop(0, NONE)
        keys -= cut
        _put_keys(f"{uri}/{k}-{i}", keys)
        _put_counts(f"{uri}/{k}-{'count' if last else 'raw'}-{i}", n)
        out = [(-1, i, np.array([len(keys)], "<i8").tobytes(), np.array(_seen(n), "<i8").tobytes())]
        before = np.bincount(((kinds.pop(1, NONE)[0] - cut) // np.uint64(v)).astype(np.int64), minlength=size)
        # nothing stands before n-grams at the start of a text: they count as often as they occur
        adjusted = np.where(before > 0, before, m.counts(k - 1, "raw")[i][np.arange(size)][:, 0]) if size else before
        if last:
            _put_counts(f"{uri}/{k - 1}-stats-{i}", adjusted, *_context_sums((keys // np.uint64(v)).astype(np.int64), n, size))
        else:
            _put_counts(f"{uri}/{k - 1}-count-{i}", adjusted)
        out.append((-2, i, np.array([size], "<i8").tobytes(), np.array(_seen(adjusted), "<i8").tobytes()))
        own = m.keys[k - 2][i].all() if size else NONE[0]
        if word_sums:
            out += word_sums((_unmixed(own + m.cuts(2)[i], m.bits) // np.uint64(v)).astype(np.int64), adjusted)
        else:
            lower = sizes[k - 3][i]
            counted = m.counts(k - 2, "count")[i][np.arange(lower)][:, 0] if lower else NONE[1]
            _put_counts(f"{uri}/{k - 2}-stats-{i}", counted, *_context_sums((own // np.uint64(v)).astype(np.int64), adjusted, lower))
        return _blobs(out)

    return _per_shard(_counting(train, keys_of, cuts), shards, keep, SENT)


def perplexity(df: DataFrame, model: Model, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, n_known, base_score, score of every row. Null and empty texts have one token, their end; null ids,
    ties and repeated rows stay, a row each; an empty table gives an empty result; other columns are ignored. A batch is
    scored in slices of a few MB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for b in batches for s in slices(b)):
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x) for x in model.score(texts_of(b))]], names=[id_col, "n_tokens", "n_known", "base_score", "score"])

    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {type_of(df, id_col)}, n_tokens long, n_known long, base_score double, score double")


def held_out_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: int = 10, order: int = 3) -> DataFrame:
    """Every text's scores under the model of the texts whose crc32 of the id modulo `by` is not 0; a null id counts as an
    empty text. Nulls, empty texts, repeated rows and empty tables as in perplexity()."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    model = build(rows.filter(crc_mod("id", by) != 0), order)
    out = perplexity(rows, model)
    return out.select(F.col("id").alias(id_col), (crc_mod("id", by) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", F.expr("pow(10D, -score / n_tokens)").alias("perplexity"))
