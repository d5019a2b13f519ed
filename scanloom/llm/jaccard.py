"""Size-aware heavy-light join of documents by the Jaccard similarity of their word n-gram sets.

1. One pass over the texts sends every n-gram's hash, in sorted blobs of what a task has gathered, to the shard of its
   range; the shards keep those that two texts or more have, with their frequencies. An n-gram of one text cannot be
   shared, so a text with too many of them is linked to nothing.
2. A second pass gives the remaining sets their candidate keys. Light (small) sets enumerate the fixed-size subsets
   that a linked pair must share; heavy (large) sets stand in the inverted lists of their rarest n-grams, as many as
   a linked pair cannot miss. The boundary is the largest size up to which enumeration costs no more than scanning.
3. Sets that share keys form clusters (stars to a key's smallest set, never pairs). Each set goes once to its cluster, in
   which scanned inverted lists give exact overlaps. A cluster too large for a task is scanned block against block, or
   apart by the sets of each shared key, whichever ships fewer sets: near copies of one text share all their keys, long
   chains of them hardly any. Only the links of a spanning forest leave a task, with each set's number of links.
4. Connected components of those links are the result.

Equal sets are one set from the start, so copies are never paired.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from .shared import free_name, id_and_text, map_array, numbered, put_array, removed, shared_dir, slices, stored, texts_of, type_of, worker_state

#: So many n-grams a task gathers before it sends them to the shards.
HELD = 2_000_000
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """Word (bytes) to its 64-bit hash; bounded by clear()."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * M2
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text: ASCII capitals lowered, words between ASCII white space. A text
    of fewer words has its whole sequence as the only one; one without words has none."""
    known: WordHashes = worker_state("jaccard").setdefault("words", WordHashes())
    if len(known) > 300_000:
        known.clear()
    out = []
    for text in texts:
        words = text.lower().split()
        a = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(n, len(a))
        if not k:
            out.append(a)
            continue
        h = a[: len(a) - k + 1].copy() + np.uint64(k)
        for j in range(1, k):
            h = _mixed(h * M1 + a[j : len(a) - k + 1 + j])
        h.sort()
        out.append(h[np.append(True, h[1:] != h[:-1])])
    return out


def set_key(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _pack(a: np.ndarray) -> bytes:
    """Sorted integers as compressed gaps, byte planes apart."""
    gaps = np.diff(a, prepend=a[:1] * 0)
    gaps = gaps.astype(np.uint32) if not len(gaps) or gaps.max() < 1 << 32 else gaps
    return bytes([gaps.itemsize]) + zstandard.compress(gaps.view(np.uint8).reshape(-1, gaps.itemsize).T.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32 if data[0] == 4 else np.uint64).ravel(), dtype=np.uint64)


def _small(v: np.ndarray) -> bytes:
    """Compressed counts in the narrowest type that holds them all."""
    v = v.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if v.max(initial=0) <= np.iinfo(t).max))
    return bytes([v.itemsize]) + zstandard.compress(v.tobytes(), 1)


def _large(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data[1:]), f"<u{data[0]}")


def _first_pass(rows: DataFrame, n: int, shards: int, bits: int) -> DataFrame:
    """A row (id, size, key) per text, and rows (shard, grams, counts) of the n-gram hashes' upper bits."""

    kind = type_of(rows, "id")

    def batch(ids: pa.Array, sizes: list[int], keys: list[int], blobs: list[tuple]) -> pa.RecordBatch:
        n, m = len(ids), len(blobs)
        cols = [pa.concat_arrays([ids, pa.nulls(m, ids.type)]), pa.array(sizes + [0] * m, pa.int64()), pa.array(keys + [0] * m, pa.int64())]
        cols += [pa.array([None] * n + [x[i] for x in blobs], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))]
        return pa.RecordBatch.from_arrays(cols, names=["id", "size", "key", "shard", "grams", "counts"])

    def dealt(held: list[np.ndarray]) -> list[tuple]:
        grams, counts = np.unique(np.concatenate(held) >> np.uint64(64 - bits), return_counts=True)
        edges = [*np.searchsorted(grams, _bounds(shards, bits)).tolist(), len(grams)]
        return [(k, _pack(grams[a:z]), _small(counts[a:z])) for k, (a, z) in enumerate(itertools.pairwise(edges)) if z > a]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        ids = None
        for b in (s for b in batches for s in slices(b)):
            sets = shingle_sets(texts_of(b), n)
            keys = [set_key(s) for s in sets]
            held += [s for s, k in zip(sets, keys, strict=True) if not (k in seen or seen.add(k))]
            ids = b.column(0)
            full = sum(map(len, held)) > HELD
            yield batch(ids, [len(s) for s in sets], keys, dealt(held) if full else [])
            held = [] if full else held
        if held:
            yield batch(ids.slice(0, 0), [], [], dealt(held))

    return rows.mapInArrow(run, f"id {kind}, size long, key long, shard int, grams binary, counts binary")


def _bounds(shards: int, bits: int) -> np.ndarray:
    return np.array([-(-(k << bits) // shards) for k in range(shards)], dtype=np.uint64)


def _repeated(blobs: DataFrame, uri: str) -> list:
    """Write each shard's n-grams that occur in two sets or more, sorted, with their frequencies; (shard, n, total) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for k, g, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                held.setdefault(k, []).append((g, c))
        out = []
        while held:
            k, parts = held.popitem()
            grams = np.concatenate([_unpack(g) for g, _ in parts])
            counts = np.concatenate([_large(c) for _, c in parts])
            o = np.argsort(grams, kind="stable")
            grams, counts = grams[o], counts[o].astype(np.int64)
            first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
            total = np.add.reduceat(counts, first)
            keep = total > 1
            put_array(f"{uri}/grams-{k}.npy", grams[first][keep])
            put_array(f"{uri}/df-{k}.npy", np.minimum(total[keep], 2**32 - 1).astype(np.uint32))
            out.append((k, int(keep.sum()), int(total[keep].sum())))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["shard", "n", "total"])

    return blobs.mapInArrow(run, "shard int, n long, total long").collect()


def _needed(s: int, t: int) -> int:
    """Shared n-grams of linked sets of s and t: 100 * shared >= 75 * (s + t - shared)."""
    return -(-3 * (s + t) // 7)


def _prefix(s: int) -> int:
    return s - -(-3 * s // 4) + 1


def subset_cost(s: int) -> int:
    """Subsets that a set of s enumerates, in both roles."""
    return sum(math.comb(s, _needed(s, t)) for t in range(s, 4 * s // 3 + 1)) + sum(math.comb(s, _needed(t, s)) for t in range(-(-3 * s // 4), s))


def boundary(mean_list: float) -> int:
    """The largest size up to which enumerating subsets costs no more than scanning the lists of a prefix. Their number
    grows exponentially with the size, the prefix in proportion, so it ends."""
    s = 0
    while subset_cost(s + 1) <= _prefix(s + 1) * mean_list:
        s += 1
    return s


def candidate_keys(part: np.ndarray, df: np.ndarray, size: int, light: int) -> list[int]:
    """Keys of a set from its repeated n-grams: any linked pair has one in common."""
    keys: list[int] = []
    if size <= light:
        grams = part.tolist()
        for s, t in [(size, t) for t in range(size, min(light, 4 * size // 3) + 1)] + [(s, size) for s in range(-(-3 * size // 4), size)]:
            for c in itertools.combinations(grams, _needed(s, t)):
                keys.append(xxhash.xxh3_64_intdigest(np.array([s, t, *c], dtype=np.uint64).tobytes()) - (1 << 63))
    if size > light or 4 * size >= 3 * (light + 1):
        take = _prefix(size) - (size - len(part))
        keys += part[np.lexsort((part, df))[:take]].view(np.int64).tolist()
    return keys


def _look_up(uri: str, shards: int, bits: int, h: np.ndarray) -> np.ndarray:
    """Frequencies of n-gram hashes, 0 where they are not repeated."""
    state = worker_state("jaccard")
    if state.get("uri") != uri:
        state.update(uri=uri, maps=[(map_array(f"{uri}/grams-{k}.npy"), map_array(f"{uri}/df-{k}.npy")) for k in range(shards)])
    o = np.argsort(h)
    q = h[o] >> np.uint64(64 - bits)
    edges = [*np.searchsorted(q, _bounds(shards, bits)).tolist(), len(q)]
    out = np.zeros(len(h), np.uint32)
    for (grams, df), (a, z) in zip(state["maps"], itertools.pairwise(edges), strict=True):
        if z > a and len(grams):
            at = np.minimum(np.searchsorted(grams, q[a:z]), len(grams) - 1)
            out[o[a:z]] = np.where(grams[at] == q[a:z], df[at], 0)
    return out


def _second_pass(rows: DataFrame, n: int, uri: str, shards: int, bits: int, light: int) -> DataFrame:
    """(key, size, part, keys) of the sets that can be linked: part has the hashes of their repeated n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in (s for b in batches for s in slices(b)):
            sets = shingle_sets(texts_of(b), n)
            df = _look_up(uri, shards, bits, np.concatenate(sets)) if sets else np.zeros(0, np.uint32)
            out, at = [], 0
            for s in sets:
                d = df[at : at + len(s)]
                at += len(s)
                shared = int((d > 0).sum())
                if len(s) and 4 * shared >= 3 * len(s) and not ((k := set_key(s)) in seen or seen.add(k)):
                    part, d = s[d > 0], d[d > 0]
                    out.append((k, len(s), part.tobytes(), candidate_keys(part, d, len(s), light)))
            types = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["key", "size", "part", "keys"])

    return rows.mapInArrow(run, "key long, size long, part binary, keys array<long>")


def components(edges: DataFrame, uri: str) -> DataFrame:
    """(node, root) of every node of the edges (a, b): alternating large-star and small-star rounds, each written to
    the shared folder, until the edges are stars around their component's smallest node."""

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), f"{uri}/0")
    was, k = state(e), 0
    while was[0]:
        k += 1
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the smallest neighbours are tables of their own, so that a join reads them apart from their aggregate and the
        # edges of one node, however many, may be split over tasks
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{uri}/least-{k}")
        large = stored(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), f"{uri}/large-{k}")
        small = stored(large.groupBy("u").agg(F.min("v").alias("m")), f"{uri}/small-{k}")
        hung = large.join(small, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(hung.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), f"{uri}/{k}")
        removed(edges.sparkSession, *[f"{uri}/{x}" for x in (k - 1, f"least-{k}", f"large-{k}", f"small-{k}")])
        if (now := state(e)) == was:
            break
        was = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def scan(keys: list[int], sizes: np.ndarray, parts: list[np.ndarray], left: np.ndarray, right: np.ndarray, first: Callable[[int, int], bool] | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links of a spanning forest and the number of links of each set, between sets of left and sets of right, from the
    overlaps that scanning inverted lists gives. first: whether a link counts here, where others may find it, too."""
    lens = np.array([len(p) for p in parts])
    tokens, ids = np.unique(np.concatenate(parts), return_inverse=True)
    owner = np.repeat(np.arange(len(parts)), lens)
    o = np.argsort(ids, kind="stable")
    members, width = owner[o], np.bincount(ids, minlength=len(tokens))
    start = np.cumsum(width) - width
    root = list(range(len(parts)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    at = np.cumsum(lens) - lens
    links, degree = [], np.zeros(len(parts), np.int64)
    for x in np.flatnonzero(left):
        t = ids[at[x] : at[x] + lens[x]]
        w = width[t]
        flat = np.repeat(start[t] - (np.cumsum(w) - w), w) + np.arange(w.sum())
        overlap = np.bincount(members[flat], minlength=len(parts))
        y = np.flatnonzero(right & (7 * overlap >= 3 * (sizes + sizes[x])))
        y = y[(y > x) | ~left[y]]
        y = y[y != x]
        if first:
            y = y[[first(int(x), z) for z in y.tolist()]] if len(y) else y
        degree[x] += len(y)
        degree[y] += 1
        for z in y.tolist():
            a, b = find(int(x)), find(z)
            if a != b:
                root[a] = b
                links.append((keys[x], keys[z]))
    return links, degree


def _scan_clusters(members: DataFrame) -> DataFrame:
    """Rows sorted by (cluster, i, j) to links (a, b, null) and degrees (key, null, n). Rows with keys are those of the one
    key `cluster`; a link counts under the smallest key that its sets share."""

    def one(rows: list[tuple]) -> list[tuple]:
        at, i, j = rows[0][:3]
        block = np.array([r[3] for r in rows])
        own = [set(r[7]) for r in rows] if rows[0][7] is not None else None
        first = (lambda x, y: min(own[x] & own[y]) == at) if own else None
        links, degree = scan([r[4] for r in rows], np.array([r[5] for r in rows]), [np.frombuffer(r[6], np.uint64) for r in rows], block == i, block == j, first)
        return [(a, b, None) for a, b in links] + [(r[4], None, int(d)) for r, d in zip(rows, degree, strict=True) if d]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["a", "b", "n"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[-1][:3] != row[:3]:
                    out += one(held)
                    held = []
                held.append(row)
            yield batch(out)
            out = []
        yield batch(one(held) if held else [])

    return members.mapInArrow(run, "a long, b long, n long")


def _units(postings: DataFrame, hubs: DataFrame, clusters: DataFrame, block: int, uri: str) -> DataFrame:
    """(unit, listed, blocks, node): which sets are scanned together, in so many blocks. A unit is a cluster, or a key
    (listed) where the keys of a cluster of several blocks ship its sets fewer times."""
    blocks = F.ceil(F.col("n") / block).cast("int").alias("blocks")
    # tables of their own, apart from the joins that read them, so that a large cluster's rows may be split over tasks
    sizes = stored(clusters.groupBy("root").agg(F.count(F.lit(1)).alias("n")), f"{uri}/units/sizes")
    large = sizes.filter(F.col("n") > block)
    lists = hubs.join(clusters, F.col("hub") == F.col("node")).select("at", "root", "n").join(large.select("root"), "root", "left_semi")
    cost = F.col("n") * blocks
    apart = lists.groupBy("root").agg(F.sum(cost).alias("cost")).join(large, "root").filter(F.col("cost") < cost).select("root")
    apart = stored(apart, f"{uri}/units/apart")
    whole = clusters.join(sizes, "root").join(apart, "root", "left_anti").select(F.col("root").alias("unit"), F.lit(False).alias("listed"), blocks, "node")
    chosen = lists.join(apart, "root", "left_semi").select("at", "n")
    listed = postings.join(stored(chosen, f"{uri}/units/lists"), "at").select(F.col("at").alias("unit"), F.lit(True).alias("listed"), blocks, F.col("key").alias("node"))
    return stored(whole.unionByName(listed), f"{uri}/units/all")


def similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, block: int = 1024, filter_bits: int = 40) -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id (the smallest id reachable by links), n_copies (rows with
    an equal set) and n_links (different sets that it links to).

    Similarity 0.75 or more (100 * shared >= 75 * united) links. Null and empty texts have no n-grams, link with
    nothing and are their own component; ties and repeated rows have equal sets and share a component; rows of a null
    id stay, and an id that is null is never the smallest unless all are; other columns are ignored. n-grams
    and sets are compared by 64-bit hashes. filter_bits: of a hash, as many as the first filter compares; fewer let
    more sets through to the exact steps, so it should exceed log2 of the corpus's n-grams by some bits.
    """
    spark = df.sparkSession
    uri = shared_dir(spark)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = id_and_text(df, id_col, text_col)
    first = stored(_first_pass(rows, n, shards, filter_bits), f"{uri}/first")
    blobs = first.filter("shard IS NOT NULL").select("shard", "grams", "counts")
    told = _repeated(blobs.repartitionById(shards, "shard"), f"{uri}/grams")
    for k in set(range(shards)) - {r["shard"] for r in told}:  # ranges without any n-gram
        put_array(f"{uri}/grams/grams-{k}.npy", np.zeros(0, np.uint64))
        put_array(f"{uri}/grams/df-{k}.npy", np.zeros(0, np.uint32))
    docs = stored(first.filter("shard IS NULL").select("id", "size", "key"), f"{uri}/docs")
    removed(spark, f"{uri}/first")
    lists = sum(r["n"] for r in told)
    light = boundary(sum(r["total"] for r in told) / lists if lists else 1.0)
    # each set once, whichever tasks have met it
    sets = stored(_second_pass(rows, n, f"{uri}/grams", shards, filter_bits, light).dropDuplicates(["key"]), f"{uri}/sets")
    removed(spark, f"{uri}/grams")
    postings = sets.select("key", F.explode(F.array_distinct("keys")).alias("at"))
    hubs = postings.groupBy("at").agg(F.min("key").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    hubs = stored(hubs, f"{uri}/hubs")
    clusters = stored(components(postings.join(hubs, "at").select(F.col("key").alias("a"), F.col("hub").alias("b")), f"{uri}/near"), f"{uri}/clusters")
    units = _units(postings, hubs, clusters, block, uri)
    members = sets.join(units, sets["key"] == units["node"]).withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    members = members.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("keys", F.when(F.col("listed"), F.col("keys")))
    members = members.select(F.col("unit").alias("cluster"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "size", "part", "keys", "listed")
    members = members.repartition(shards, "cluster", "listed", "i", "j").sortWithinPartitions("listed", "cluster", "i", "j").drop("listed")
    linked = stored(_scan_clusters(members), f"{uri}/links")
    removed(spark, *[f"{uri}/{x}" for x in ("sets", "near", "clusters", "hubs", "units")])
    labels = components(linked.filter("b IS NOT NULL").select("a", "b"), f"{uri}/components")
    degrees = linked.filter("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n_links"))
    classes = docs.filter("size > 0").groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n_copies"))
    classes = classes.join(labels, F.col("key") == F.col("node"), "left").join(degrees, "key", "left").withColumn("root", F.coalesce("root", "key"))
    classes = stored(classes, f"{uri}/classes")
    smallest = stored(classes.groupBy("root").agg(F.min("least").alias("component")), f"{uri}/smallest")
    classes = classes.join(smallest, "root").select(F.col("key").alias("_k"), "component", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    some, none = docs.filter("size > 0"), docs.filter("size = 0")
    out = some.join(classes, F.col("key") == F.col("_k")).select("id", "size", "component", "n_copies", "n_links")
    out = out.unionByName(none.select("id", "size", F.col("id").alias("component"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links")))
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"), "n_copies", "n_links")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component, with df's columns: that of the smallest id (null after all others), among rows of one
    id the first. Rows are told apart by number and not by id, so repeated rows, equal ids and null ids leave one row of a
    component like any others. Null and empty texts link with nothing and stay; an empty table stays empty; other
    columns pass, whatever their names."""
    df = numbered(df, row := free_name(df, "row"))
    own = F.struct(F.col(id_col).isNull().alias("unknown"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    found = similar(df.select(own.alias("own"), F.col(text_col).alias("text")), "own", "text", **options)
    kept = found.filter(F.col("own") == F.col("component_id")).select(F.col("own.row").alias(row))
    return df.join(kept, row, "left_semi").drop(row)
