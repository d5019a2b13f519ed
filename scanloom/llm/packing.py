"""Best-fit packing of token pieces into sequences.

Every bin has three capacities: tokens, documents and attention cost (the sum of squared piece lengths). A
piece's demand follows from its length alone, so pieces of one length are interchangeable: the driver packs
a histogram of lengths (at most `capacity` rows, however large the corpus) and answers with ranges of ranks.
Executors turn each piece's rank within its length into a bin by looking up its range.

Where the order of the pieces matters (a curriculum), windows of that order are packed one after the other, each with a
histogram of its own, so that a sequence holds pieces of one window and later sequences those of later ones.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import free_name, id_and_text, quoted, removed, shared_dir, slices, stored, type_of, worker_state


@dataclass(frozen=True)
class Capacity:
    """Limits of a sequence. By default documents and attention cost never bind: a piece has a token at least, and
    the squares of lengths that add up to `tokens` add up to its square at most."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    #: dot: the largest weighted dot product of demand and residual capacity; norm: the smallest weighted norm of what stays free.
    rule: str = "norm"
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)


class _Ids(dict):
    """Chunk to its ids as little-endian bytes, encoded with the space before it; `bare` has those without one."""

    def __init__(self):
        super().__init__()
        self.bare: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        first, *rest = chunk.split("\n")  # lines that meet inside a chunk; too varied to keep
        return self[first] + b"".join([self.bare["\n"] + self.bare[x] for x in rest])


def _encode(t, texts: list[str]) -> list[bytes]:
    return [array("I", x.ids).tobytes() for x in t.encode_batch_fast(texts, add_special_tokens=False)]


#: Fixed value: the split pattern of byte-level vocabularies.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks of printable ASCII and Latin letters, whose character classes no version of Unicode disputes.
LATIN = re.compile(r" ?[!-~\u00c0-\u024f]+").fullmatch


def _ranks(path: str):
    """A rank encoder over the same vocabulary file, or None unless the file's merges are in the order of their ids,
    its pre-tokenizer is the byte-level one and no normaliser precedes it: then both give the same ids."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if spec.get("normalizer") or (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex")) != ("ByteLevel", False, True) or model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    shown = [b for b in range(256) if chr(b).isprintable() and b not in (32, 160, 173)]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    vocab, special = model["vocab"], [x["content"] for x in spec.get("added_tokens", [])]
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if made != sorted(made) or any(set(k) - letters.keys() for k in vocab if k not in special):
        return None
    ranks = {bytes(letters[c] for c in k): v for k, v in vocab.items() if k not in special}
    return tiktoken.Encoding("chunks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}), special


def _encode_chunks(t, chunks: list[str]) -> list[bytes]:
    """Ids of chunks. Plain ones go in bulk, with line feeds between them, tokens of their own at which the ids part."""
    ranks, special = worker_state("packing")["ranks"] or (None, [])
    feed = t.encode("\n", add_special_tokens=False).ids
    plain = [i for i, c in enumerate(chunks) if LATIN(c) and not any(s in c for s in special)] if ranks and len(feed) == 1 else []
    out: list[bytes | None] = [None] * len(chunks)
    for at in range(0, len(plain), 5000):
        part = plain[at : at + 5000]
        ids = np.array(ranks.encode_ordinary("\n".join([chunks[i] for i in part])), dtype="<u4")
        ends = np.append(np.flatnonzero(ids == feed[0]), len(ids)).tolist()
        data, start = ids.tobytes(), 0
        for i, end in zip(part, ends, strict=True):
            out[i] = data[4 * start : 4 * end]
            start = end + 1
    rest = [i for i, x in enumerate(out) if x is None]
    for i, x in zip(rest, _encode(t, [chunks[i] for i in rest]), strict=True):
        out[i] = x
    return out


def _lines(chunk: str) -> list[str]:
    """The parts of a chunk around single line feeds, each of which is a token of its own; none if white space adjoins."""
    parts = chunk.split("\n")
    return parts if all(x and not x[0].isspace() and not x[-1].isspace() for x in parts) else []


def token_bytes(path: str, texts: list[str], cache_size: int) -> list[bytes]:
    """The ids of each text as the library gives them, little-endian. A byte-level pre-tokenizer ends a pre-token
    before each single space that stands between other characters, so chunks cut there are encoded once and cached."""
    from tokenizers import Tokenizer

    state = worker_state("packing")
    if state.get("path") != path:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        state.update(path=path, tokenizer=t, cache=_Ids(), ranks=_ranks(path))
    t, cache = state["tokenizer"], state["cache"]
    out: list[bytes] = []
    at = 0
    while at < len(texts):  # a few MB of text at a time bound what is held as chunks
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) < 4_000_000):
            size += len(texts[to])
            to += 1
        out += _encode_slice(t, cache, texts[at:to], cache_size)
        at = to
    return out


def _encode_slice(t, cache: _Ids, texts: list[str], cache_size: int) -> list[bytes]:
    split = [x.split(" ") for x in texts]
    used: set[str] = set()
    for p in split:
        used.update(p[1:])
    heads = {p[0] for p in split}
    if len(cache) + len(cache.bare) > cache_size:
        cache.clear()
        cache.bare.clear()
    need = used - cache.keys()
    unsafe = {c for c in need if not c or c[0].isspace()}
    need -= unsafe
    bare = heads | {"\n", ""}
    for c in [c for c in need if "\n" in c]:
        if parts := _lines(c):
            need.remove(c)
            if parts[0] not in cache:
                need.add(parts[0])
            bare.update(parts[1:])
    new = list(need)
    cache.update(zip(new, _encode_chunks(t, [" " + c for c in new]), strict=True))
    new = list(bare - cache.bare.keys())
    cache.bare.update(zip(new, _encode_chunks(t, new), strict=True))
    slow = [i for i, p in enumerate(split) if not unsafe.isdisjoint(p[1:])] if unsafe else []
    whole = dict(zip(slow, _encode(t, [texts[i] for i in slow]), strict=True))
    return [whole[i] if i in whole else cache.bare[p[0]] + b"".join(map(cache.__getitem__, p[1:])) for i, p in enumerate(split)]


def token_pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", tokens: int = 2048, end_id: int = 0, with_ids: bool = False, cache_size: int = 800_000, keep: list[str] | None = None) -> DataFrame:
    """Pieces of at most `tokens` ids: id_col, piece, start, length, ids_crc32, the columns of `keep` and, if asked for, ids
    (array<int>). Only documents longer than that are cut; their first piece takes the remainder. A document's ids end
    with end_id, so null and empty texts have one piece of one id. Null ids and repeated rows have their pieces like
    others, so a document that comes twice can only be told apart by a column that is kept; an empty table gives none;
    other columns are ignored, whatever their names. A batch is encoded in slices of a few MB, and the pieces of a very
    long text leave it in several batches."""
    keep = keep or []
    rows = id_and_text(df, id_col, text_col, keep)
    own = [id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    if clash := {c.lower() for c in keep} & {c.lower() for c in own}:
        raise ValueError(f"kept columns need other names than the pieces' own: {sorted(clash)}")
    kept = "".join(f", `{c}` {type_of(df, c)}" for c in keep)
    schema = f"`{id_col}` {type_of(df, id_col)}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + kept
    end = np.array([end_id], dtype="<u4").tobytes()

    def rows_of(b: pa.RecordBatch, cut: list[tuple], parts: list[bytes]) -> pa.RecordBatch:
        take = pa.array([c[0] for c in cut], pa.int64())
        cols = [b.column(0).take(take), *[pa.array([c[i] for c in cut], t) for i, t in ((1, pa.int32()), (2, pa.int64()), (3, pa.int64()), (4, pa.int64()))]]
        if with_ids:
            ends = np.cumsum([0, *[len(x) // 4 for x in parts]]).astype(np.int32)
            cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), "<i4"))))
        return pa.RecordBatch.from_arrays(cols + [b.column(2 + i).take(take) for i in range(len(keep))], names=[*own, *keep])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for b in batches for s in slices(b)):
            out: list[tuple] = []
            parts: list[bytes] = []
            held = 0
            for i, data in enumerate(token_bytes(tokenizer, b.column(1).to_pylist(), cache_size)):
                n, data = len(data) // 4 + 1, data + end
                at, k = 0, 0
                while at < n:
                    to = at + (n % tokens or tokens) if k == 0 else at + tokens
                    part = data[4 * at : 4 * to]
                    out.append((i, k, at, to - at, zlib.crc32(part)))
                    if with_ids:
                        parts.append(part)
                        held += len(part)
                    at, k = to, k + 1
                    if held > 4_000_000:
                        yield rows_of(b, out, parts)
                        out, parts, held = [], [], 0
            yield rows_of(b, out, parts)

    return rows.mapInArrow(cut, schema)


def pack_lengths(histogram: dict[int, int], cap: Capacity) -> list[tuple[int, int, int, int, int]]:
    """Vector best-fit decreasing over a histogram of lengths: (length, first rank, ranks, first bin, offset) ranges.

    Bins with equal contents form one group [first, first + n), so a step places one length on a whole group; the
    groups stay fewer than the lengths' ranges. Among the groups with room under all three capacities the rule
    picks one: the least weighted norm of the residual left, or the largest weighted dot product with it.
    """
    caps = np.array([cap.tokens, cap.documents, cap.attention], dtype=np.float64)
    weights = np.array(cap.weights) / caps**2
    free = np.zeros((0, 3))
    groups: list[list[int]] = []  # first bin, bins, tokens used
    out, bins = [], 0
    for length in sorted((k for k, v in histogram.items() if v), reverse=True):
        need = np.array([length, 1, length * length], dtype=np.float64)
        if length < 1 or (need > caps).any():
            raise ValueError(f"a piece of {length} tokens exceeds a bin's capacities")
        left, rank = histogram[length], 0
        while left:
            fits = np.flatnonzero((free >= need).all(axis=1))
            if len(fits):
                if cap.rule == "dot":
                    score = -(free[fits] * need) @ weights
                else:
                    score = ((free[fits] - need) ** 2) @ weights
                g = fits[np.argmin(score)]
                first, n, used = groups[g]
                take = min(n, left)
                out.append((length, rank, take, first, used))
                if take == n:
                    free[g] -= need
                    groups[g][2] += length
                else:
                    groups[g] = [first + take, n - take, used]
                    groups.append([first, take, used + length])
                    free = np.vstack([free, free[g] - need])
                rank, left = rank + take, left - take
                if free[g, 0] <= 0 and take == n:
                    free = np.delete(free, g, axis=0)
                    del groups[g]
                continue
            each = int((caps // need).min())
            take, placed = max(1, left // each), min(each, left)
            for k in range(placed):
                out.append((length, rank, take, bins, k * length))
                rank, left = rank + take, left - take
            groups.append([bins, take, length * placed])
            free = np.vstack([free, caps - placed * need])
            bins += take
    return out


def pack(pieces: DataFrame, id_col: str = "doc_id", cap: Capacity = Capacity(), order_col: str | None = None, windows: int = 8) -> DataFrame:
    """The pieces with sequence_id and offset: sequences under every capacity, gapless from 0.

    pieces needs id_col, piece and length; other columns pass, whatever their names but those two. With order_col
    (a number), as many windows of its order as asked for, of about as many pieces each, are packed for themselves, and
    sequence_id grows with the window. Ranks within a length come from one range shuffle by (window, length, id, piece),
    so a length that a third of all pieces share is spread over tasks. Null ids, ties and repeated rows are pieces like
    others (their order among themselves does not matter), a null order counts as the first; an empty table gives none.
    """
    spark, uri = pieces.sparkSession, shared_dir(pieces.sparkSession)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = stored(pieces, f"{uri}/pieces")  # ranges are drawn from a sample, which would else encode every text once more
    cuts = pieces.agg(F.percentile_approx(order_col, [k / windows for k in range(1, windows)], 100_000).alias("c")).first()["c"] if order_col and windows > 1 else None
    own = {c: free_name(pieces, f"_{c}") for c in ("window", "at", "part", "place")}
    window = sum((F.when(F.col(order_col) > c, 1).otherwise(0) for c in sorted(set(cuts or []))), F.lit(0))
    keys = [own["window"], "length", id_col, "piece", *[order_col] * bool(order_col)]
    dealt = pieces.withColumn(own["window"], window).repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn(own["at"], F.monotonically_increasing_id())
    dealt = stored(dealt.withColumn(own["part"], F.shiftright(own["at"], 33)), f"{uri}/dealt")
    removed(spark, f"{uri}/pieces")
    runs = dealt.groupBy(F.col(own["part"]).alias("part"), F.col(own["window"]).alias("window"), "length").agg(F.count(F.lit(1)).alias("n"), F.min(own["at"]).alias("first"))
    # one row per window, length and partition that holds some: partitions are ranges, so at most windows * lengths + partitions rows
    counted: dict[int, dict[int, int]] = {}
    base = []
    for r in sorted(runs.collect(), key=lambda r: (r["window"], r["length"], r["part"])):
        of = counted.setdefault(r["window"], {})
        base.append((r["part"], r["window"], r["length"], r["first"] - of.get(r["length"], 0)))
        of[r["length"]] = of.get(r["length"], 0) + r["n"]
    by_length: dict[tuple[int, int], list] = {}
    bins = 0
    for w, histogram in sorted(counted.items()):
        ranges = pack_lengths(histogram, cap)
        for length, rank, take, first, offset in ranges:
            by_length.setdefault((w, length), []).append((rank, take, bins + first, offset))
        bins += max(first + take for _, _, take, first, _ in ranges)
    # one row per window and length with its ranges in order of rank: sized by the lengths, not by the corpus
    ranges = "array<struct<rank:long,take:long,first:long,used:long>>"
    start = spark.createDataFrame([((p, w, length), zero) for p, w, length, zero in base], "_from struct<part:long,window:int,length:long>, _zero long")
    where = spark.createDataFrame([(k, v) for k, v in by_length.items()], f"_of struct<window:int,length:long>, _ranges {ranges}")
    key = lambda *c: F.struct(*[F.col(own.get(x, x)).alias(x) for x in c])
    told = dealt.select(F.struct(*[F.col(quoted(c)) for c in pieces.columns]).alias("row"), key("part", "window", "length").alias("from"), key("window", "length").alias("of"), F.col(own["at"]).alias("at"))
    out = told.join(F.broadcast(start), F.col("from") == F.col("_from")).join(F.broadcast(where), F.col("of") == F.col("_of")).withColumn("rank", F.col("at") - F.col("_zero"))
    out = out.withColumn("bin", F.expr("filter(_ranges, r -> r.rank <= rank and rank < r.rank + r.take)[0]"))
    return out.select("row.*", F.expr("bin.first + rank - bin.rank").alias("sequence_id"), F.expr("bin.used").alias("offset"))


def sequences(packed: DataFrame, id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """The sequences themselves, a row each, from packed pieces that carry `ids`: sequence_id, length, ids (array<int>),
    doc_ids and pieces (structs of id_col, the columns of `keep`, piece, start, length, ids_crc32 and offset), both in
    order. A sequence is bounded by its capacity, so nothing unbounded meets in a task; an empty table gives none."""
    told = ["offset", id_col, *(keep or []), "piece", "start", "length", "ids_crc32"]
    parts = F.array_sort(F.collect_list(F.struct(*told, "ids"))).alias("parts")
    out = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts)
    shown = F.transform("parts", lambda p: F.struct(*[p[c].alias(c) for c in [*told[1:], "offset"]]))
    return out.select("sequence_id", "length", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"), F.transform("parts", lambda p: p[id_col]).alias("doc_ids"), shown.alias("pieces"))
