"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of the lengths of the corpus's most frequent pre-tokens, broadcast to every worker; tier two
are caches in each worker, filled by encoding what the table lacks. A text is cut at white space first, where every
pre-token of such a vocabulary ends; a chunk between is cut into pre-tokens once for as long as a cache holds it.

No pre-token of a text is shuffled. The table comes from bounded summaries, one blob for each task, which a tree of
merges brings down to one; the driver gets that one alone, so what it gets does not grow with the corpus.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .shared import id_and_text, shared_dir, slices, stored, type_of, worker_state

#: The separators at which str.split() cuts though a tokenizer may not.
ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Summaries that one task of the tree merges.
FAN = 16


def _tokenizer(path: str):
    state = worker_state("token_counts")
    if state.get("path") != path:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            t = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
        state.clear()
        state.update(path=path, tokenizer=t)
    return state["tokenizer"]


def _lengths(path: str, texts: list[str]) -> list[int]:
    t = _tokenizer(path)
    if path.endswith(".model"):
        return [len(x) for x in t.encode(texts, num_threads=1)] if texts else []
    return [len(x.ids) for x in t.encode_batch_fast(texts, add_special_tokens=False)]


def _special(path: str) -> list[str]:
    import json

    with open(path, encoding="utf-8") as f:
        return [x["content"] for x in json.load(f).get("added_tokens", [])]


def pre_tokens(path: str) -> Callable[[str], tuple[str, ...]]:
    """The function that cuts a chunk without white space into normalised pre-tokens, whose lengths add up to the chunk's.
    A chunk that holds a special string, or whose parts would change if they were normalised again, stays whole.

    Plain chunks are cut by the tokenizer's own pattern where that gives what the library gives (tried on all pairs of
    ASCII characters), runs of letters with or without a sign behind them by themselves where the pattern leaves such runs
    whole (tried on long ones), others by the library. A worker keeps the function."""
    import json

    import regex

    state = worker_state("token_counts")
    if state.get("splits") == path:
        return state["split"]
    t, special = _tokenizer(path), _special(path)
    normal = t.normalizer.normalize_str if t.normalizer else str

    def by_library(chunk: str) -> tuple[str, ...]:
        if any(s in chunk for s in special):
            return (chunk,)
        n = normal(chunk)
        parts = tuple(n[a:z] for _, (a, z) in t.pre_tokenizer.pre_tokenize_str(n))
        return parts if all(normal(x) == x for x in parts) else (chunk,)

    with open(path, encoding="utf-8") as f:
        steps = (json.load(f).get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    own = (steps[0].get("pattern") or {}).get("Regex")
    split = by_library
    if own and steps[0].get("behavior") == "Removed" and steps[0].get("invert"):
        found = regex.compile(own).findall
        plain = [chr(c) for c in range(33, 127)]
        if all(tuple(found(x.lower())) == by_library(x) for x in [*plain, *map("".join, product(plain, plain))]):
            run = "abcdefghijklmnopqrstuvwxyz" * 40
            whole = found(run) == [run]
            signs = {c for c in plain if not c.isalnum() and found(run + c) == [run, c]} if whole else set()

            # letters of Latin-1, if each is normalised here as there and none parts a run
            more = [c for c in map(chr, range(0xAA, 0x100)) if c.isalpha()]
            latin = whole and all(by_library(c) == (c.lower(),) and found("ab" + c.lower() + "ab") == ["ab" + c.lower() + "ab"] for c in more)

            def split(chunk: str) -> tuple[str, ...]:
                plain = chunk.isascii()
                if whole and (plain or latin and max(chunk) <= "\xff"):
                    if chunk.isalpha():
                        return (chunk.lower(),)
                    if chunk[-1] in signs and chunk[:-1].isalpha():
                        return chunk[:-1].lower(), chunk[-1]
                if not plain:
                    return by_library(chunk)
                return tuple(found(chunk.lower())) if not any(s in chunk for s in special) else by_library(chunk)

    state.update(splits=path, split=split)
    return split


def splits_at_space(path: str) -> bool:
    """True where white space always ends a token and leaves none itself, so that a text's count is the sum over its chunks.
    Tried out, with every kind of white space between letters, figures and signs of all kinds; byte-level and
    sentence-piece vocabularies keep it inside tokens, and patterns may cut elsewhere."""
    if path.endswith(".model"):
        return False
    t = _tokenizer(path)
    if t.pre_tokenizer is None:
        return False
    normal = t.normalizer.normalize_str if t.normalizer else str
    cut = lambda x: [p for p, _ in t.pre_tokenizer.pre_tokenize_str(normal(x))]
    spaces = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in ODD]
    around = ["a", "Zu", "7", ",", "'s", "é", "中", "_-"]
    return all(cut(x + s + y) == cut(x) + cut(y) and not cut(s) for s in [*spaces, "  ", " \n "] for x in around for y in around)


def _blob(counts: Counter, size: int) -> tuple[bytes, bytes]:
    keys, n = list(counts), np.fromiter(counts.values(), "<i8", len(counts))
    if len(keys) > size:
        top = np.argpartition(n, -size)[-size:]
        keys, n = [keys[i] for i in top.tolist()], n[top]
    return "\n".join(keys).encode(), n.tobytes()


def _cut(seen: Counter, size: int) -> Counter:
    """At most 4 * size counters: if there are more, the size-th largest count is taken off all (Misra-Gries)."""
    if len(seen) <= 4 * size:
        return seen
    cut = np.partition(np.fromiter(seen.values(), np.int64, len(seen)), -size)[-size]
    return Counter({k: v - cut for k, v in seen.items() if v > cut})


def frequent(rows: DataFrame, tokenizer: str, size: int) -> list[str]:
    """About the `size` most frequent pre-tokens of a text column: every task counts all its texts in a bounded summary,
    and summaries are merged by the FAN until one is left."""
    uri = shared_dir(rows.sparkSession)

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: Counter = Counter()
        for b in (s for b in batches for s in slices(b)):
            for text in b.column("text").to_pylist():
                chunks.update(text.split())
            chunks = _cut(chunks, size)
        pieces: Counter = Counter()
        split = pre_tokens(tokenizer)
        for chunk, n in chunks.items():
            for p in split(chunk):
                pieces[p] += n
        yield of([(TaskContext.get().partitionId(), *_blob(pieces, size))])

    def of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["task", "keys", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {}
        for b in batches:
            for task, keys, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held = seen.setdefault(task // FAN, Counter())
                held.update(dict(zip(keys.decode().split("\n") if keys else [], np.frombuffer(n, "<i8").tolist(), strict=True)))
                seen[task // FAN] = _cut(held, size)
        yield of([(task, *_blob(held, size)) for task, held in sorted(seen.items())])

    ddl = "task int, keys binary, n binary"
    level, k = stored(rows.select("text").mapInArrow(summary, ddl), f"{uri}/0"), 0
    while (last := level.agg(F.max("task")).first()[0]) is not None and last > 0:
        k += 1
        level = stored(level.repartitionById(last // FAN + 1, (F.col("task") / FAN).cast("int")).mapInArrow(merge, ddl), f"{uri}/{k}")
    rows_left = level.collect()  # one summary
    return rows_left[0]["keys"].decode().split("\n") if rows_left and rows_left[0]["keys"] else []


class Missing(dict):
    """Chunk lengths; an unknown chunk counts 0 for now and is noted. Of an earlier generation, what is asked for again stays."""

    at = 0

    def __init__(self, earlier: dict | None = None):
        super().__init__()
        self.earlier = earlier or {}
        self.noted: list[tuple[int, str]] = []

    def __missing__(self, chunk: str) -> int:
        if (n := self.earlier.get(chunk)) is not None:
            self[chunk] = n
            return n
        self.noted.append((self.at, chunk))
        return 0


def _prepare(path: str, key: str, told: tuple[bytes, np.ndarray]) -> None:
    """The worker's table and caches; they outlive a task."""
    _tokenizer(path)
    state = worker_state("token_counts")
    if state.get("key") != key:
        blob, known = told
        table = dict(zip(blob.decode().split("\n") if blob else [], known.tolist(), strict=True))
        state.update(key=key, table=table, pieces={}, chunks=Missing(), split=pre_tokens(path), splits=path)


def _chunk_lengths(path: str, chunks: list[str], cache_size: int) -> dict[str, int]:
    """Lengths of new chunks, from the table, the worker's cache, or by encoding the pre-tokens that neither has."""
    state = worker_state("token_counts")
    table, cache, split = state["table"], state["pieces"], state["split"]
    parts = {c: split(c) for c in chunks}
    new = list({p for x in parts.values() for p in x if p not in table and p not in cache})
    if len(cache) + len(new) > cache_size:
        cache.clear()
        new = list({p for x in parts.values() for p in x if p not in table})
    fresh = dict(zip(new, _lengths(path, new), strict=True))
    if len(fresh) <= cache_size:
        cache.update(fresh)
    of = lambda p: table[p] if p in table else fresh[p] if p in fresh else cache[p]
    return {c: sum(map(of, x)) for c, x in parts.items()}


def count_tokens(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, table_size: int = 65_536, cache_size: int = 300_000) -> DataFrame:
    """One row per input row: id_col, n_bytes, n_tokens, over_limit.

    tokenizer: path of a .json (tokenizers) or .model (sentencepiece) file. Null and empty texts have 0 bytes
    and 0 tokens; null ids, ties and repeated rows stay, one row each; an empty table gives an empty result;
    other columns are ignored, whatever their names. table_size bounds the broadcast (different pre-tokens), cache_size
    each of a worker's caches; neither changes a count. A batch is counted in slices of a few MB. Vocabularies whose
    tokens may cross white space are encoded text by text.
    """
    spark, rows = df.sparkSession, id_and_text(df, id_col, text_col)
    schema = f"`{id_col}` {type_of(df, id_col)}, n_bytes long, n_tokens long, over_limit boolean"
    whole = not splits_at_space(tokenizer)
    table = [] if whole else frequent(rows, tokenizer, table_size)
    lengths = np.array(_lengths(tokenizer, table), dtype=np.uint32)
    told = spark.sparkContext.broadcast(("\n".join(table).encode(), lengths))
    key = os.urandom(8).hex()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not whole:
            _prepare(tokenizer, key, told.value)
        for b in (s for b in batches for s in slices(b)):
            texts = b.column(1).to_pylist()
            n = _count_batch(tokenizer, texts, whole, cache_size)
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(count, schema)


def _count_batch(path: str, texts: list[str], whole: bool, cache_size: int) -> list[int]:
    if whole:
        return _lengths(path, texts)
    state = worker_state("token_counts")
    cache, out, odd = state["chunks"], [], []
    for i, text in enumerate(texts):
        if any(c in text for c in ODD):
            odd.append(i)
            out.append(0)
        else:
            cache.at = i
            out.append(sum(map(cache.__getitem__, text.split())))
    if cache.noted:
        known = _chunk_lengths(path, list(dict.fromkeys(c for _, c in cache.noted)), cache_size)
        for i, c in cache.noted:
            out[i] += known[c]
        cache.noted = []
        if len(cache) + len(known) > cache_size:
            state["chunks"] = cache = Missing(dict(cache))
        cache.update(known if len(known) <= cache_size else {})
    for i, n in zip(odd, _lengths(path, [texts[i] for i in odd]), strict=True):
        out[i] = n
    return out
