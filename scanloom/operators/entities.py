"""Names of a given table found in texts: the longest phrase from the left, by a trie over token hashes.

Names and texts are sequences of tokens (runs of letters and figures, case folded). A node of the trie is the hash of a
prefix of some name; it knows whether longer names go on from it and which name ends there. Each token of a text is a
possible start, and what is left takes one more token at each depth. A trie of up to TOLD characters goes to the tasks, which
look up all tokens of many texts at once; nothing is exchanged for it. A larger one is a table that starts join by node, where
only those still alive travel, each with as many tokens as the longest name has. Hashes find candidates there, equal tokens
decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..sources.files import kept, workspace


def tokens(text: Column, fold: bool = True) -> Column:
    """Runs of letters and figures in their order; null for a null text."""
    return F.regexp_extract_all(F.lower(text) if fold else text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def trie(names: DataFrame, name_col: str = "name", fold: bool = True, uri: str | None = None) -> DataFrame:
    """(depth, node, goes_on, name, phrase): a row per prefix of a name. name and phrase (its tokens) are null where none
    ends; of names with the same tokens the first in order of code points stands. Null names and those without tokens are
    none; repeated ones are one. Written as a table, so that Spark knows its size."""
    ws = names.select(F.col(name_col).alias("name"), tokens(F.col(name_col), fold).alias("phrase")).filter(F.size("phrase") > 0)
    ws = ws.groupBy("phrase").agg(F.min("name").alias("name"))
    prefixes = ws.select("name", "phrase", F.explode(F.sequence(F.lit(1), F.size("phrase"))).alias("depth"))
    prefixes = prefixes.withColumn("node", _node("phrase", F.col("depth"))).withColumn("ends", F.when(F.col("depth") == F.size("phrase"), F.struct("phrase", "name")))
    # one hash may stand for several phrases; the array keeps them all
    nodes = prefixes.groupBy("depth", "node").agg(F.max(F.col("depth") < F.size("phrase")).alias("goes_on"), F.array_sort(F.collect_list("ends")).alias("ends"))
    return kept(nodes, uri or f"{workspace(names.sparkSession)}/trie")


def _node(words: Column | str, depth: Column) -> Column:
    return F.xxhash64(F.slice(words, F.lit(1), depth))


#: First tokens are told apart by their hash in so many slots: what is broadcast has no more rows, whatever the table.
SLOTS = 1 << 18


def opening(at: DataFrame, nodes: DataFrame) -> DataFrame:
    """The starts whose first token has the slot of a name's. The others open no name, and a word that most texts have and no
    name begins with would bring its starts into one task of the join. What passes by a shared slot meets no node later on."""
    slots = nodes.filter("depth = 1").select(F.pmod("node", F.lit(SLOTS)).alias("_slot")).distinct()
    return at.join(F.broadcast(slots), F.pmod(_node("ahead", F.lit(1)), F.lit(SLOTS)) == F.col("_slot"), "left_semi")


#: Names of so many characters in all go to the tasks whole; more are joined.
TOLD = 1 << 24


class _Told:
    """A trie as arrays: tokens by number, from a node and a token the next node, and the name that ends in a node (-1: none)."""

    def __init__(self, phrases: list[list[str]], names: list[str]):
        number, steps, self.ends = {}, {}, [-1]
        for k, phrase in enumerate(phrases):
            node = 0
            for w in phrase:
                step = (node, number.setdefault(w, len(number)))
                if step not in steps:
                    steps[step] = len(self.ends)
                    self.ends.append(-1)
                node = steps[step]
            self.ends[node] = k
        self.words, self.names, self.ends = pa.array(number, pa.string()), pa.array(names, pa.string()), np.array(self.ends)
        codes = np.array([a * len(number) + w for a, w in steps], np.int64)
        order = np.argsort(codes)
        self.codes, self.nodes = codes[order], np.array(list(steps.values()), np.int64)[order]

    def found(self, ws: pa.Array) -> tuple[np.ndarray, ...]:
        """text, pos, n and number of the name of each match in lists of tokens, in their order."""
        sizes = ws.value_lengths().fill_null(0).to_numpy()
        begins = np.r_[0, np.cumsum(sizes)]
        text = np.repeat(np.arange(len(sizes)), sizes)
        words = pc.fill_null(pc.index_in(ws.flatten(), self.words), -1).to_numpy()
        n, name = np.zeros(len(words), np.int64), np.full(len(words), -1)
        at, depth = np.flatnonzero(words >= 0) if len(self.codes) else np.zeros(0, np.int64), 0
        node = np.zeros(len(at), np.int64)
        while len(at):
            code = node * len(self.words) + words[at + depth]
            place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            alive = self.codes[place] == code
            at, node, depth = at[alive], self.nodes[place[alive]], depth + 1
            ended = self.ends[node] >= 0
            n[at[ended]], name[at[ended]] = depth, self.ends[node[ended]]
            on = at + depth < begins[text[at] + 1]
            at, node = at[on], node[on]
            on = words[at + depth] >= 0
            at, node = at[on], node[on]
        upto, kept_ones = 0, []
        starts = np.flatnonzero(n)
        for start, length in zip(starts.tolist(), n[starts].tolist(), strict=True):
            if start >= upto:
                kept_ones.append(start)
                upto = start + length
        got = np.array(kept_ones, np.int64)
        return text[got], got - begins[text[got]], n[got], name[got]


def _told(nodes: DataFrame) -> Callable[[], _Told] | None:
    """What gives the trie in a task, where it is not too large for one."""
    size = F.aggregate("ends", F.lit(0).cast("long"), lambda s, e: s + F.length(e["name"]) + F.length(F.array_join(e["phrase"], " ")))
    if (nodes.agg(F.sum(size)).first()[0] or 0) > TOLD:
        return None
    known = nodes.select(F.inline("ends")).toArrow()
    told = nodes.sparkSession.sparkContext.broadcast((known["phrase"].to_pylist(), known["name"].to_pylist()))
    return lambda: _Told(*told.value)


def matches(df: DataFrame, nodes: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: bool = True) -> DataFrame:
    """A row per match: id_col, pos (of its first token, from 0), n (tokens) and name. Matches do not overlap: of those that
    start first the longest stands, and the search goes on behind it. Null and empty texts have none; rows of one id are
    told apart by their text and equal rows have equal matches once; without names there are none."""
    if (told := _told(nodes)) is not None:
        return _matches_told(df, told, id_col, text_col, fold)
    most = nodes.agg(F.max("depth")).first()[0] or 0  # the longest name's tokens
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), tokens(F.col(text_col), fold).alias("ws"))
    at = rows.select("id", "mark", F.posexplode(F.expr(f"transform(ws, (w, i) -> slice(ws, i + 1, {max(most, 1)}))")).alias("pos", "ahead"))
    at = opening(at, nodes).withColumn("best", F.lit(None).cast("struct<n: int, name: string>")).withColumn("alive", F.lit(True))
    for depth in range(1, most + 1):
        here = nodes.filter(F.col("depth") == depth).select(F.col("node").alias("_node"), "goes_on", "ends")
        # a start that has ended has no node: a number of its own keeps such rows from meeting in one task
        key = F.when(F.col("alive") & (F.size("ahead") >= depth), _node("ahead", F.lit(depth))).otherwise(F.xxhash64("id", "mark", "pos"))
        at = at.withColumn("_key", key).join(here, F.col("_key") == F.col("_node"), "inner" if depth == 1 else "left")
        ended = F.get(F.filter(F.coalesce("ends", F.array()), lambda e: e["phrase"] == F.slice("ahead", 1, depth)), F.lit(0))["name"]
        best = F.when(F.col("alive") & ended.isNotNull(), F.struct(F.lit(depth).alias("n"), ended.alias("name"))).otherwise(F.col("best"))
        at = at.select("id", "mark", "pos", "ahead", best.alias("best"), (F.col("alive") & F.coalesce("goes_on", F.lit(False))).alias("alive"))
    found = at.filter("best IS NOT NULL").select("id", "mark", F.col("pos").cast("long").alias("pos"), F.col("best.n").cast("long").alias("n"), F.col("best.name").alias("name"))
    # a text's matches are folded from the left: they are fewer than its tokens
    listed = found.groupBy("id", "mark").agg(F.array_sort(F.collect_set(F.struct("pos", "n", "name"))).alias("ms"))
    kept_ones = F.expr("""aggregate(ms, named_struct('upto', 0L, 'got', cast(array() AS array<struct<pos: bigint, n: bigint, name: string>>)),
        (s, m) -> if(m.pos >= s.upto, named_struct('upto', m.pos + m.n, 'got', concat(s.got, array(m))), s), s -> s.got)""")
    return listed.select(F.col("id").alias(id_col), F.inline(kept_ones))


def _matches_told(df: DataFrame, told: Callable[[], _Told], id_col: str, text_col: str, fold: bool) -> DataFrame:
    """matches() by a trie that tasks have."""
    schema = StructType([StructField(id_col, df.schema[id_col].dataType), StructField("pos", LongType()), StructField("n", LongType()), StructField("name", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie_ = told()
        for b in batches:
            text, pos, n, name = trie_.found(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text)), pa.array(pos), pa.array(n), trie_.names.take(pa.array(name))], names=schema.names)

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).distinct()
    return rows.select("id", tokens(F.col("text"), fold).alias("ws")).mapInArrow(run, schema)


def names_in(df: DataFrame, nodes: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: bool = True) -> DataFrame:
    """id_col and names: the names in a text by the order of their places, repeats included; a row per id with a match."""
    found = matches(df, nodes, id_col, text_col, fold).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("ms"))
    return found.select(id_col, F.transform("ms", lambda m: m["name"]).alias("names"))


def with_organisations(pages: DataFrame, nodes: DataFrame, key: str = "path", fold: bool = True) -> DataFrame:
    """pages with `organizations`, the names found in their texts (empty where there is none), which rule_documents filters. A
    page's names are those of its own text, also where others have its key."""
    own = pages.drop("organizations")
    if (told := _told(nodes)) is not None:
        schema = StructType([*own.schema.fields, StructField("organizations", ArrayType(StringType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie_ = told()
            for b in batches:
                text, _, _, name = trie_.found(b.column(b.num_columns - 1))
                offsets = np.r_[0, np.cumsum(np.bincount(text, minlength=b.num_rows))]
                orgs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), trie_.names.take(pa.array(name)))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], orgs], names=schema.names)

        return own.withColumn("_ws", tokens(F.col("text"), fold)).mapInArrow(run, schema)
    # a text's hash stands for it, as in matches()
    rows = own.withColumn("_row", F.struct(F.col(key), F.xxhash64("text").alias("mark")))
    found = names_in(rows, nodes, "_row", "text", fold).select(F.col("_row").alias("_key"), F.col("names").alias("organizations"))
    return rows.join(found, rows["_row"].eqNullSafe(F.col("_key")), "left").drop("_key", "_row").withColumn("organizations", F.coalesce("organizations", F.array().cast("array<string>")))
