"""Whole results against brute-force versions: each pipeline stage, Kneser-Ney probabilities, words taken, edited likeness."""

import itertools
import math
import re
import unicodedata
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.llm import fingerprints, lm_score, mixing, quality_fm, quality_rules
from scanloom.llm.shared import with_place

from .test_operators import ROWS, _lower, _split

public_tokenizers = pytest.importorskip("public_tokenizers")


def _pattern(text):
    """A text's votes and whether it fails the base rule."""
    w, lines = _split(text), [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    of = lambda good: sum(map(good, text or ""))
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(three)
    q = {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": of(lambda c: c in "#*$%&|<>"), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len({i + j for i, x in enumerate(three) if often[x] > 1 for j in range(3)}),
        "n_kinds": len(set(w)), "n_letters": of(lambda c: unicodedata.category(c)[0] == "L"), "n_capitals": of(lambda c: unicodedata.category(c) == "Lu"), "n_exclaims": of(lambda c: c == "!"), "n_bars": of(lambda c: c == "|"), "n_stops": of(lambda c: c in ".?"),
    }
    vote = ""
    for _, _, sql in quality_rules.RULES:
        plain = re.sub(r"(\w+) BETWEEN (.+) AND (.+)", r"\2 <= \1 <= \3", sql).replace(" AND ", " and ")
        vote += str(int(eval(re.sub(r"\d+\.\d+", lambda m: f"Fraction('{m[0]}')", plain), {"Fraction": Fraction, **q})))
    return vote, len(w) < 50 or 100 * q["n_repeat_words"] > 50 * len(w)


def _margin(m, idx, x):
    vx = m.factors[idx].astype(float) * x[:, None]
    return m.bias + sum(float(m.linear[i]) * float(y) for i, y in zip(idx, x, strict=True)) + float(np.triu(vx @ vx.T, 1).sum())


def _first_of_groups(rows):
    """Numbers of the rows (id, text) that are the first of their group, by id with null last."""
    sets = []
    for _, t in rows:
        w = _split(_lower(t))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    having, root = defaultdict(list), list(range(len(rows)))
    for i, s in enumerate(sets):
        for g in s:
            having[g].append(i)
    pairs = Counter(p for ids in having.values() for p in itertools.combinations(ids, 2))
    for (i, j), n in pairs.items():
        if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n) and root[i] != root[j]:
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    groups = defaultdict(list)
    for i, r in enumerate(root):
        groups[r].append(i)
    return [min(g, key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)) for g in groups.values()]


def _taken(rows, partitions=4, fill=8):
    """Passes of each (source, size, hash) by number of row, and each source's target, by filling up to the caps and
    then what is open, in rounds, until no document fits."""
    size = Counter()
    for s, n, _ in rows:
        size[s] += n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, free = {}, set(order)
    while free:
        level = (sum(size.values()) - sum(target.values())) / sum(weight[s] for s in free)
        full = {s for s in free if 3 * size[s] < level * weight[s]}
        target |= {s: 3.0 * size[s] for s in full} if full else {s: level * weight[s] for s in free}
        free = free - full if full else set()
    bits = max(2, (4 * partitions - 1).bit_length())
    passes = {}
    for s in order:
        whole = math.floor(target[s] / size[s]) if size[s] else 0
        rest, upto, reach, spare, rank = target[s] - whole * size[s], 0, 0, [], Counter()
        # signed inside a bucket, buckets by the upper bits
        for i in sorted((i for i, r in enumerate(rows) if r[0] == s), key=lambda i: ((rows[i][2] % 2**64) >> (64 - bits), rows[i][2], rows[i][1])):
            n, bucket = rows[i][1], (rows[i][2] % 2**64) >> (64 - bits)
            upto += n
            rank[bucket] += 1
            passes[i] = whole + (rest > 0 and upto <= rest)
            if rest > 0 and upto <= rest:
                reach = upto
            elif rest > 0 and n:
                spare.append((-n, bucket, rank[bucket], i))
        gap, most = rest - reach, fill
        while left := [x for x in spare if -x[0] <= gap]:
            by_class = defaultdict(list)
            for x in sorted(left, key=lambda x: x[1:]):
                by_class[x[0].bit_length()].append(x)
            for x in sorted(x for xs in by_class.values() for x in xs[:most]):
                if -x[0] <= gap:
                    passes[x[3]] += 1
                    gap += x[0]
                    spare.remove(x)
            most *= 8
    return passes, target


@pytest.fixture(scope="module")
def tables(spark, sf, tmp_path_factory):
    """documents with repeated rows, null and repeated ids, empty texts and columns of clashing names; labels."""
    at = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    again = docs.filter("doc_id % 17 = 3").limit(8)
    null = F.lit(None).cast("long").alias("doc_id")
    rest = [F.col(c) for c in docs.columns[1:]]
    nameless = docs.filter("doc_id % 13 = 5").limit(9).select(null, *rest)
    fresh = docs.filter("doc_id % 19 = 4").limit(6).select(null, F.reverse(F.col("text")).alias("text"), *rest[1:])
    same_id = docs.filter("doc_id % 11 = 2").limit(9).select("doc_id", F.concat(F.reverse("text"), F.lit(" one more word.")).alias("text"), *rest[1:])
    no_text = docs.limit(2).select("doc_id", F.lit(None).cast("string").alias("text"), *rest[1:])
    odd = docs
    for part in (again, nameless, fresh, same_id, no_text):
        odd = odd.unionByName(part)
    clash = {c: F.lit(f"{c} stays") for c in ("mix", "quality", "row", "place", "_text", "id", "_taken")}
    odd.withColumns(clash).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{at}/labels.parquet")
    return at


def test_pipeline_stages(spark, tables):
    from tokenizers import Tokenizer

    import corpus_pipeline as pipeline

    results = [pipeline.table(spark, tables, "documents")]
    columns = results[0].columns
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, results[-1], tables)
        assert k == 4 or out.columns == columns
        out.write.parquet(f"{tables}/stage-{k}")
        results.append(spark.read.parquet(f"{tables}/stage-{k}"))
    for t in results[:-1]:
        assert {(r["mix"], r["row"], r["_taken"]) for r in t.select("mix", "row", "_taken").distinct().collect()} <= {("mix stays", "row stays", "_taken stays")}
    rows = [[(r["doc_id"], r["text"]) for r in t.select("doc_id", "text").collect()] for t in results[:-1]]
    # quality rules
    judged = [(i, t, *_pattern(t)) for i, t in rows[0]]
    posterior = quality_rules.fit(Counter(v for _, _, v, _ in judged)).posterior
    assert Counter(rows[1]) == Counter((i, t) for i, t, v, failed in judged if not failed and posterior[v] >= 0.5)
    # classifier
    m = quality_fm.train(results[0], pipeline.table(spark, tables, "labels").filter(quality_fm.crc_mod("doc_id", 3) != 1))
    assert Counter(rows[2]) == Counter((i, t) for i, t in rows[1] if _margin(m, *quality_fm.features(t.encode())) >= 0)
    # near duplicates
    assert Counter(rows[3]) == Counter(rows[2][k] for k in _first_of_groups(rows[2])) and len(rows[3]) < len(rows[2])
    assert any(i is None for i, _ in rows[3]) and len({i for i, _ in rows[3]}) < len(rows[3])
    # mixing
    told = [tuple(r) for r in results[3].select("doc_id", "text", "source", F.xxhash64("doc_id", "text")).collect()]
    passes, _ = _taken([(s, len(_split(t)), h) for _, t, s, h in told])
    assert Counter(rows[4]) == Counter({(i, t): passes[k] for k, (i, t, _, _) in enumerate(told) if passes[k]})
    # packing: every row of the mix from its first id to the end that follows its last, in the order of the mix
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {text: [*t.encode(text, add_special_tokens=False).ids, 0] for _, text in rows[4]}
    documents, place = defaultdict(list), defaultdict(list)
    for r in results[5].collect():
        assert r["length"] == len(r["ids"]) <= 2048 and r["doc_ids"] == [p["doc_id"] for p in r["pieces"]]
        at = 0
        for p in r["pieces"]:
            assert p["offset"] == at
            documents[p["place"]].append((p["piece"], p["doc_id"], r["ids"][at : at + p["length"]]))
            place[r["sequence_id"]].append(p["place"])
            at += p["length"]
        assert at == r["length"]
    whole = []
    for _, pieces in sorted(documents.items()):
        pieces.sort(key=lambda p: p[0])
        assert [p[0] for p in pieces] == list(range(len(pieces)))
        whole.append((pieces[0][1], [x for p in pieces for x in p[2]]))
    assert Counter((i, tuple(x)) for i, x in whole) == Counter((i, tuple(ids[text])) for i, text in rows[4])
    by_file = [(r["doc_id"], r["text"]) for r in with_place(results[4], "at").orderBy("at").collect()]
    assert [i for i, _ in whole] == [i for i, _ in by_file]
    last = [max(place[k]) for k in sorted(place)]
    assert sorted(place) == list(range(len(place))) and max(last[: len(last) // 4]) < max(last)
    assert Counter((tuple(r["doc_ids"]), tuple(r["ids"])) for r in pipeline.run(spark, tables).collect()) == Counter((tuple(r["doc_ids"]), tuple(r["ids"])) for r in results[5].collect())


def test_pipeline_of_an_empty_table(spark, tables, tmp_path):
    import corpus_pipeline as pipeline

    for name in ("documents", "labels"):
        pipeline.table(spark, tables, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_taken_words_meet_the_targets(spark):
    rows = [(k, f"s{k * k % 4}" if k % 11 else None, 20 + k * 7 % 50 if k % 40 else 900) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    hashes = {r["doc_id"]: r["h"] for r in df.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    passes, target = _taken([(s, n, hashes[i]) for i, s, n in rows])
    got = mixing.mix(df, size_col="size").collect()
    assert {r["doc_id"]: r["mix"]["passes"] for r in got} == passes and len(got) == len(rows)
    taken, left = Counter(), defaultdict(list)
    for r in got:
        assert math.isclose(r["mix"]["target"], target[r["source"]]) and r["mix"]["taken"] == r["mix"]["passes"] * r["size"]
        taken[r["source"]] += r["mix"]["taken"]
        left[r["source"]].append((r["mix"]["passes"], r["size"]))
    for s in target:
        # what is open fits no document that the mix left out
        assert 0 <= target[s] - taken[s] < min([n for p, n in left[s] if p == min(left[s])[0]], default=0) + 1
    # training positions: the inverse of the cumulative demand, by numeric integration of the schedule
    one = next(r["mix"] for r in got if r["mix"]["passes"] > 1)
    grid = np.linspace(0, 1, 200_001)
    demand = np.cumsum(one["start"] + (one["end"] - one["start"]) * grid)
    at = [r for r in mixing.curriculum(mixing.mix(df, size_col="size")).collect() if r["mix"]["before"] == one["before"] and r["mix"]["source_size"] == one["source_size"]]
    for r in at:
        share = min(1, (r["mix"]["pass"] * one["source_size"] + one["before"]) / one["target"])
        assert abs(r["mix"]["position"] - grid[np.searchsorted(demand, share * demand[-1])]) < 1e-4


def _plain_model(train, order):
    """p(word, the words before it) of modified Kneser-Ney over Counters; a text is its words, then the end, after one end."""
    counts = [Counter(tuple(["\n", *w][i - k : i]) for w in train for i in range(k, len(w) + 2) if k > 1 or i > 1) for k in range(1, order + 1)]
    for k in range(order - 1, 0, -1):
        left = Counter(g[1:] for g in counts[k])
        counts[k - 1] = Counter({g: left[g] or n for g, n in counts[k - 1].items()})
    d = [lm_score.discounts([sum(n == i for n in c.values()) for i in (1, 2, 3, 4)]) for c in counts]
    after = [defaultdict(Counter) for _ in counts]
    for k, c in enumerate(counts):
        for g, n in c.items():
            after[k][g[:-1]][min(n, 3)] += 1
            after[k][g[:-1]]["all"] += n

    def p(word, before):
        if not before:
            n, all_of = counts[0][word,], after[0][()]
            return (max(n - d[0][min(n, 3)], 0) + sum(d[0][i] * all_of[i] for i in (1, 2, 3)) / (len(counts[0]) + 1)) / all_of["all"]
        low, all_of = p(word, before[1:]), after[len(before)].get(before)
        if not all_of:
            return low
        n = counts[len(before)][*before, word]
        return (max(n - d[len(before)][min(n, 3)], 0) + sum(d[len(before)][i] * all_of[i] for i in (1, 2, 3)) * low) / all_of["all"]

    return p, [g[0] for g in counts[0]]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_kneser_ney_probabilities(spark, order):
    more = ["a b c d", "b c d e a", "a b c", "b c", "c d e f a b", "a b c d e", "", "x y", "a b x y a b c"]
    texts = [(i, _split(_lower(t)) + ["\n"]) for i, t in enumerate([t for _, t in ROWS] + more)]
    p, words = _plain_model([w for i, w in texts if i % 3], order)
    for before in [(), ("\n",), ("a",), ("never-seen",), ("a", "b"), ("\n", "a"), ("never-seen", "b"), ("a", "b", "c")]:
        if len(before) < order:
            assert math.isclose(sum(p(w, before) for w in [*words, "never-seen"]), 1)
    df = spark.createDataFrame([(i, t or "") for i, t in enumerate([t for _, t in ROWS] + more)], "id long, text string").repartition(3)
    got = {r["id"]: r for r in lm_score.perplexity(df, lm_score.build(df.filter("id % 3 > 0"), order)).collect()}
    assert len(got) == len(texts)
    for i, w in texts:
        whole = ["\n", *w]
        assert math.isclose(got[i]["score"], sum(math.log10(p(whole[k], tuple(whole[max(0, k - order + 1) : k]))) for k in range(1, len(whole))), rel_tol=1e-9)
        assert got[i]["n_tokens"] == len(w) and got[i]["n_known"] == sum(x in words for x in w)


def test_edited_and_next_likeness(spark):
    rows = list(enumerate(["abcd", "cdcd", "cdcd", "CDCD", "xyxy", "yx", "xyxyyx", "", "abab", "ab", "abcd"]))
    form = lambda t: " ".join(t.lower().split())
    want = {}
    for i, t in rows:
        following = rows[(i + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        want[i] = (float(form(edited) == form(t)), float(form(following) == form(t)))
    got = {r["doc_id"]: (r["near_edited"], r["near_next"]) for r in fingerprints.edit_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and {(1.0, 1.0), (1.0, 0.0), (0.0, 0.0)} <= set(want.values())
