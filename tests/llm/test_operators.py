"""Operators on odd rows (nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables), against plain
versions where those are short; test_plain_versions.py has the longer ones."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.llm import fingerprints, jaccard, licenses, lm_score, mixing, packing, quality_fm, quality_rules, token_counts, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = ["the", "of", "Ärger", "x", "été", "Alpha", "beta", "gamma", "delta", "eps"]


def _text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def _edit(text, at):
    w = text.split()
    w[at] = "changed"
    return " ".join(w)


BASE = _text(1, 120)
ROWS = [(0, BASE), (1, BASE), (2, _edit(BASE, 60)), (3, _edit(BASE, 3).upper()), (4, None), (5, ""), (6, " \n\t "), (7, "a b c"), (8, "A b\nc"), (9, _text(2, 4000)), (10, "x"), (11, "  two  spaces \n\n here <|endoftext|> \x1c z"), (12, _text(3, 60)), (13, _text(3, 60)), (13, _text(3, 60)), (None, _text(4, 70)), (14, "a b c d e f g"), (15, "a b c d e f h")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, "s" if i is None or i % 3 else None) for i, t in ROWS], "doc_id long, text string, source string")
    return df.withColumns({"id": F.lit("clash"), "size": F.lit(-1), "key": F.lit(0), "n": F.lit(None).cast("int")}).repartition(3)


def _split(t):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", t or "") if w]


def _lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def _count(rows):
    return Counter(tuple(r) for r in rows)


def test_token_counts(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = Counter((i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 2048) for i, x in ROWS)
    assert _count(token_counts.count_tokens(docs, path, table_size=20, cache_size=50).collect()) == want
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0
    got = token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(got) == len(ROWS) and all(r["n_tokens"] > 0 for r in got if r["n_bytes"] > 3)


def test_chunks_are_the_sum_of_their_pre_tokens(spark, tmp_path):
    import json

    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, split = Tokenizer.from_file(path), token_counts.pre_tokens(path)
    r = random.Random(11)
    letters = "aZé中'sd7,.-_<|>ẞİÄ\u0301\u1e9b\u0323ﬁ٣"
    chunks = ["".join(r.choice(letters) for _ in range(r.randrange(1, 9))) for _ in range(3000)] + ["<|endoftext|>x", "don't", "x<|startoftext|>"]
    chunks += [w + e for w in ("Élan", "straße", "ÿªº", "µm", "ABC", "x" * 3000) for e in ("", ".", "'", "?!", "'s", ",", "»")] + [chr(c) + "a." for c in range(0x21, 0x180) if not chr(c).isspace()]
    for c in chunks:
        assert sum(len(t.encode(p, add_special_tokens=False).ids) for p in split(c)) == len(t.encode(c, add_special_tokens=False).ids), c
    texts = [" ".join(r.choices(chunks, k=r.randrange(30))) + r.choice(["", "\u00a0", "\t", "\x1d"]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(40)  # a tree of two levels
    got = {x["doc_id"]: x["n_tokens"] for x in token_counts.count_tokens(df, path, table_size=50, cache_size=60).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}
    counts = Counter(p for x in texts for c in x.replace("\x1d", " ").split() for p in split(c))
    table = token_counts.frequent(df.select("text"), path, 4000)
    assert set(table) >= {p for p, n in counts.most_common(20)}
    assert token_counts.splits_at_space(path) and not token_counts.splits_at_space(public_tokenizers.path("byte_bpe_50k.json"))
    # a vocabulary that cuts at commas alone does not end a token at white space
    spec = json.loads(open(path).read())
    spec["pre_tokenizer"]["pretokenizers"][0] |= {"pattern": {"Regex": "[^,]+"}}
    other = tmp_path / "commas.json"
    other.write_text(json.dumps(spec))
    assert not token_counts.splits_at_space(str(other))


@pytest.mark.parametrize("cap", [packing.Capacity(), packing.Capacity(tokens=2048, documents=3, rule="dot"), packing.Capacity(attention=2048 * 2048, documents=2)])
def test_packing(docs, cap):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in ROWS}
    pieces = packing.token_pieces(docs, path, with_ids=True, cache_size=30)
    rows = packing.pack(pieces, cap=cap).collect()
    bins = defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(len(ids[i]) for i, _ in ROWS)
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [0, *itertools.accumulate(n for _, n in b)][:-1] and sum(n for _, n in b) <= 2048
        assert len(b) <= cap.documents and sum(n * n for _, n in b) <= cap.attention
    if cap == packing.Capacity():
        whole = packing.sequences(packing.pack(pieces)).collect()
        assert len(whole) == len(bins) and Counter(r["length"] for r in whole) == Counter(sum(n for _, n in b) for b in bins.values())
        for r in whole:
            assert r["ids"] == [x for p in r["pieces"] for x in ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]] and r["doc_ids"] == [p["doc_id"] for p in r["pieces"]]
    assert packing.pack(packing.token_pieces(docs.limit(0), path)).count() == 0


def test_pack_lengths_is_near_the_bound():
    h = {k: 5 + k % 7 for k in range(1, 2048)}
    ranges = packing.pack_lengths(h, packing.Capacity())
    used = Counter()
    for length, _, take, first, _ in ranges:
        for b in range(first, first + take):
            used[b] += length
    assert max(used.values()) <= 2048 and len(used) <= 1.01 * math.ceil(sum(k * v for k, v in h.items()) / 2048) + 1
    assert sum(t for _, _, t, _, _ in ranges) == sum(h.values())


def _sets():
    out = []
    for _, t in ROWS:
        w = _split(_lower(t))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


@pytest.mark.parametrize("block", [2, 1024])
def test_jaccard(docs, block):
    sets = _sets()
    root = list(range(len(ROWS)))
    for i, j in itertools.combinations(range(len(ROWS)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            a, b = root[i], root[j]
            root = [min(a, b) if x in (a, b) else x for x in root]
    least = {r: min((ROWS[k][0] for k in range(len(ROWS)) if root[k] == r and ROWS[k][0] is not None), default=None) for r in set(root)}
    want = Counter((ROWS[k][0], len(sets[k]), least[root[k]]) for k in range(len(ROWS)))
    got = jaccard.similar(docs, block=block).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert {r["n_copies"] for r in got if r["doc_id"] == 13} == {3}
    kept = [r["doc_id"] for r in jaccard.one_of_each(docs).collect()]
    assert 0 in kept and not {1, 2} & set(kept)
    assert jaccard.similar(docs.limit(0)).count() == 0


def _plain_components(rows):
    """(n_links, root) by number of row, comparing all pairs."""
    sets, links, root = [], Counter(), list(range(len(rows)))
    for t in rows:
        w = _split(_lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            if sets[i] != sets[j]:
                links[i] += 1
                links[j] += 1
            a, b = sorted((root[i], root[j]))
            root = [a if x == b else x for x in root]
    return links, root


def test_long_chains_and_large_groups_of_near_copies(spark):
    words = [f"w{k}" for k in range(1400)]
    chain = [" ".join(words[k : k + 60]) for k in range(0, 1200, 7)]  # neighbours are similar, others share rare words at most
    loose = [" ".join(words[k : k + 60]) + f" end{k}" for k in range(0, 1200, 20)]  # share keys, not linked
    group = [" ".join(w if i != k else f"own{k}" for i, w in enumerate(f"g{j}" for j in range(150))) for k in range(40)]
    texts = chain + loose + group
    links, root = _plain_components(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (4, 1024):
        got = {r["doc_id"]: r for r in jaccard.similar(df, block=block).collect()}
        assert [got[k]["component_id"] for k in range(len(texts))] == root
        assert [got[k]["n_links"] for k in range(len(texts))] == [links[k] for k in range(len(texts))]


def test_one_row_of_each_group_stays(spark):
    a, b = _text(21, 40), _text(22, 40)
    rows = [(1, a), (1, a), (None, a), (2, b), (None, b), (None, b), (None, _text(23, 40)), (None, None), (None, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(7), "own": F.lit("clash"), "key": F.lit(None).cast("int")})
    for some in (df, df.repartition(3)):
        kept = jaccard.one_of_each(some)
        assert kept.columns == df.columns and {r["row"] for r in kept.collect()} == {7}
        assert _count(kept.select("doc_id", "text").collect()) == _count([(1, a), (2, b), rows[6], (None, None), (None, None), (3, "")])
    assert jaccard.one_of_each(df.limit(0)).count() == 0


def test_windows_of_the_order_are_packed_apart(spark):
    r = random.Random(9)
    rows = [(k, 0, r.choice([5, 700, 1500, 2048, r.randrange(1, 2048)]), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long, place long").withColumns({"_window": F.lit("clash"), "row": F.lit(1), "of": F.lit(2)})
    got = packing.pack(df.repartition(3), order_col="place", windows=5).collect()
    bins = defaultdict(list)
    for x in got:
        bins[x["sequence_id"]].append((x["offset"], x["length"], x["place"]))
    assert len(got) == 3000 and sorted(bins) == list(range(len(bins))) and {x["_window"] for x in got} == {"clash"}
    for b in bins.values():
        b.sort()
        assert [o for o, _, _ in b] == [0, *itertools.accumulate(n for _, n, _ in b)][:-1] and sum(n for _, n, _ in b) <= 2048
    spans = [(min(p for _, _, p in bins[k]), max(p for _, _, p in bins[k])) for k in sorted(bins)]
    cuts = [k for k in range(1, len(spans)) if min(a for a, _ in spans[k:]) > max(z for _, z in spans[:k])]
    assert len(cuts) >= 4  # five windows, one after the other
    assert packing.pack(df.limit(0), order_col="place").count() == 0


def test_subsets_and_prefixes_miss_no_link():
    grams = np.sort(np.random.default_rng(1).integers(0, 2**63, 12).astype(np.uint64))
    for light in (0, 4, 8):
        for s, t in [(4, 4), (4, 5), (7, 7), (7, 8), (8, 8), (9, 9)]:
            need = jaccard._needed(s, t)
            a, b = grams[:s], np.sort(np.concatenate([grams[:need], grams[12 - (t - need) :]]))
            if len(set(a) & set(b)) >= need and len(set(b)) == t:
                assert set(jaccard.candidate_keys(a, np.ones(s), s, light)) & set(jaccard.candidate_keys(b, np.ones(t), t, light)), (s, t, light)


def test_language_model(spark, docs):
    rows = [(i, _split(_lower(t)) + ["\n"]) for i, t in ROWS]
    train = [w for i, w in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    c = Counter(x for w in train for x in w)
    n, v = sum(c.values()), len(c)
    got = lm_score.held_out_scores(docs)
    for r in got.collect():
        options = [w for i, w in rows if i == r["doc_id"]]
        assert any(math.isclose(r["base_score"], sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9) and r["n_tokens"] == len(w) for w in options)
        assert r["train_tokens"] == n
    for order in (2, 3, 4):  # a model of nothing
        blank = lm_score.build(spark.createDataFrame([], "id long, text string"), order)
        assert [round(r["score"], 9) for r in lm_score.perplexity(docs, blank, "doc_id").filter("doc_id = 7").collect()] == [0.0]
    with pytest.raises(ValueError):
        lm_score.build(docs, 1)
    assert lm_score.held_out_scores(docs.limit(0)).count() == 0


def test_fingerprints(spark, docs):
    got = {(r["doc_id"], r["n_chars"]): r for r in fingerprints.fingerprints(docs).collect()}
    assert got[0, len(BASE)]["fingerprint"] == got[1, len(BASE)]["fingerprint"] != got[2, len(_edit(BASE, 60))]["fingerprint"]
    assert len({got[k]["fingerprint"] for k in [(4, 0), (5, 0), (6, 4)]}) == 1
    assert got[7, 5]["fingerprint"] == got[8, 5]["fingerprint"]
    odd = spark.createDataFrame([(1, "Straße É"), (2, "STRASSE  é")], "doc_id long, text string")
    assert len({r["fingerprint"] for r in fingerprints.fingerprints(odd).collect()}) == 1
    assert fingerprints.fingerprints(docs.limit(0)).count() == 0 and fingerprints.edit_likeness(docs.limit(0)).count() == 0
    clash = spark.createDataFrame([("h", "a" * 64)], "own_hash string, own_sha string")
    told = fingerprints.told_apart(clash, spark.createDataFrame([("h",)], "hash string"), "own").first()
    assert told["own_fingerprint"] == "h-" + "a" * 64


def test_fingerprints_of_odd_ids(spark):
    texts = ["ab", "AB", " ab", "cd", None, "", "x" * 50]
    for kind, ids in (("string", ["z", "a", None, "a", None, "ü", "10"]), ("double", [1.5, None, -2.0, 1.5, None, 0.0, 3.0]), ("date", None)):
        if ids is None:
            df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select(F.expr("date'2024-01-01' + k").alias("doc_id"), "text")
        else:
            df = spark.createDataFrame(list(zip(ids, texts, strict=True)), f"doc_id {kind}, text string")
        df = df.withColumns({c: F.lit(1) for c in ("id", "row", "hash", "_range")}).repartition(3)
        assert fingerprints.edit_likeness(df).count() == len(texts) == fingerprints.fingerprints(df).count()
        got = Counter(r["n_equal"] for r in fingerprints.fingerprints(df).collect())
        assert got == {3: 3, 1: 2, 2: 2}


def test_next_of_many_equal_and_null_ids(spark):
    r = random.Random(4)
    rows = [(r.choice([None, None, 7, 7, k]), f"t{r.randrange(60)}") for k in range(400)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(5)
    hashes = {x["text"]: x["h"] for x in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, (hashes[x[1]] % 2**64) >> 11, x[1]))
    got = fingerprints.with_next(df, ["id", "text"]).collect()
    want = [(*a, *b) for a, b in zip(order, [*order[1:], order[0]], strict=True)]
    assert _count(got) == _count(want)


def test_edited_text_is_the_next_documents(spark):
    import hashlib

    rows = [(k * 3 % 11, "".join(chr(97 + (k * 7 + j) % 26) for j in range(k * 2))) for k in range(11)]
    order = sorted(rows)
    want = {i: hashlib.sha256((t[: len(t) - len(t) // 2] + order[(k + 1) % 11][1][: len(t) // 2]).encode()).hexdigest() for k, (i, t) in enumerate(order)}
    got = fingerprints.edit_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["edited_sha256"] for r in got} == want


def test_quality_rules(docs):
    # the operator's own and former inner names as columns of the input
    odd = docs.withColumns({c: F.lit(f"{c} stays") for c in ("quality", "quality_", "_text", "_words", "_w", "_l", "_q", "n_words", "votes")})
    got = quality_rules.judge(odd, name="told").collect()
    assert len(got) == len(ROWS)
    for r in got:
        w = _split(r["text"])
        g = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {i + j for i in range(len(w) - 2) for j in range(3) if g[tuple(w[i : i + 3])] > 1}
        q = r["told"]
        assert (q["n_words"], q["word_chars"], q["n_repeat_words"]) == (len(w), sum(map(len, w)), len(cover))
        assert q["base_failed"] == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and r["quality"] == "quality stays" and r["_w"] == "_w stays"
    kept = quality_rules.accepted(odd)
    assert kept.columns == odd.columns and {r["_text"] for r in kept.collect()} == {"_text stays"}
    assert quality_rules.judge(docs.limit(0)).count() == 0 == quality_rules.accepted(odd.limit(0)).count()


def test_votes_split_good_from_bad():
    good, bad = "000000000011111", "011000000000100"
    p = quality_rules.fit({good: 900, bad: 100}).posterior
    assert p[good] > 0.9 and p[bad] < 0.1 and quality_rules.fit({}).posterior == {}


def test_accuracies_are_estimated_and_the_likelihood_rises():
    r, rules = random.Random(5), quality_rules.RULES
    on_good = [0.7 + 0.02 * i if x[1] else 0.01 + 0.004 * i for i, x in enumerate(rules)]
    on_bad = [0.1 + 0.02 * i if x[1] else 0.2 + 0.05 * i for i, x in enumerate(rules)]
    truth = [r.random() < 0.8 for _ in range(20_000)]
    patterns = Counter("".join("1" if r.random() < x else "0" for x in (on_good if y else on_bad)) for y in truth)
    fit = quality_rules.fit(patterns, smoothing=0.0)
    assert abs(fit.prior - 0.8) < 0.02 and len(fit.objective) > 3
    assert all(b >= a - 1e-9 * abs(a) for a, b in itertools.pairwise(fit.objective))
    for i, (_, is_good, _) in enumerate(rules):
        assert abs(fit.on_good[i] - on_good[i]) < 0.03 and abs(fit.on_bad[i] - on_bad[i]) < 0.06
        right, wrong = (0.8 * on_good[i], 0.2 * on_bad[i]) if is_good else (0.2 * on_bad[i], 0.8 * on_good[i])
        assert abs(fit.accuracy[i] - right / (right + wrong)) < 0.05


def test_classifier(spark):
    rows = [(k, _text(k, 80) + "." if k % 4 else " ".join(f"{w.upper()}!!" for w in _text(k, 80).split()), int(k % 4 > 0)) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    m = quality_fm.train(df.filter("doc_id < 300"), df)
    got = {r["doc_id"]: r["score"] for r in quality_fm.score(df, m).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in rows if i >= 300)
    odd = spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string")
    assert all(0 <= r["score"] <= 1 for r in quality_fm.score(odd, m).collect())
    assert quality_fm.accepted(df, m).count() == 300
    idle = quality_fm.train(df.limit(0), df)
    assert quality_fm.score(odd, idle).count() == 2


def test_classifier_learns_from_metadata(spark):
    # equal texts: only a column tells the classes apart, a name or a number
    rows = [(k, "some words.", ["forum", "book"][k % 2], [3, 900][k % 2], k % 2) for k in range(300)] + [(k, "some words.", None, None, 0) for k in (300, 301)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string, size long, quality int")
    for col in ("kind", "size"):
        m = quality_fm.train(df.filter("doc_id < 200"), df, meta=[col])
        got = {r["doc_id"]: r["score"] for r in quality_fm.score(df, m).collect()}
        assert len(got) == 302 and all((got[k] >= 0.5) == bool(k % 2) for k in range(200, 300))
        kept = quality_fm.accepted(df.filter("doc_id < 300"), m)
        assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == set(range(1, 300, 2))


def test_mixing(docs):
    odd = docs.withColumns({c: F.lit(f"{c} stays") for c in ("mix", "mix_pass", "_source", "_bucket", "_size", "bucket")})
    got = mixing.mix(odd).collect()
    assert len(got) == len(ROWS) and sum(r["mix_"]["size"] for r in got) == sum(len(_split(t)) for _, t in ROWS)
    total = sum({r["source"]: r["mix_"]["target"] for r in got}.values())
    assert math.isclose(total, sum(r["mix_"]["size"] for r in got)) and all(r["mix_"]["taken"] <= 3 * r["mix_"]["size"] and r["_source"] == "_source stays" for r in got)
    mixed = mixing.mix(odd, name="m")
    places = [r["m"]["position"] for r in mixing.curriculum(mixed, "m").collect()]
    assert places == sorted(places) and all(0 <= p <= 1 for p in places) and len(places) == sum(r["mix_"]["passes"] for r in got)
    every = mixing.curriculum(mixed, "m", untaken=True).select("doc_id", "m.*", mixing.positions("m").alias("all")).collect()
    first = [r for r in every if not r["pass"]]
    assert _count((r["doc_id"],) for r in first) == _count((i,) for i, _ in ROWS) and all(len(r["all"]) == r["passes"] for r in first)
    assert all(r["position"] == r["all"][r["pass"]] if r["passes"] else r["position"] is None for r in every)
    assert mixing.mix(docs.limit(0)).count() == 0 == mixing.curriculum(mixing.mix(docs.limit(0))).count()


def test_mixing_of_repeated_and_null_ids(spark):
    rows = [(1, "a b", "x"), (1, "c d e", "x"), (None, "f", "x"), (None, "g h", None), (2, "i", None), (2, "i", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.curriculum(mixing.mix(df), untaken=True).filter("mix.pass IS NULL OR mix.pass = 0").select("doc_id", "text", "source").collect()
    assert _count(out) == _count(rows)


def test_ranks_by_code_point(spark):
    names = [f"s{k}" for k in range(50)] + ["Z", "ä", "", "\U0001f600", "\uffff", None]
    got = {r["source"]: r["rank"] for r in mixing.ranked(spark.createDataFrame([(x,) for x in names], "source string").repartition(3)).collect()}
    assert sorted(got, key=got.get) == sorted(names, key=lambda x: (x is None, x or "")) and sorted(got.values()) == list(range(len(names)))


def test_targets_are_capped_and_reshared(spark):
    s = spark.createDataFrame([("a", 10, 3.0, 3.0), ("b", 1000, 1.0, 1.0), ("c", 90, 2.0, 2.0)], "source string, source_size long, start double, end double")
    got = {r["source"]: r["target"] for r in mixing.targets(s).collect()}
    assert got["a"] == 30 and got["c"] == 270 and math.isclose(got["b"], 800)
    assert mixing.targets(s.limit(0)).count() == 0


def test_very_long_texts(spark):
    from tokenizers import Tokenizer

    r = random.Random(2)
    words = [f"{r.choice(WORDS)}{r.randrange(3000)}" for _ in range(250_000)]
    texts = [" ".join(words), "y" * 1_000_000, "\n".join(words[:100_000]) + "\x1d z", "short and plain"]
    df = spark.createDataFrame([(k, t, "s", f"p/{k}.txt", "http://h/x") for k, t in enumerate(texts)], "doc_id long, text string, source string, path string, url string")
    split = [_split(t) for t in texts]
    by = lambda d, c, i="doc_id": {x[i]: x[c] for x in d.collect()}
    word, byte = (public_tokenizers.path(f"{x}.json") for x in ("word_bpe_49k", "byte_bpe_50k"))
    count = lambda p: {k: len(Tokenizer.from_file(p).encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}
    assert by(token_counts.count_tokens(df, word), "n_tokens") == count(word)
    pieces = Counter()
    for x in packing.pack(packing.token_pieces(df, byte, with_ids=True)).collect():
        assert len(x["ids"]) == x["length"] <= 2048
        pieces[x["doc_id"]] += x["length"]
    assert pieces == {k: n + 1 for k, n in count(byte).items()}
    shingles = {k: len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) or 1 for k, w in enumerate([_split(_lower(t)) for t in texts])}
    assert by(jaccard.similar(df), "n_shingles") == shingles
    assert by(lm_score.held_out_scores(df), "n_tokens") == {k: len(w) + 1 for k, w in enumerate(split)}
    judged = quality_rules.judge(df.select("doc_id", "text"), name="q", carry=["doc_id"])
    assert by(judged.select("doc_id", "q.n_words"), "n_words") == {k: len(w) for k, w in enumerate(split)}
    assert by(mixing.mix(df).select("doc_id", "mix.size"), "size") == {k: len(w) for k, w in enumerate(split)}
    assert by(fingerprints.edit_likeness(df), "n_chars") == by(fingerprints.fingerprints(df), "n_chars") == {k: len(t) for k, t in enumerate(texts)}
    idle = quality_fm.train(df.limit(0), df.select("doc_id", F.lit(1).alias("quality")))
    assert len(quality_fm.score(df, idle).collect()) == 4 == quality_fm.accepted(df, idle, threshold=0.1).count()
    assert by(warc.capture(df, "doc_id", payload_col="text")[0], "payload_bytes", "page_id") == {k: len(t) for k, t in enumerate(x.encode() for x in texts)}
    assert licenses.scan_licenses(df, "doc_id", "path").count() == 4


def test_licenses(spark):
    rows = [(1, "r/LICENSE", "Released under the MIT License."), (2, "r/a/b/x.txt", "words"), (3, "r/a/COPYING", "intro\nLicensed under the Apache License, Version 2.0.\nend"), (4, "r/c/y.txt", "no licence here at all, really"), (5, None, None), (6, "q/z.txt", "words"), (7, "q/w", "Licensed under CC BY-NC 4.0.")]
    got = {r["doc_id"]: (r["license"], r["origin"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string"), "doc_id", "path").collect()}
    assert got == {1: ("MIT", "own"), 2: ("Apache-2.0", "inherited"), 3: ("Apache-2.0", "own"), 4: ("MIT", "inherited"), 5: (None, None), 6: (None, None), 7: ("CC-BY-NC-4.0", "own")}


def _licence_score(texts, passage, template):
    """Plain TF-IDF cosine with the document frequencies of all terms."""
    docs = [set(licenses.terms(t or "")) for t in texts]
    idf = lambda t: math.log((len(docs) + 1) / (sum(t in d for d in docs) + 1)) + 1
    a, b = ({t: n * idf(t) for t, n in Counter(licenses.terms(x)).items()} for x in (passage, template))
    return sum(a[t] * b.get(t, 0) for t in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))


def test_licence_terms_weigh_by_their_true_frequencies(spark):
    line = "Released as it is of use under the MIT License."
    rows = [(k, "r/x", "as it is of use to all" if k else line) for k in range(300)]
    want = _licence_score([t for _, _, t in rows], line, "Released under the MIT License.")
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string"), "doc_id", "path").filter("doc_id = 0").first()
    assert want > 0.9 and got["license"] == "MIT" and math.isclose(got["score"], want, abs_tol=1e-8)


def _body(text):
    return text.split("\n", 2)[2]


MIT, ISC = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "Permission to use, copy, modify, and/or distribute this software"


def test_licence_files_with_whole_texts(spark):
    t = licenses.TEXTS
    mit, isc = _body(t["MIT"]), _body(t["ISC"])
    assert mit.startswith(MIT[:40]) and isc.startswith(ISC)
    regents = t["BSD-3-Clause"].replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", "REGENTS AND CONTRIBUTORS").replace("copyright holder nor", "University nor")
    owner = "Copyright (c) 2019 A. N. Other\nAll rights reserved.\n\n"
    files = [("MIT", owner + mit), ("ISC", owner + isc), ("BSD-3-Clause", owner + regents), *((k, owner + t[k]) for k in t)]
    rows = [(k, f"r{k}/LICENSE", text) for k, (_, text) in enumerate(files)] + [(100 + k, f"r{k}/a/x.c", "words") for k in range(len(files))] + [(k, None, f"some prose the of {k}") for k in range(200, 400)]
    got = {r["doc_id"]: (r["license"], r["origin"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string"), "doc_id", "path").collect()}
    for k, (name, _) in enumerate(files):
        assert got[k] == (name, "own") and got[100 + k] == (name, "inherited")
    assert all(got[k] == (None, None) for k in range(200, 400))


def test_licence_passages_do_not_follow_lines(spark):
    prose = "river stone early market people carried wooden boxes along quiet northern roads"
    said = [("MIT", "Released under the MIT License."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.")]
    wrap = lambda text, n: "\n".join(f"# {' '.join(w)}" for w in itertools.batched(text.split(), n))
    heads = [*((k, x) for k, x in licenses.HEADERS), ("MIT", _body(licenses.TEXTS["MIT"])), ("ISC", _body(licenses.TEXTS["ISC"])), ("BSD-2-Clause", licenses.TEXTS["BSD-2-Clause"]), ("BSD-3-Clause", licenses.TEXTS["BSD-3-Clause"])]
    rows = [(k, f"{prose} {x} {prose}\nend") for k, x in said] + [(k, f"{prose}\n{x.replace(' ', chr(10), 3)} {prose}") for k, x in said]
    rows += [(k, f"#!/bin/sh\n# Copyright 2020 Some One\n{wrap(x, n)}\n{prose} {prose}") for k, x in heads for n in (4, 9)]
    rows += [(None, f"{prose} {x}\n{prose}") for x in ("with permission of the owner", "a license to drive", "redistribution of wealth in source", "the domain of the license")]
    rows += [(None, f"{prose} {k} the of and") for k in range(100)]
    df = spark.createDataFrame([(k, None, text) for k, (_, text) in enumerate(rows)], "doc_id long, path string, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.scan_licenses(df, "doc_id", "path").collect()}
    assert [got[k] for k in range(len(rows))] == [name for name, _ in rows]


def test_licence_files_that_hold_the_start_of_a_text(spark):
    names = ["LICENSE-MIT", "COPYING.LESSER", "LICENCE.txt", "UNLICENSE", "license.md"]
    rows = []
    for k, (name, text) in enumerate(licenses.TEXTS.items()):
        lines = [x for x in text.split("\n") if x.strip()]
        for n in (7, 12):
            rows.append((len(rows), f"r{len(rows)}/{names[k % 5]}", "\n".join(lines[:n]), name))
    prose = [(1000 + k, None, f"some prose the of {k}", None) for k in range(300)]
    df = spark.createDataFrame(rows + prose, "doc_id long, path string, text string, want string")
    got = {r["doc_id"]: r["license"] for r in licenses.scan_licenses(df, "doc_id", "path").collect()}
    # both BSD licences begin alike
    same = lambda a, b: a == b or {a, b} == {"BSD-2-Clause", "BSD-3-Clause"}
    assert all(same(got[k], want) for k, _, _, want in rows) and not any(got[k] for k, *_ in prose)


def test_licences_of_repeated_rows_and_empty_tables(spark):
    rows = [(1, "a/LICENSE", "Released under the MIT License.")] * 2 + [(2, "a/LICENSE", "Licensed under CC BY 4.0."), (None, "a/b/x", "words"), (None, "a/b/x", None), (3, "a/b/x", "")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumns({c: F.lit("clash") for c in ("dir", "_row", "license", "terms", "own", "id")})
    got = _count(licenses.scan_licenses(df, "doc_id", "path").select("doc_id", "license", "origin").collect())
    assert got == {(1, "MIT", "own"): 2, (2, "CC-BY-4.0", "own"): 1, (None, "MIT", "inherited"): 2, (3, "MIT", "inherited"): 1}
    assert licenses.scan_licenses(df.limit(0), "doc_id", "path").count() == 0


def test_near_duplicates_equal_sql(spark, sf):
    import duckdb

    from scanloom.llm import queries

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, sf)
        assert _count(df.collect()) == _count(con.sql(sql).select(*df.columns).fetchall())


def test_warc(spark):
    rows = [(3, "http://b.org/x", "same"), (1, "http://a.b.org:80/y?q#f", "same"), (2, None, None), (4, "http://b.org/x\n", ""), (5, "http://b.org/z", "été" * 1000)]
    records, index = warc.capture(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in records.collect()}
    assert got == {1: (4, warc.b32(b"same"), "response", None), 3: (4, warc.b32(b"same"), "revisit", 1), 2: (0, warc.b32(b""), "response", None), 4: (0, warc.b32(b""), "revisit", 2), 5: (5000, warc.b32(("été" * 1000).encode()), "response", None)}
    keys = [(r["url_key"], r["ts"], r["page"]) for r in index.orderBy("part", "place").collect()]
    assert keys == sorted(keys) and len(keys) == 5


def test_warc_of_odd_rows(spark):
    # text ids with odd characters, null and repeated ids, repeated rows, clashing columns
    rows = [("b\r\n%41 é\u2028", "http://x/1", "p"), ("a: b", "http://x/1", "p"), (None, "http://x/2", "p"), (None, None, "q"), (None, "http://x/3", "q"), ("a: b", "http://x/1", "p"), ("", "http://x/4", "z" * 300_000), ("c", "http://x/5", None)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string").withColumns({c: F.lit(c) for c in ("digest", "first", "same", "size", "ts", "id")}).repartition(3)
    records, index = warc.capture(df)
    want = []
    for i, _, p in rows:
        least = min((j for j, _, q in rows if j is not None and (q or "") == (p or "")), default=None)
        other = least if least is not None and i != least else None
        want.append((i, len((p or "").encode()), warc.b32((p or "").encode()), "revisit" if other is not None else "response", other))
    assert _count(records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == _count(want)
    assert index.count() == len(rows)
    large = warc.write_archives(df, warc.shared_dir(spark), least=2).groupBy("record_type").count().collect()
    assert {r["record_type"]: r["count"] for r in large} == {"response": len(rows)}  # smaller payloads are all responses
    none, empty = warc.capture(df.limit(0))
    assert none.count() == 0 == empty.count()


def test_revisits_refer_to_their_response(spark):
    rows = [(1, "http://x/1", "p"), (2, "http://x/2", "p")]
    uri = warc.shared_dir(spark)
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), uri).collect()
    files = spark.read.format("binaryFile").load(f"{uri}/warc").collect()
    heads = {h["X-Page"]: h for f in files for h, _, _ in warc.parse(bytes(f["content"]))}
    assert heads["2"]["WARC-Refers-To"] == heads["1"]["WARC-Record-ID"] and heads["2"]["WARC-Refers-To-Target-URI"] == "http://x/1" and heads["2"]["WARC-Refers-To-Date"] == heads["1"]["WARC-Date"]


def test_runs_are_merged_over_many_batches(spark):
    r = random.Random(8)
    rows = [(k, f"http://h{r.randrange(5)}.org/{r.randrange(40)}", f"p{k}", r.choice([None, "2020-01-01 00:00:00", f"2021-01-{1 + r.randrange(28):02} 00:00:00"])) for k in range(3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, ts string").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = [(x["url_key"], x["ts"], int(x["page"])) for x in warc.capture(df, ts_col="ts")[1].orderBy("part", "place").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 3000 and got == sorted(got, key=lambda x: (x[0], x[1] is not None, x[1], str(x[2])))


def test_loser_tree():
    r = random.Random(3)
    for k in range(9):
        runs = [sorted(r.randrange(50) for _ in range(r.randrange(20))) for _ in range(k)]
        assert list(warc.LoserTree([iter(x) for x in runs])) == sorted(itertools.chain(*runs))


def test_duplicate_lines_and_symbols_of_every_blank_and_letter(spark):
    """The base counts of quality rules as their contract gives them, for each ASCII white space character and letter."""
    blanks, letters = " \t\n\x0b\x0c\r", [chr(c) for c in range(97, 123)]
    texts = [f"{c}{c}\n{c}\n{c}\nword" for c in blanks + "".join(letters)] + [f"a{c}b\na{c}b\n{c}\n{c}" for c in blanks] + ["ff\nff\nff", "\x0c\n\x0c\nword", "#*$ %&|\n<>\n<>", None, ""]

    def plain(t):
        words, lines = _split(t), [x for x in (t or "").split("\n") if _split(x)]
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r["q"][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in quality_rules.judge(df, name="q").collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_names_that_clash_or_have_dots(spark):
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(["red", "blue", "old", "new", "sun", "sea"]) + r.choice(".,  ") for _ in range(80)), "s" if i % 3 else None, i) for i in range(40)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string, x long")
    odd = ["mix", "mix_of", "mix_plan", "mix_pass", "a.b", "quality", "quality_of", "c0", "fields", "row", "place`s"]
    df = plain.select("doc_id", "text", "source", *[F.col("x").alias(c) for c in odd])
    texts = {i: t for i, t, *_ in rows}
    machine = quality_fm.Machine(1.0, np.zeros(quality_fm.BUCKETS + quality_fm.STATS, np.float32), np.zeros((quality_fm.BUCKETS + quality_fm.STATS, 1), np.float32))
    for out in (quality_rules.accepted(df), quality_fm.accepted(df, machine), jaccard.one_of_each(df)):
        assert out.columns == df.columns and all(tuple(r)[1] == texts[r[0]] and set(tuple(r)[3:]) == {r[0]} for r in out.collect())
    assert quality_fm.accepted(df, machine).count() == 40
    mixed = mixing.mix(df, name="m").collect()
    want = {(r["doc_id"], r["mix"]["taken"], r["mix"]["passes"]) for r in mixing.mix(plain).collect()}
    assert {(r["doc_id"], r["m"]["taken"], r["m"]["passes"]) for r in mixed} == want and all(set(tuple(r)[3:-1]) == {r["doc_id"]} for r in mixed)
    pieces = df.withColumns({"piece": F.lit(0), "length": F.lit(7).cast("long")})
    packed = packing.pack(pieces).collect()
    assert len(packed) == 40 and all(set(tuple(r)[3:14]) == {r["doc_id"]} for r in packed)
    import corpus_pipeline

    assert corpus_pipeline.mixed(spark, df, "").columns == df.columns


def test_mix_leaves_no_document_that_fits(spark):
    """Sources whose cut falls on a huge document and leaves room for very many small ones."""
    rows = [(i, "big", 500) for i in range(6)] + [(100 + i, "big", 1) for i in range(700)] + [(1000 + i, "other", 1 + i % 5) for i in range(300)] + [(5000 + i, None, 40) for i in range(10)] + [(6000, "none", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(4)
    got = mixing.mix(df, size_col="size", fill=2).collect()
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r["mix"])
    for s in by.values():
        gap = s[0]["target"] - sum(m["taken"] for m in s)
        whole = min((m["passes"] for m in s if m["size"]), default=0)
        assert gap >= -1e-6 and all(m["passes"] > whole or m["size"] > gap or m["passes"] >= 3 for m in s if m["size"])


def test_stages_called_alone_delete_nothing(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = corpus_pipeline.by_rules(spark, docs, sf)
    n = first.count()
    once = corpus_pipeline.without_near_duplicates(spark, docs, sf)
    corpus_pipeline.mixed(spark, docs, sf).count()
    assert first.count() == n and once.count() > 0
