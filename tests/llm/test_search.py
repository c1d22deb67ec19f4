"""Centroids, ranked search and byte-level BPE against brute force, and their edge cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from marlspike.llm import bpe, centroids, lexical, queries
from marlspike.llm.common import Scratch

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- 11 centroids


def brute_means(rows, k, rounds, dim, scale, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    places = [list(v) for _, _, v in sorted((digest(i), v, v) for i, v in kept if i is not None)[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(places))
    for _ in range(rounds):
        mine = {}
        for _, v in kept:
            mine.setdefault(nearest(v)[1], []).append(v)
        for j, vs in mine.items():
            places[j] = [sum(x) // len(vs) for x in zip(*vs)]
    return sorted(((i, *reversed(nearest(v))) for i, v in kept), key=repr), places


VECTORS = "vec_id long, embedding array<float>, label int"


def of_vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)


@pytest.mark.parametrize("grid", [False, True])
def test_centroids_against_brute_force(spark, grid):
    rnd = random.Random(3)
    value = (lambda: rnd.randrange(-2, 3) / 4) if grid else (lambda: rnd.gauss(0, 1))  # the grid gives ties
    rows = [(i, [value() for _ in range(4)]) for i in range(400)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows] + [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1])]
    got, places = centroids.sort_means(of_vectors(spark, rows), clusters=12, rounds=3, dimensions=4)
    want, want_places = brute_means(rows, 12, 3, 4, 256, 2)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert places == want_places


def test_vectors_that_are_left_out_and_huge_ones(spark):
    bad = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [1.0, math.nan]), (6, [math.inf, 0.0])]
    rows = [*bad, (8, [0.0, 0.0]), (9, [3e38, -3e38]), (10, [0.5, -0.001])]
    got, places = centroids.sort_means(of_vectors(spark, rows), clusters=2, rounds=2, dimensions=2)
    assert {r.vec_id for r in got.collect()} == {8, 9, 10} and len(places) == 2
    assert max(abs(x) for c in places for x in c) <= centroids.LARGEST
    fewer, places = centroids.sort_means(of_vectors(spark, rows[:7]), clusters=40, rounds=2, dimensions=2)
    assert [tuple(r) for r in fewer.collect()] == [(8, 0, 0)] and places == [[0, 0]]


def test_no_vectors(spark):
    got = centroids.with_inertia(*centroids.sort_means(of_vectors(spark, [(1, None)])))
    assert got.collect() == [] and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    only_null = centroids.sort_means(of_vectors(spark, [(None, [1.0])]), dimensions=1)
    assert only_null[0].collect() == [] and only_null[1] == []


def test_scan_stops_early_and_sees_ties():
    rng = np.random.default_rng(1)
    middles = rng.integers(-5000, 5000, (30, 8))
    vectors = np.repeat(middles, 50, axis=0) + rng.integers(-20, 20, (1500, 8))
    others, gaps = centroids.neighbours(middles)
    before, _, many = centroids.assign(vectors, np.zeros(1500, int), middles, others, gaps)
    again, distance, few = centroids.assign(vectors, before, middles, others, gaps)
    assert (again == np.repeat(np.arange(30), 50)).all() and few < 1500 * 3 < many
    assert (distance == ((vectors - middles[again]) ** 2).sum(axis=1)).all()
    pair = np.array([[0, 0], [2, 0]])
    for start in (0, 1):  # exactly twice the distance away: the smaller number
        assert centroids.assign(np.array([[1, 0]]), np.array([start]), pair, *centroids.neighbours(pair))[0][0] == 0
    big = pair * centroids.EXACT * 8
    assert centroids.assign(np.array([[1, 0]]), np.array([1]), big, *centroids.neighbours(big))[1][0] == 1


def test_clashing_columns_of_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0], 5, "x"), (2, [2.0], 6, "y")], "vec_id int, embedding array<double>, cluster int, distance string")
    assert sorted(map(tuple, centroids.sort_means(rows, dimensions=1)[0].collect())) == [(1, 0 if first_of(1, 2) else 1, 0), (2, 1 if first_of(1, 2) else 0, 0)]


def first_of(a, b):
    return hashlib.sha256(f"2:{a}".encode()).hexdigest() < hashlib.sha256(f"2:{b}".encode()).hexdigest()


# ---------------------------------------------------------------- 12 lexical


def brute_search(docs, items, k):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    counts = [(i, Counter(fold(t))) for i, t in docs]
    n, total = sum(1 for _, c in counts if c), sum(c.total() for _, c in counts)
    holding = Counter(t for _, c in counts for t in c)
    wanted: dict = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(fold(t))
    out = []
    for item, terms in wanted.items():
        found = []
        for i, c in counts:
            m = 10 + 90 * c.total() * n // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * holding[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i, score))
        out += [(item, r + 1, f[3], f[4]) for r, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def made_up(n, words=300, seed=5):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    return [(i, " ".join(rnd.choices(vocabulary, [1 / (j + 1) for j in range(words)], k=rnd.randrange(1, 60)))) for i in range(n)]


def searched(spark, docs, items, kind="item_id long, text string", block=4, **how):
    scratch = Scratch(spark, "t")
    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), scratch, block)
    got = lexical.search(index, spark.createDataFrame(items, kind), scratch, **how)
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in got.collect()), key=repr)


def test_search_against_brute_force(spark):
    docs = made_up(300)
    docs += [(1000 + i, docs[5][1]) for i in range(40)] + [(5, docs[5][1]), (None, docs[5][1]), (None, None), (2000, ""), (2001, "-- !!"), (2002, "W1 w1\tÄ w1é Ä_É")]
    items = [(1, docs[5][1]), (2, docs[7][1] + " W9"), (3, "w1 w1 Ä"), (4, None), (5, ""), (6, "nowhere"), (7, "w299 é"), (None, "w2 w3"), (None, "w4"), (7, "w298")]
    want = brute_search(docs, items, 10)
    assert searched(spark, docs, items) == want
    assert searched(spark, docs, items, first=1, shard_items=2) == want
    assert searched(spark, docs, items, block=1, shard_bytes=60) == want
    assert searched(spark, docs, items, block=64, k=3) == brute_search(docs, items, 3)


def test_search_over_little(spark):
    assert searched(spark, [], [(1, "a")]) == []
    assert searched(spark, [(1, "a b")], []) == []
    assert searched(spark, [(1, None)], [(1, "a")]) == []
    assert searched(spark, [(3, "a"), (2, "b")], [("x", "a b")], "item_id string, text string") == brute_search([(3, "a"), (2, "b")], [("x", "a b")], 10)


def test_search_in_a_long_text(spark):
    docs = [(1, "needle " + "hay " * 400_000), *((i, "hay stack") for i in range(2, 50)), (60, "needle")]
    assert searched(spark, docs, [(1, "needle stack")]) == brute_search(docs, [(1, "needle stack")], 10)


def test_columns_with_the_index_names(spark):
    docs = spark.createDataFrame([(1, "a", 3, "x"), (2, "b a", 4, "y")], "doc_id int, text string, block int, terms string")
    items = spark.createDataFrame([(9, "b", 1.0)], "item_id int, text string, score double")
    scratch = Scratch(spark, "t")
    assert [tuple(r) for r in lexical.search(lexical.build(docs, scratch), items, scratch).select("item_id", "rank", "doc_id").collect()] == [(9, 1, 2)]


def test_blocks_below_the_threshold_are_skipped(spark, monkeypatch):
    """Documents of two vocabularies that lie apart: few blocks reach the best score of an item."""
    docs = [(i, f"left{i % 7} left{i % 11} common") for i in range(400)] + [(1000 + i, f"right{i % 7} right{i % 11} common") for i in range(400)] + [(i, "left3 left5 rare") for i in range(5000, 5012)]
    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), Scratch(spark, "t"), 8)
    query = lexical.Query([{"left3": 2000, "rare": 4000, "left5": 2000}], 10)
    rows = index.blocks.toArrow().to_batches()
    bounds = np.concatenate([w.bounds()[:, 0] for w in lexical._windows(rows, query, 256)])
    scores = np.concatenate([w.scores(r, np.array([0]))[:, 0] for w in lexical._windows(rows, query, 256) for r in range(w.batch.num_rows)])
    least = np.sort(scores)[-10]
    assert (bounds >= least).sum() <= 3 < len(bounds) // 10
    for w in lexical._windows(rows, query, 256):
        assert all(w.scores(r, np.array([0])).max() <= b for r, b in enumerate(w.bounds()[:, 0]))


# ---------------------------------------------------------------- 13 BPE


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return bpe.Codec(*vocabulary()).encoding


TRICKY = [
    "", None, " ", "a", "  \n\n  x", "it's we'RE they're 'll''ve", "naïve 東京タワー 12 345", "a" * 900, "\n" * 700 + "b", " " * 501 + "x" + " " * 300, "x\n\ny " * 200, "'re" * 400, "don't " * 300,
    "１２３" * 250 + "ア" * 300, "<|endoftext|> " * 60, "👩‍👩‍👧 é ​﻿" * 90, "\x00\x1c\x85 \t" * 120, "a1!" * 333, ("word " * 40 + "w" * 300 + " ") * 5, "".join(map(chr, range(1, 0xD7FF, 7))),
]


def encoded(spark, texts, **how):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = bpe.decode(bpe.encode(rows, *vocabulary(), **how), *vocabulary())
    return {r.doc_id: (r.ids, bytes(r.decoded)) for r in got.collect()}


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 16), (50, 50), (257, 9), (32_768, 1024)])
def test_encoding_against_the_library(spark, library, chunk, overlap):
    rnd = random.Random(chunk)
    mixed = ["".join(rnd.choices(["a", "Ab", " ", "  ", "\n", "'s", "'", "!", "1", "é", "東", "\t "], k=1200)) for _ in range(8)]
    texts = TRICKY + mixed
    got = encoded(spark, texts, chunk=chunk, overlap=overlap)
    for i, t in enumerate(texts):
        assert got[i] == (library.encode_ordinary(t or ""), (t or "").encode()), (i, (t or "")[:30])


def test_digits_by_threes_never_agree_by_chance(spark, monkeypatch):
    """A pattern whose boundaries depend on where a run begins: chunks agree with each other, but not with the text."""
    import tiktoken

    path, _ = vocabulary()
    pattern = r"\p{N}{1,3}|\p{L}+|[^\p{N}\p{L}]+"
    rows = spark.createDataFrame([(1, "ab" + "1234567890" * 120 + " end"), (2, "7" * 1000)], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in bpe.encode(rows, path, pattern, chunk=63, overlap=12).collect()}
    own = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks={v: k for k, v in bpe.Codec(path, pattern).bytes_of.items()}, special_tokens={})
    assert got == {r.doc_id: own.encode_ordinary(r.text) for r in rows.collect()}


def test_long_texts_and_repeated_rows(spark, library):
    long = "Sentence number one, and a 2nd; it's fine.\n" * 5000
    rows = spark.createDataFrame([(1, long, "a"), (1, long, "b"), (None, long + "x", "c"), (None, None, "d"), (2, "y", "e")], "doc_id long, text string, ids string")
    got = sorted(((r.doc_id or 0, len(r.ids), hash(tuple(r.ids))) for r in bpe.encode(rows, *vocabulary()).collect()))
    want = [(r.doc_id or 0, library.encode_ordinary(r.text or "")) for r in rows.collect()]
    assert got == sorted((i, len(ids), hash(tuple(ids))) for i, ids in want)


def test_no_rows_and_wrong_chunks(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(none, *vocabulary()).collect() == []
    with pytest.raises(ValueError):
        bpe.encode(none, *vocabulary(), chunk=10, overlap=20)


def test_bpe_query(spark, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op13_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode_ordinary(r.text or "")
        assert got[r.doc_id] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
