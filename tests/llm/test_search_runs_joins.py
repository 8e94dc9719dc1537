"""Ranked search, periodic runs and the n-gram join against brute force, and over odd rows."""

import collections
import hashlib
import math
import os
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlab.llm import jaccard, queries, runs, search
from pairlab.llm.common import shared_dir
from tests.llm.test_operators import LONG, ROWS, SF, lowered, none, odd  # noqa: F401

# Ranked search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))


def brute_ranking(docs, items, top):
    counts = [collections.Counter(terms(t)) for _, t in docs]
    n_docs, n_terms = sum(1 for c in counts if c), sum(sum(c.values()) for c in counts)
    df = collections.Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for (name, _), c in zip(docs, counts):
            m = 50 + 50 * sum(c.values()) * n_docs // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, name is None, name or 0))
        out += [(item, k, None if null else name, -s) for k, (s, null, name) in enumerate(sorted(found)[:top], 1)]
    return out


@pytest.mark.parametrize("options", [{}, {"block": 4, "short": 0.05, "shard_bytes": 3000}, {"block": 16, "short": 0.5, "top": 3, "query_bytes": 200}])
def test_search_equals_brute_force(spark, options):
    rng = random.Random(3)
    words = [f"{rng.choice('abcDÉß')}{i}" for i in range(80)]
    weights = [1 / (i + 1) for i in range(80)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([0, 1, 5, 20, 200])))) for i in range(150)]
    docs += [(3, docs[3][1]), (None, docs[5][1]), (None, docs[5][1]), (200, None), (201, ""), (202, LONG)]
    items = [(f"q{i}", " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 12])))) for i in range(25)] + [("none", None), ("far", "nothing of it"), ("q1", "a0 a0 b1")]
    rng.shuffle(docs)
    got = search.rank_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id string, text string"), **options).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(brute_ranking(docs, items, options.get("top", 50)))


def test_search_over_odd_rows(spark, odd, none):  # noqa: F811
    items = spark.createDataFrame([(1, "single one"), (2, None), (None, "eleven")], "item_id long, text string").withColumn("rank", F.lit("mine"))
    got = search.rank_documents(odd, items).collect()
    assert [(r.rank, r.doc_id) for r in sorted(got, key=lambda r: r.rank) if r.item_id is None] == [(1, 4), (2, 5), (3, 5)]
    assert collections.Counter(map(tuple, got)) == collections.Counter(brute_ranking([r[:2] for r in ROWS], [(1, "single one"), (2, None), (None, "eleven")], 50))
    assert search.rank_documents(none, items).count() == 0 and search.rank_documents(odd, items.where("false")).count() == 0


def test_norms_beyond_64_bits():
    n, docs, total = 10**7, 10**13, 10**15
    assert search.norms(np.array([n, 1]), docs, total).tolist() == [20 * (50 + 50 * n * docs // total), 20 * (50 + 50 * docs // total)]


# Periodic runs


def brute_runs(words, least=24, periods=3):
    names = {}
    w = np.array([names.setdefault(x, len(names)) for x in words], np.int64)
    found = {}
    for p in range(1, len(w) // periods + 1):
        same = np.concatenate([[0], w[p:] == w[:-p], [0]]).astype(np.int8)
        for s, e in zip(np.flatnonzero(np.diff(same) == 1).tolist(), np.flatnonzero(np.diff(same) == -1).tolist()):
            if e - s >= p:
                found.setdefault((s, e + p), p)
    return sorted((s, e - s, p) for (s, e), p in found.items() if e - s >= max(least, periods * p))


def brute_collapsed(words, found):
    return " ".join(x for i, x in enumerate(words) if not any(s + p <= i < s + n for s, n, p in found))


def test_runs_of_small_alphabets():
    rng = random.Random(5)
    for _ in range(300):
        docs = []
        for _ in range(rng.randint(1, 6)):
            n = rng.choice([0, 1, 3, 30, 80, 120])
            w = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = rng.randint(1, max(1, (n - a) // 3))
                w = w[:a] + [w[a + i % p] for i in range(n - a)]
            docs.append(w)
        least = rng.choice([4, 24])
        got = runs.runs_of(np.array(sum(docs, []), np.uint64), np.cumsum([0, *map(len, docs)]), least)
        want = [(d, *r) for d, w in enumerate(docs) for r in brute_runs(w, least)]
        assert [tuple(r) for r in got.tolist()] == sorted(want, key=lambda r: (r[0], r[1], r[3]))


@pytest.mark.parametrize("words", [[0] * 30_000, [i % 700 for i in range(30_000)], [bin(i).count("1") % 2 for i in range(30_000)]])
def test_runs_of_long_texts(words):
    got = runs.runs_of(np.array(words, np.uint64), np.array([0, len(words)]))
    assert [tuple(r[1:]) for r in got.tolist()] == {1: [(0, 30_000, 1)], 700: [(0, 30_000, 700)], 2: []}[len(set(words))]


def test_runs_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, SF).collect()}
    seen = 0
    for r in docs:
        words, h = re.findall(r"[^\x20\x09-\x0D]+", r.text or ""), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and words:
            g = h // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]
        found = brute_runs(words)
        best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None, None, None))
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in sorted(found, key=lambda x: (x[0], x[2])))
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, brute_collapsed(words, found))]
        milli = best[0] if best[0] is None else 1000 * best[1] // best[2]
        assert tuple(got[r.doc_id]) == (r.doc_id, len(found), *best, milli, *digest)
        seen += bool(found)
    assert seen > 10 and len(got) == len(docs)


def test_runs_over_odd_rows(odd, none):  # noqa: F811
    got = runs.find_runs(odd.withColumns({"runs": F.lit(1), "Collapsed": F.lit("mine")})).collect()
    assert len(got) == len(ROWS) and all(r.word == "mine" for r in got)
    for r in got:
        words = (r.text or "").split()
        found = [tuple(x) for x in r.runs]
        assert found == sorted(brute_runs(words), key=lambda x: (x[0], x[2])) and r.collapsed == brute_collapsed(words, found)
    assert any(r.runs for r in got) and runs.find_runs(none).count() == 0


# N-gram join


def shingles(text):
    words = lowered(text).encode().split()
    return frozenset([b" ".join(words)] if 0 < len(words) < 5 else (b" ".join(words[i : i + 5]) for i in range(len(words) - 4)))


def brute_classes(rows):
    sets, head = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for k, s in enumerate(sets):
        for j in range(k):
            both = len(s & sets[j])
            if both and 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                head[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return collections.Counter((i, len(s), least.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets)))


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(11)
    vocabulary, rows = [f"w{i}" for i in range(60)], []
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 6, 10, 40, 100, 300]))]
        if rng.random() < 0.3:
            base += passage
        for _ in range(rng.choice([1, 2, 3, 30])):
            w = list(base)
            for _ in range(rng.randint(0, len(w) // 30)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w[: len(w) * 9 // 10] if rng.random() < 0.3 else w)))
    n = len(rows)
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "Abc"), (n + 4, "abc"), (None, "abc"), (n + 4, "abc"), (n + 5, LONG), (n + 6, LONG + " more")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"part_docs": 7, "block_bytes": 3000}, {"part_shingles": 500, "part_docs": 4}])
def test_join_equals_brute_force(spark, copies, options):
    df = spark.createDataFrame(copies, "doc_id long, text string").repartition(3)
    assert collections.Counter(map(tuple, jaccard.similar_documents(df, **options).collect())) == brute_classes(copies)
    assert not [x for x in spark.catalog.listTables() if x.name.startswith("shingle_blocks")]


def test_links_just_at_the_threshold(spark):
    words = [f"a{i}" for i in range(40)]
    rows = [(1, " ".join(words[:13])), (2, " ".join(words[:12] + ["x"])), (3, " ".join(words[:14])), (4, " ".join(words[:12] + ["x", "y"])), (5, " ".join(words[20:30])), (6, " ".join(words[21:31] + words[20:21]))]
    assert collections.Counter(map(tuple, jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute_classes(rows)


def test_search_of_lists_equals_counting():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.choice(rng.choice([30, 60]), rng.integers(1, 40))) for _ in range(200)]
    sizes = np.array([len(s) for s in sets])
    index = jaccard.Lists(sets, sizes)
    for q in range(0, 200, 7):
        both = np.array([len(np.intersect1d(sets[q], s)) for s in sets])
        assert index.partners(sets[q], len(sets[q]), np.zeros(200, bool)).tolist() == np.flatnonzero(5 * both >= 4 * (sizes + len(sets[q]) - both)).tolist()


def test_join_over_odd_rows(odd, none):  # noqa: F811
    assert collections.Counter(map(tuple, jaccard.similar_documents(odd).collect())) == brute_classes([r[:2] for r in ROWS])
    assert jaccard.similar_documents(none).count() == 0


def test_a_file_of_the_index_has_one_shard(spark):
    docs = spark.range(40, numPartitions=2).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.repeat(F.col("id").cast("string"), 100)).alias("text"))
    queries = spark.createDataFrame([("q", "word")], "item_id string, text string")
    before = set(os.listdir(where := shared_dir(spark).removeprefix("file:")))
    assert search.rank_documents(docs, queries, shard_bytes=1000).count() == 40
    (new,) = (x for x in set(os.listdir(where)) - before if x.startswith("search-index"))
    shards = spark.read.parquet(f"{where}/{new}").groupBy(F.input_file_name()).count().collect()
    assert len(shards) > 2 and {r["count"] for r in shards} == {1}
