"""Ranked search against plain Python over hard tables, and the tree's bounds."""

import math
import random
from collections import Counter

import fixtures as fx
import numpy as np
import pytest

from corpuswright.llm.balltree import BallTree
from corpuswright.llm.search import rank_documents, saturated


def ranked(docs, items, top):
    """{item: [(rank, doc, score)]} of (id, text) rows by scoring everything."""
    bags = [(i, Counter(fx.words(t, fx.ALNUM_WORD))) for i, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    terms = {}
    for i, t in items:
        terms.setdefault(i, set()).update(fx.words(t, fx.ALNUM_WORD))
    out = {}
    for item, own in terms.items():
        found = []
        for i, bag in bags:
            score = 0
            for t in own & set(bag):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 50 + 50 * sum(bag.values()) * n_docs // n_terms
                score += w * (1_000_000_000 * bag[t] // (1000 * bag[t] + 20 * m))
            if score > 0:
                found.append((-score, i is not None, i or 0))
        out[item] = [(k + 1, i if known else None, -s) for k, (s, known, i) in enumerate(sorted(found)[:top])]
    return {k: v for k, v in out.items() if v}


def collected(df):
    out = {}
    for r in df.orderBy("item_id", "rank").collect():
        out.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    return out


ITEM_SCHEMA = "item_id long, text string, score long, doc_id string, terms int"


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocabulary = [f"W{k}" for k in range(60)] + ["Äß", "x1", "common"]
    docs = [(r[0], r[1]) for r in fx.hard_rows()]
    docs += [(100 + k, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 80))) + ("," if k % 2 else " common")) for k in range(150)]
    docs += [(400 - k, "W1 W2, W3 common-words") for k in range(70)]  # ties
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 12)))) for k in range(12)]
    items += [(12, None), (13, ""), (14, "of no document at all"), (None, "W1 w2"), (3, "W5 W6 extra"), (15, fx.hard_rows()[0][1]), (2, items[2][1])]
    return docs, items


@pytest.mark.parametrize("limits", [{}, {"shard_rows": 7, "block_items": 4}, {"shard_entries": 40, "block_terms": 20, "top": 3}])
def test_ranks_are_those_of_scoring_everything(spark, corpus, limits):
    docs, items = corpus
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, item_id int").repartition(5)
    wanted = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in items], ITEM_SCHEMA)
    assert collected(rank_documents(table, wanted, **limits)) == ranked(docs, items, limits.get("top", 50))


def test_ids_of_other_types_and_empty_tables(spark, corpus):
    docs, items = corpus
    named = [(None if i is None else f"n{i:04}", t) for i, t in docs]
    table = spark.createDataFrame(named, "doc_id string, text string").repartition(2)
    wanted = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in items], ITEM_SCHEMA)
    got = collected(rank_documents(table, wanted, top=5))
    want = ranked(docs, items, 5)
    assert {k: [(r, s) for r, _, s in v] for k, v in got.items()} == {k: [(r, s) for r, _, s in v] for k, v in want.items()}
    none = spark.createDataFrame([], ITEM_SCHEMA)
    assert rank_documents(table, none).count() == 0
    assert rank_documents(table.limit(0), wanted).count() == 0
    assert rank_documents(table.where("text is null"), wanted).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_no_bound_lies_below_a_score_and_leaves_are_passed_over(seed):
    rng = np.random.default_rng(seed)
    rows, width = 900, 80
    # clusters, as copies make them
    centre = rng.integers(0, width, (12, 8))
    picks = [np.unique(np.concatenate((centre[k % 12], rng.integers(0, width, 2)))) for k in range(rows)]
    indptr = np.concatenate(([0], np.cumsum([len(p) for p in picks])))
    columns = np.concatenate(picks)
    values = rng.integers(1, 1_000_000, len(columns))
    tree = BallTree(indptr, columns, values, leaf=16)
    dense = np.zeros((rows, width), np.int64)
    dense[np.repeat(np.arange(rows), np.diff(indptr)), columns] = values
    assert sorted(tree.order.tolist()) == list(range(rows))
    looked = 0
    for k in range(12):
        own = np.unique(centre[k])
        weights = rng.integers(0, 25_000, len(own))
        score = dense[:, own] @ weights
        bound = tree.bounds(np.searchsorted(tree.used, own), weights)
        for (a, b), upper in zip(tree.spans, bound):
            assert score[tree.order[a:b]].max() <= upper
        best: list = []

        def found(rows_, scores):
            best.extend(scores.tolist())
            best.sort(reverse=True)
            del best[10:]

        tree.scored = 0
        tree.search(own, weights, lambda: best[-1] if len(best) == 10 else 1, found)
        assert best == sorted(score[score > 0].tolist(), reverse=True)[:10]
        looked += tree.scored
    assert looked < 12 * rows


def test_entries_of_very_long_documents_are_exact():
    n, tf = np.array([10**9, 7]), np.array([10**6, 3])
    documents, terms = 10**10, 10**12
    want = [10**9 * t // (1000 * t + 20 * (50 + 50 * int(k) * documents // terms)) for k, t in zip(n, tf.tolist())]
    assert saturated(tf, n, documents, terms).tolist() == want
