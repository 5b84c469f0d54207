"""Ranked lexical search against a plain scan of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from glucoflow.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(rows, items, k=10):
    """Rows (item_id, rank, doc_id, score) by scoring everything."""
    docs = [(d, Counter(own), len(own)) for d, t in rows if (own := terms(t))]
    n_docs, n_all = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, tf, _ in docs for t in tf)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, tf, n in docs:
            m = 100 - 90 + 90 * n * n_docs // n_all
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in set(terms(text)) if tf[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, none, doc_id) in enumerate(sorted(scored)[:k], 1):
            out.append((item_id, rank, None if none else doc_id, -score))
    return Counter(out)


def result(df):
    return Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


ODD = [(50, "The THE the of"), (50, "The THE the of"), (51, "... !"), (52, "漢字 ß Ä unheard-of"), (53, "never_in_a document zzzqqq"), (None, "hot and cold")]


def test_against_plain(spark, docs, rows, items):
    items = items + ODD + [(54, rows[3][1]), (55, rows[2][1])]
    benchmark = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, score int")
    got = lexical.ranked(docs, benchmark)
    assert ", ".join(f"{c} {t.replace('bigint', 'long')}" for c, t in got.dtypes) == lexical.OUT
    want = plain([r[:2] for r in rows], items)
    assert result(got) == want and len(want) > 40


def test_blocks_of_items(spark, docs, rows, items, monkeypatch):
    monkeypatch.setattr(lexical, "ITEM_BLOCK_BYTES", 150)
    benchmark = spark.createDataFrame(items + ODD, "item_id long, text string")
    assert result(lexical.ranked(docs, benchmark)) == plain([r[:2] for r in rows], items + ODD)


def test_empty_tables(spark, docs, empty, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert lexical.ranked(empty, benchmark).collect() == []
    assert lexical.ranked(docs, benchmark.limit(0)).collect() == []


def test_terms():
    for text in (None, "", "A-b_c 1.2 Äö漢 x\x00y\x7fz", "Zz@[`{}~"):
        assert [t.decode() for t in lexical.terms_of(text)] == terms(text)


def made(seed, n_docs, n_items, n_terms, topics):
    """Documents and items as term lists; each is about one topic."""
    rng = random.Random(seed)
    pick = lambda: [rng.randrange(n_terms // topics) * topics + rng.randrange(topics) if rng.random() < 0.1 else rng.randrange(n_terms // topics) * topics + topic for _ in range(rng.randrange(1, 30))]
    out = []
    for size in (n_docs, n_items):
        rows = []
        for k in range(size):
            topic = k % topics
            rows.append((k, " ".join(f"t{t}" for t in pick())))
        out.append(rows)
    return out


@pytest.mark.parametrize(("seed", "k", "topics"), [(1, 1, 20), (2, 10, 20), (3, 3, 1), (4, 500, 5)])
def test_search_without_spark(seed, k, topics):
    """Hierarchies of several levels on both sides; floors and ties keep the result exact."""
    rows, items = made(seed, 1500, 130, 400, topics)
    wanted = [set(lexical.terms_of(t)) for _, t in items]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*wanted)))}
    vectors = [(d, len(own := lexical.terms_of(t)), Counter(vocabulary[x] for x in own if x in vocabulary)) for d, t in rows]
    held = Counter(t for _, _, tf in vectors for t in tf)
    n_all = sum(n for _, n, _ in vectors)
    weights = np.array([lexical.weight(len(rows), held[i]) for i in range(len(vocabulary))], np.int64)
    tree = lexical.Items([np.array(sorted(vocabulary[t] for t in w)) for w in wanted], weights)
    assert len(tree.levels) == 4
    batches = []
    for part in (vectors[:1100], vectors[1100:]):
        part = [v for v in part if v[2]]
        at = np.repeat(np.arange(len(part)), [len(v[2]) for v in part])
        term = np.array([t for v in part for t in v[2]])
        tf = np.array([x for v in part for x in v[2].values()])
        n = np.array([v[1] for v in part])
        batches.append(lexical.Batch([v[0] for v in part], at, term, lexical.impacts(weights[term], tf, n[at], len(rows), n_all), len(weights)))
    want = plain(rows, items, k)

    def outcome(state):
        out = Counter()
        for item_no in range(len(items)):
            own = sorted((-s, d) for i, d, s in state.rows() if i == item_no)[:k]
            out.update((item_no, r, d, -s) for r, (s, d) in enumerate(own, 1))
        return out

    seeds = lexical.Search(tree, k, np.zeros(len(items), np.int64))
    for b in batches:
        seeds.greedy(b)
    floors = np.array([h[0][0] if len(h) == k else 0 for h in seeds.best])
    for start in (np.zeros(len(items), np.int64), floors):
        state = lexical.Search(tree, k, start)
        for b in batches:
            state.full(b)
        assert outcome(state) == want


def test_whole_batches_are_pruned():
    """One document in a thousand holds an item: with the floors few others are scored."""
    rng = random.Random(2)
    rows = [(k, " ".join(f"t{rng.randrange(2000)}" for _ in range(30))) for k in range(4000)]
    wanted = [set(lexical.terms_of(rows[k * 100][1])) for k in range(20)]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*wanted)))}
    weights = np.full(len(vocabulary), 10, np.int64)
    own = [(d, Counter(vocabulary[x] for x in lexical.terms_of(t) if x in vocabulary)) for d, t in rows]
    own = [x for x in own if x[1]]
    at = np.repeat(np.arange(len(own)), [len(x[1]) for x in own])
    batch = lexical.Batch([x[0] for x in own], at, np.array([t for x in own for t in x[1]]), np.full(len(at), 10), len(vocabulary))
    tree = lexical.Items([np.array(sorted(vocabulary[t] for t in w)) for w in wanted], weights)
    seeds = lexical.Search(tree, 1, np.zeros(20, np.int64))
    seeds.greedy(batch)
    state = lexical.Search(tree, 1, np.array([h[0][0] for h in seeds.best]))
    state.full(batch)
    assert {(i, d) for i, d, _ in state.rows()} == {(k, k * 100) for k in range(20)}
    assert state.scored < 0.15 * len(own) * len(wanted)


def test_bounds_hold_every_score():
    rows, items = made(9, 300, 40, 90, 3)
    weights = np.arange(1, 91, dtype=np.int64)
    tree = lexical.Items([np.array(sorted({int(x[1:]) for x in t.split()})) for _, t in items], weights)
    own = [Counter(int(x[1:]) for x in t.split()) for _, t in rows]
    at = np.repeat(np.arange(len(rows)), [len(x) for x in own])
    batch = lexical.Batch([d for d, _ in rows], at, np.array([t for x in own for t in x]), np.array([v for x in own for v in x.values()]), 90)
    one = [tree.levels[-1].bounds(*batch.node(len(batch.levels) - 1, k)) for k in range(len(rows))]
    for level in range(len(batch.levels) - 1):
        width = lexical.LEAF * lexical.FAN ** (len(batch.levels) - 2 - level)
        for at_items in range(len(tree.levels)):
            span = lexical.FAN ** (len(tree.levels) - 1 - at_items)
            for k in range(len(batch.levels[level][0]) - 1):
                bound = tree.levels[at_items].bounds(*batch.node(level, k))
                for score in one[k * width : (k + 1) * width]:
                    assert (np.repeat(bound, span)[: tree.n] >= score).all()


def test_lengths_beyond_64_bits():
    n = np.array([1, 10**9], np.int64)
    part = lexical.impacts(np.array([7, 7]), np.array([1, 1]), n, 10**11, 10**13)
    assert part.tolist() == [7 * (10**9 // (1000 + 8 * (10 + 90 * int(x) * 10**11 // 10**13))) for x in n]
