"""Ranked lexical search (operator 12): dual-tree search, exact top k per item.

Documents become sparse vectors over the terms of the items: coordinate t of
a document is what term t adds to a score.  Each task builds a hierarchy over
its documents (batches of similar ones, then batches of batches) whose nodes hold
the largest value of every coordinate, and one over the items, whose nodes hold
the largest item coordinate, 1 for each term that an item below has.  The
product of two nodes bounds every score between them.  A pair of nodes is left
when that bound is under the weakest kth score of the node's items, so whole
batches go without a score being computed; nothing that could be in a result
is pruned (ties are not).

Two rounds over the vectors: the first goes down to the one most promising
leaf for each item and tree, and gives every item a floor that its kth score
reaches for certain; the second is the exact search from these floors.

Items come in blocks of at most about ``ITEM_BLOCK_BYTES`` of distinct text,
one after the other: a block's terms, their counts and its items' floors are
all that the driver and a task hold of it.  Nothing is left out for size.

* null and empty texts, and texts without a term, are in no result and not in
  N; an item without terms has no rows;
* repeated rows are documents, or items, of their own;
* documents without an id come after all others of equal score;
* extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glucoflow.llm.common import encode, in_batches, materialize, rows_of

TOP = 10
ITEM_BLOCK_BYTES = 1 << 20
#: documents of a leaf, children of a node, documents of a tree
LEAF, FAN, TREE = 8, 8, 4096
#: scores: scale of w, of a term's part, share of the length (percent), saturation
W_SCALE, PART_SCALE, LENGTH_PERCENT, TF_SCALE, M_SCALE = 1000, 1_000_000_000, 90, 1000, 8

#: every byte of a term as itself (A-Z lowered), all others as a space; bytes from 0x80 belong to terms
_TERM_BYTES = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in bytes(range(256)).lower())

OUT = "item_id long, rank int, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    """Terms ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` as UTF-8, only A-Z lowered."""
    return encode(text).translate(_TERM_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(W_SCALE * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(w: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term adds to a score: its weight, its occurrences, the document's terms."""
    if LENGTH_PERCENT * n_docs * int(n.max(initial=0)) < 1 << 63:
        length = LENGTH_PERCENT * n * n_docs // n_terms
    else:
        length = np.array([LENGTH_PERCENT * int(x) * n_docs // n_terms for x in n], np.int64)
    return w * (PART_SCALE * tf // (TF_SCALE * tf + M_SCALE * (100 - LENGTH_PERCENT + length)))


class Postings:
    """Nodes of one level of the item hierarchy by term."""

    def __init__(self, term: np.ndarray, node: np.ndarray, n_terms: int, n_nodes: int):
        order = np.argsort(term, kind="stable")
        self.node, self.n_nodes = node[order], n_nodes
        self.upto = np.searchsorted(term[order], np.arange(n_terms + 1))

    def meet(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(k, node) for every node that has term[k]."""
        start, size = self.upto[term], self.upto[term + 1] - self.upto[term]
        k = np.repeat(np.arange(len(term)), size)
        inside = np.arange(len(k)) - np.repeat(np.cumsum(size) - size, size)
        return k, self.node[start[k] + inside]

    def bounds(self, term: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Sum of the values of the terms that each node has (64-bit integers, exact)."""
        out = np.zeros(self.n_nodes, np.int64)
        k, node = self.meet(term)
        np.add.at(out, node, value[k])
        return out


class Items:
    """The items of a block, in an order that puts those with the same rare terms side by side."""

    def __init__(self, term_ids: list[np.ndarray], weights: np.ndarray):
        n_terms = len(weights)
        rare_first = [tuple(t[np.argsort(-weights[t], kind="stable")].tolist()) for t in term_ids]
        self.order = sorted(range(len(term_ids)), key=rare_first.__getitem__)
        flat = np.concatenate([term_ids[k] for k in self.order]) if self.order else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(self.order)), [len(term_ids[k]) for k in self.order])
        self.n = len(self.order)
        self.levels: list[Postings] = []  # from the single items up to one node
        width = 1
        while True:
            pair = np.unique(owner // width * n_terms + flat)
            self.levels.append(Postings(pair % n_terms, pair // n_terms, n_terms, -(-self.n // width)))
            if self.levels[-1].n_nodes <= 1:
                break
            width *= FAN
        self.levels.reverse()  # from the root down

    def weakest(self, scores: np.ndarray) -> list[np.ndarray]:
        """Least score of the items below each node, by level from the root down."""
        out = [scores]
        for level in self.levels[-2::-1]:
            out.append(np.minimum.reduceat(out[-1], np.arange(0, level.n_nodes * FAN, FAN)))
        return out[::-1]


class Batch:
    """A hierarchy over up to TREE documents: nodes hold the maxima of their coordinates."""

    def __init__(self, ids: list, rows: np.ndarray, term: np.ndarray, value: np.ndarray, n_terms: int):
        strongest = np.lexsort((term, -value, rows))
        first = strongest[np.searchsorted(rows[strongest], np.arange(len(ids)))] if len(rows) else []
        lead = [(int(term[k]), -int(value[k])) for k in first]
        order = sorted(range(len(ids)), key=lead.__getitem__)
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids = [ids[k] for k in order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at, width = place[rows], 1
        while True:
            key = at // width * n_terms + term
            by = np.argsort(key, kind="stable")
            new = np.flatnonzero(np.diff(key[by], prepend=-1))
            node = key[by][new] // n_terms
            n_nodes = -(-len(ids) // width)
            self.levels.append((np.searchsorted(node, np.arange(n_nodes + 1)), key[by][new] % n_terms, np.maximum.reduceat(value[by], new) if len(new) else value))
            if n_nodes <= 1 and width > 1:
                break
            width *= LEAF if width == 1 else FAN
        self.levels.reverse()  # from the root down; the last level is the documents

    def node(self, level: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        upto, term, value = self.levels[level]
        return term[upto[k] : upto[k + 1]], value[upto[k] : upto[k + 1]]

    def children(self, level: int, k: int) -> range:
        fan = LEAF if level + 2 == len(self.levels) else FAN
        return range(k * fan, min((k + 1) * fan, len(self.levels[level + 1][0]) - 1))


class Search:
    """The best k documents of every item, over any number of batches."""

    def __init__(self, items: Items, k: int, floors: np.ndarray):
        self.items, self.k = items, k
        self.best: list[list[tuple]] = [[] for _ in range(items.n)]
        self.scores = np.maximum(floors, 1)
        self.weakest = items.weakest(self.scores)
        self.scored = 0  # pairs of a document and an item

    def _score(self, batch: Batch, leaf: int, alive: np.ndarray) -> None:
        """Exact scores of a leaf's documents for the items that are alive."""
        level = len(batch.levels) - 2
        docs = batch.children(level, leaf)
        upto, term, value = batch.levels[-1]
        inside = slice(upto[docs.start], upto[docs.stop])
        row = np.repeat(np.arange(len(docs)), np.diff(upto[docs.start : docs.stop + 1]))
        k, item = self.items.levels[-1].meet(term[inside])
        scores = np.zeros((len(docs), self.items.n), np.int64)
        np.add.at(scores, (row[k], item), value[inside][k])
        self.scored += len(docs) * int(alive.sum())
        changed = False
        for d, i in zip(*np.nonzero((scores >= self.scores) & alive), strict=True):
            doc_id, heap = batch.ids[docs[d]], self.best[i]
            entry = (int(scores[d, i]), doc_id is not None, -(doc_id or 0))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            else:
                continue
            if len(heap) == self.k and heap[0][0] > self.scores[i]:
                self.scores[i], changed = heap[0][0], True
        if changed:
            self.weakest = self.items.weakest(self.scores)

    def _bounds(self, batch: Batch, level: int, k: int, at: int) -> np.ndarray:
        """Bound of a document node against every item node of a level."""
        return self.items.levels[at].bounds(*batch.node(level, k))

    def full(self, batch: Batch) -> None:
        """Both hierarchies from their roots down, the most promising documents first."""
        leaves, finest = len(batch.levels) - 2, len(self.items.levels) - 1

        def down(alive: np.ndarray, at: int) -> np.ndarray:
            return np.repeat(alive, FAN)[: self.items.levels[at].n_nodes]

        def visit(level: int, k: int, at: int, alive: np.ndarray, bounds: np.ndarray) -> None:
            alive = alive & (bounds >= self.weakest[at])
            while at < finest and (level == leaves or at < level) and alive.any():
                at += 1  # at a leaf, and while the documents are the finer side, only items go down
                alive = down(alive, at) & (self._bounds(batch, level, k, at) >= self.weakest[at])
            if not alive.any():
                return
            if level == leaves:
                self._score(batch, k, alive)
                return
            if at < finest:
                at += 1
                alive = down(alive, at)
            below = [(c, self._bounds(batch, level + 1, c, at)) for c in batch.children(level, k)]
            for c, b in sorted(below, key=lambda x: -int(x[1].max(where=alive, initial=0))):
                visit(level + 1, c, at, alive, b)

        visit(0, 0, 0, np.ones(self.items.levels[0].n_nodes, bool), self._bounds(batch, 0, 0, 0))

    def greedy(self, batch: Batch) -> None:
        """Scores of the one leaf that promises most to each item."""
        leaves, postings = len(batch.levels) - 2, self.items.levels[-1]

        def visit(level: int, k: int, alive: np.ndarray) -> None:
            if level == leaves:
                self._score(batch, k, alive)
                return
            children = batch.children(level, k)
            bounds = np.stack([postings.bounds(*batch.node(level + 1, c)) for c in children])
            choice = np.where(bounds.max(axis=0) > 0, bounds.argmax(axis=0), -1)
            for j, c in enumerate(children):
                if (wanted := alive & (choice == j)).any():
                    visit(level + 1, c, wanted)

        visit(0, 0, np.ones(self.items.n, bool))

    def rows(self) -> Iterator[tuple]:
        for i, heap in enumerate(self.best):
            for score, known, minus in heap:
                yield self.items.order[i], -minus if known else None, score


def batches_of(parts: Iterator[pa.RecordBatch], weights: np.ndarray, n_docs: int, n_all: int) -> Iterator[Batch]:
    """Vectors of a task as hierarchies of up to TREE documents."""
    ids, sizes, rows = [], [], ([], [], [])

    def made() -> Batch:
        at = np.repeat(np.arange(len(ids)), sizes)
        term, tf, n = (np.concatenate(x) for x in rows)
        return Batch(list(ids), at, term, impacts(weights[term], tf, n[at], n_docs, n_all), len(weights))

    for doc_id, n, term, tf in rows_of(parts, "doc_id", "n", "terms", "tfs"):
        if not term:
            continue
        ids.append(doc_id)
        sizes.append(len(term))
        for into, x in zip(rows, (term, tf, [n]), strict=True):
            into.append(np.array(x, np.int64))
        if len(ids) == TREE:
            yield made()
            ids, sizes, rows = [], [], ([], [], [])
    if ids:
        yield made()


_VECTOR = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])
_FOUND = pa.schema([("item_no", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms) and the occurrences of the vocabulary's terms, of documents with a term."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for doc_id, text in rows_of(batches, "doc_id", "text"):
                if own := terms_of(text):
                    tf = Counter(t for t in map(vocabulary.get, own) if t is not None)
                    yield doc_id, len(own), list(tf.keys()), list(tf.values())

        return in_batches(rows(), _VECTOR)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, n long, terms array<int>, tfs array<long>")


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each item, ranked; a limit per task comes before the shuffle."""
    order = Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_block(docs: DataFrame, wanted: list[set[bytes]], k: int) -> DataFrame:
    """(item_no, rank, doc_id, score): the best k documents for each set of terms."""
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*wanted)))}
    table = materialize(vectors(docs, vocabulary), "lexical-vectors")
    n_docs, n_all = table.agg(F.count("*"), F.sum("n")).first()
    held = dict(table.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
    weights = np.array([weight(n_docs, held.get(i, 0)) for i in range(len(vocabulary))], np.int64)
    term_ids = [np.array(sorted(vocabulary[t] for t in w), np.int64) for w in wanted]

    def search(floors: list[int], greedy: bool) -> DataFrame:
        def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(term_ids, weights)
            state = Search(items, k, np.array(floors, np.int64)[items.order])
            for batch in batches_of(parts, weights, n_docs, n_all):
                state.greedy(batch) if greedy else state.full(batch)
            return in_batches(state.rows(), _FOUND)

        return table.mapInArrow(scan, "item_no long, doc_id long, score long")

    floors = [0] * len(wanted)
    for item_no, score in best(search(floors, greedy=True), k).filter(F.col("rank") == k).select("item_no", "score").collect():
        floors[item_no] = score
    return best(search(floors, greedy=False), k)


def ranked(docs: DataFrame, benchmark: DataFrame, k: int = TOP) -> DataFrame:
    """The k best documents with a score above 0 for each row of benchmark (see OUT)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("text_key"), F.col("text").cast("string").alias("text"))
    texts = items.filter("text is not null").select("text_key", "text").dropDuplicates(["text_key"])
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(size / ITEM_BLOCK_BYTES))
    found = []
    for b in range(n_blocks):
        block = texts.filter(F.pmod(F.xxhash64("text_key"), F.lit(n_blocks)) == b).orderBy("text_key").collect()
        keys, wanted = [], []
        for key, text in block:
            if own := set(terms_of(text)):
                keys.append(key)
                wanted.append(own)
        if wanted:
            named = docs.sparkSession.createDataFrame(list(enumerate(keys)), "item_no long, text_key string")
            found.append(search_block(docs, wanted, k).join(named, "item_no"))
            if n_blocks > 1:  # one block at a time
                found[-1] = materialize(found[-1], "lexical-found")
    if not found:
        return docs.sparkSession.createDataFrame([], OUT)
    every = reduce(DataFrame.unionByName, found)
    return every.join(items.drop("text"), "text_key").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
