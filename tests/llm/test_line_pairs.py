"""Line dedup against the alignment of all pairs of documents."""

import random
from collections import defaultdict

from glucoflow.llm import linededup
from glucoflow.llm.common import importable


def all_pairs(rows: list[tuple]) -> dict[int, set[int]]:
    """Numbers of the lines to delete, by id, from the alignment of every two documents."""
    made = {d: linededup.line_keys(t) for d, t in rows}
    gone = defaultdict(set)
    for b, (keys, n) in made.items():
        for a in made:
            if a < b:
                gone[b] |= set(linededup.common_blocks(made[a][0], keys, n))
    return gone


def check(spark, rows: list[tuple]) -> dict[int, set[int]]:
    docs = importable(spark).createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r["doc_id"]: r["kept_text"] for r in linededup.line_dedup(docs).collect()}
    want = all_pairs(rows)
    for d, t in rows:
        assert kept[d] == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[d]), d
    return want


def test_block_whose_lines_were_first_seen_apart(spark):
    block = ["one two three", "four five six", "seven eight nine"]
    rows = [(k, f"own {k} text of it\n{x}") for k, x in enumerate(block)]
    rows += [(k, "\n".join([f"head {k} of it", *block, f"tail {k}"])) for k in range(10, 30)]
    want = check(spark, rows)
    assert all(want[k] == {1, 2, 3} for k in range(11, 30))


def test_block_of_short_lines(spark):
    block = "a b\nc\nd e\nf g\n\nh i"
    want = check(spark, [(k, f"{k} x\n{block}\n{k} y") for k in range(9)])
    assert all(want[k] == {1, 2, 3, 4, 5, 6} for k in range(1, 9))


def test_random_lines(spark):
    rng = random.Random(5)
    pool = ["", "a", "b c", "d e f", "g h i j", "k l m n o p q r", "s t u v w x y z a b", "c d e f g h i j k"]
    rows = []
    for k in range(80):
        x = [rng.choice(pool) for _ in range(rng.randrange(1, 9))]
        x.insert(rng.randrange(len(x) + 1), f"own {k}")
        rows.append((k, "\n".join(x)))
    want = check(spark, rows)
    assert sum(map(len, want.values())) > 100
