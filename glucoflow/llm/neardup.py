"""Near-duplicate documents by fast similarity sketching (operator 8).

1. A document's set of word shingles gets a sketch of ``COORDINATES`` places.
   In round r every element is hashed to a place and a value r + u; a place
   keeps its least value.  In the first rounds the place is random, afterwards
   it is the round's own number, so every place fills after at most twice as
   many rounds, and the share of equal places concentrates around the Jaccard
   similarity.
2. Equal sets are one class (128-bit digest, 64 bits of it name the class).
3. Bands of the sketch are buckets.  A bucket's members are compared with its
   pivot, the member that shares most buckets, not with each other, so work is
   linear in the bucket.  Links are confirmed on the full sets.
4. Buckets whose members, the pivot aside, still lie in different components are
   open.  Of these members, the pairs of different components that pass an exact
   prefix filter are compared too.  So every pair that shares a bucket is linked,
   connected or refuted.
5. Components of classes come from alternating star operations on tables; ids
   join them at the end, by the classes of their rows.

With 32 bands of 4 places a pair at similarity 0.85 misses all buckets with a
probability of 6e-11, at 0.8 of 5e-8.

Defined results: null or empty text has no set, is linked with nothing and is
kept; a null id is never linked (null component, kept); rows that repeat an id
are one node, with the links of all its texts; other columns are not read; an
empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glucoflow.llm.common import encode, in_batches, materialize, rows_of
from glucoflow.llm.components import components
from glucoflow.llm.hashing import mix, shingles

BANDS = 32
ROWS = 4
COORDINATES = BANDS * ROWS
#: a set is hot with more than this share of the rows (1 / HOT); so there are at most HOT such sets
HOT = 10_000
#: bits of a filter of wanted keys, sent to every task (1 MiB)
BITS = 1 << 23

_ROUND_KEYS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_BAND_KEYS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def sketch(elements: np.ndarray) -> np.ndarray:
    """The sketch of a non-empty set of 64-bit elements: COORDINATES values."""
    t = COORDINATES
    least = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    done = 0
    while done < 2 * t and (least == np.iinfo(np.uint64).max).any():
        # a few rounds at once; later rounds never change a filled place
        rounds = np.arange(done, min(2 * t, done + max(1, (2 * t) // len(elements))))
        h = mix(elements[None, :] ^ _ROUND_KEYS[rounds][:, None])
        place = ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
        place = np.where(rounds[:, None] < t, place.astype(np.int64), rounds[:, None] - t)
        value = (rounds.astype(np.uint64)[:, None] << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        np.minimum.at(least, place.ravel(), value.ravel())
        done = int(rounds[-1]) + 1
    return least


def band_keys(places: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per band."""
    key = _BAND_KEYS.copy()
    for column in mix(places.reshape(BANDS, ROWS)).T:
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + column)
    return key


def lower_ascii(text: str | None) -> bytes:
    return encode(text).lower()


_SET_ROW = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.int64()), ("buckets", pa.list_(pa.int64()))])
_TOKEN_ROW = pa.schema([("set_key", pa.int64()), ("elements", pa.list_(pa.int64()))])


def set_key(elements: np.ndarray) -> int:
    """Name of a set: 64 bits of the digest of its sorted elements."""
    return int.from_bytes(hashlib.blake2b(elements.tobytes(), digest_size=16).digest()[:8], "little", signed=True)


def sets(docs: DataFrame, width: int) -> DataFrame:
    """Per document row: set size, name of the set, bucket keys (null without a set)."""

    def one(doc_id: int, text: str | None) -> tuple:
        elements = shingles(lower_ascii(text), width)
        if not len(elements):
            return doc_id, 0, None, None
        return doc_id, len(elements), set_key(elements), band_keys(sketch(elements)).view(np.int64)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches((one(d, t) for d, t in rows_of(batches, "doc_id", "text")), _SET_ROW, 1024)

    return _texts(docs).mapInArrow(rows, "doc_id long, n_shingles long, set_key long, buckets array<long>")


def element_sets(docs: DataFrame, width: int) -> DataFrame:
    """Per document row: the name of its set and all its element hashes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = (shingles(lower_ascii(t), width) for (t,) in rows_of(batches, "text"))
        return in_batches(((set_key(x), x.view(np.int64)) for x in made), _TOKEN_ROW, 256)

    return docs.mapInArrow(rows, "set_key long, elements array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _confirmed(pairs: DataFrame, elements: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach num/den.

    Sets meet their pairs by a sort-merge join at every size, so that what is
    moved grows evenly.
    """
    left = elements.select(F.col("set_key").alias("a"), F.col("elements").alias("of_a"))
    right = elements.select(F.col("set_key").alias("b"), F.col("elements").alias("of_b"))
    joined = pairs.hint("merge").join(right.hint("merge"), "b").hint("merge").join(left.hint("merge"), "a")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - shared
    return joined.filter(den * shared >= num * union).select("a", "b")


def _likely(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in wanted, and few others: what is left to a join is little.

    Keys are hashed to BITS bits, and the words that have some are sent to the
    tasks; with 1 wanted key in 10 bits, about 1 in 10 of the other rows stays.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(BITS))
    word, bit = F.shiftright("_slot", 6).alias("_word"), F.col("_slot").bitwiseAND(63).cast("int").alias("_bit")
    words = wanted.select(slot.alias("_slot")).select(word, bit).groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits"))
    placed = rows.withColumn("_slot", slot).select(*rows.columns, word, bit)
    return placed.join(F.broadcast(words), "_word").filter(F.getbit("_bits", F.col("_bit")) == 1).select(*rows.columns)


def links(docs: DataFrame, classes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Confirmed links (a, b) between classes, enough for every component.

    classes: set_key, doc_id (one whose row has the set), n_shingles, buckets.
    """
    # counting reads set_key, so that both sides of the join are the same exchange
    members = classes.select("set_key", F.explode("buckets").alias("bucket")).repartition("bucket")
    sizes = members.groupBy("bucket").agg(F.count("set_key").alias("in_bucket")).filter("in_bucket > 1")
    shared = materialize(members.join(sizes, "bucket"), "buckets")

    central = shared.groupBy("set_key").agg(F.sum("in_bucket").alias("weight"))
    wanted = materialize(classes.select("set_key", "doc_id", "n_shingles").join(central, "set_key"), "wanted")
    ranked = shared.select("bucket", "set_key").join(central, "set_key")
    pivots = ranked.groupBy("bucket").agg(F.max(F.struct("weight", "set_key")).alias("top")).select("bucket", F.col("top.set_key").alias("pivot"))
    others = materialize(shared.join(pivots, "bucket").filter("set_key <> pivot").select("bucket", "set_key", "pivot"), "others")
    size_a, size_b = (wanted.select(F.col("set_key").alias(k), F.col("n_shingles").alias(f"n_{k}")) for k in "ab")
    pairs = others.select(F.col("set_key").alias("a"), F.col("pivot").alias("b")).distinct().join(size_a, "a").join(size_b, "b")
    pairs = materialize(pairs.filter(den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b")).select("a", "b"), "pairs")

    # rows of these ids may have other sets too, when an id repeats
    texts = _likely(_texts(docs), wanted, "doc_id")
    elements = materialize(element_sets(texts, width).join(wanted.select("set_key"), "set_key", "left_semi").dropDuplicates(["set_key"]), "elements")
    first = materialize(_confirmed(pairs, elements, num, den), "confirmed")
    open_ = _open_sets(others, wanted, first, elements)
    return first.unionByName(_confirmed(_open_pairs(open_, num, den), open_, num, den))


def _open_sets(others: DataFrame, wanted: DataFrame, found: DataFrame, elements: DataFrame) -> DataFrame:
    """(set_key, n, component, elements) of the members of open buckets.

    A pivot was compared with all members of its bucket, so only the others
    (bucket, set_key, pivot) can have links that nobody looked for.
    """
    of = components(found)
    placed = others.join(of.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("component", F.coalesce("component", "set_key"))
    spread = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("bucket")
    sized = wanted.select("set_key", F.col("n_shingles").alias("n"))
    open_ = materialize(placed.join(spread, "bucket").select("set_key", "component").distinct().join(sized, "set_key"), "open")
    return materialize(_likely(elements, open_, "set_key").join(open_, "set_key").select("set_key", "n", "component", "elements"), "open-elements")


def _open_pairs(open_: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of open sets, in different components, that could reach num/den.

    Exact prefix filter: sets of x and y elements need an overlap of
    o = num (x + y) / (num + den).  With the elements of all sets in one order,
    rare ones first, the first x - o + 1 and the first y - o + 1 elements then
    have one in common.  Elements that no other open member has come first and
    are only counted; a set with too many of them is settled at once.
    """
    # counting reads set_key here too
    token = open_.select("set_key", F.explode("elements").alias("element")).repartition("element")
    twice = token.groupBy("element").agg(F.count("set_key").alias("df")).filter("df > 1")
    ranked = token.join(twice, "element").groupBy("set_key").agg(F.array_sort(F.collect_list(F.struct("df", "element"))).alias("common"))
    ranked = ranked.join(open_.select("set_key", "n", "component"), "set_key")
    alone = F.col("n") - F.size("common")
    longest = F.col("n") - F.ceil(F.col("n") * num / den) + 1
    first = F.slice("common", F.lit(1), F.greatest(F.lit(0), longest - alone).cast("int"))
    prefix = ranked.select("set_key", "n", "component", alone.alias("alone"), F.posexplode(first).alias("pos", "of"))
    prefix = materialize(prefix.select("set_key", "n", "component", (F.col("alone") + F.col("pos")).alias("place"), F.col("of.element").alias("element")), "prefix")

    mixed = prefix.groupBy("element").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("element")
    rows = prefix.join(mixed, "element")
    left, right = rows.alias("l"), rows.alias("r")
    overlap = F.ceil((F.col("l.n") + F.col("r.n")) * num / (num + den))
    return (
        left.join(right, F.col("l.element") == F.col("r.element"))
        .filter("l.set_key > r.set_key and l.component <> r.component")
        .filter((F.col("l.place") <= F.col("l.n") - overlap) & (F.col("r.place") <= F.col("r.n") - overlap))
        .select(F.col("l.set_key").alias("a"), F.col("r.set_key").alias("b"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document row.

    Sets are distinct shingles of ``width`` words; a link needs
    den * intersection >= num * union.
    """
    made = materialize(sets(docs, width), "sets")
    # one row of each distinct set; size and buckets are the same for equal sets
    known = made.filter("set_key is not null and doc_id is not null")
    stands = (F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("buckets").alias("buckets"), F.count("*").alias("copies"))
    classes = materialize(known.groupBy("set_key").agg(*stands), "classes")

    # the sets of one id belong together
    own = known.select("doc_id", "set_key").distinct()
    several = own.groupBy("doc_id").agg(F.min("set_key").alias("b"), F.count("*").alias("n")).filter("n > 1").select("doc_id", "b")
    same = own.join(several, "doc_id").filter("set_key <> b").select(F.col("set_key").alias("a"), "b")
    of = components(links(docs, classes, width, num, den).unionByName(same)).withColumnRenamed("node", "set_key")
    joined = classes.select("set_key", "doc_id").join(of, "set_key", "left").withColumn("component", F.coalesce("component", "set_key"))
    least = joined.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = materialize(joined.join(least, "component").select("set_key", "component_id"), "components")

    # rows of a repeated id without a set follow the rows that have one
    by_id = own.join(several.select("doc_id").unionByName(_bare_and_not(made)), "doc_id", "left_semi").join(named, "set_key")
    by_id = by_id.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    bare = made.filter("set_key is null and doc_id is not null").join(by_id, "doc_id", "left")
    nameless = made.filter("doc_id is null").withColumn("component_id", F.lit(None).cast("long"))

    # sets with more than 1 / HOT of all rows, at most HOT of them, are broadcast
    total = classes.agg(F.sum("copies")).first()[0] or 0
    often = classes.filter(F.col("copies") > max(total // HOT, 1)).select("set_key")
    hot = F.broadcast(named.join(often, "set_key", "left_semi"))
    copied = known.join(hot, "set_key")
    others = known.join(F.broadcast(often), "set_key", "left_anti").join(named, "set_key")
    columns = ("doc_id", "n_shingles", "component_id")
    judged = copied.select(*columns).unionByName(others.select(*columns)).unionByName(bare.select(*columns)).unionByName(nameless.select(*columns))
    component = F.coalesce("component_id", "doc_id")
    return judged.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _bare_and_not(made: DataFrame) -> DataFrame:
    """Ids with a row that has no set and another that has one."""
    has = F.col("set_key").isNotNull()
    both = made.filter("doc_id is not null").groupBy("doc_id").agg(F.bool_or(has).alias("some"), F.bool_and(has).alias("all"))
    return both.filter("some and not `all`").select("doc_id")
