"""Each operator against a plain version, on a table with all the odd cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import brute
import pyarrow as pa
import pytest
from conftest import prose
from pyspark.sql import functions as F

from glucoflow.llm import decontaminate, langid, linededup, neardup, packing, quality, secrets, stages, substring, suffixes, tokenfile
from glucoflow.llm.common import BATCH_ROWS, importable, scratch_path
from glucoflow.llm.queries import tokenizer


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def odd_ids(rows):
    n = Counter(r[0] for r in rows)
    return {d for d, k in n.items() if k > 1}


def found(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_quality_counters(docs, rows):
    got = found(quality.judge(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for d, t in pairs(rows):
        c = brute.counters(t)
        want.append((d, *c, c[0] < 10 or 100 * c[4] > 20 * c[0]))
    assert got == sorted(want, key=repr)


def test_quality_keeps_clean_and_drops_junk(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    judged = quality.judge(rows).join(labels, "doc_id").filter("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share"))
    share = {r["quality"]: r["share"] for r in judged.collect()}
    assert share[1] >= 0.99 and share[0] <= 0.1


def test_quality_sketch_merges(docs):
    counts = quality.counters(docs).cache()
    whole = quality.sketches(counts)
    half = F.pmod(F.col("n_words"), F.lit(2))
    merged = quality.sketches(counts.filter(half == 0)).unionByName(quality.sketches(counts.filter(half == 1)))
    keys = ["lang_key", "source_key", "metric", "bucket"]
    assert found(merged.groupBy(*keys).agg(F.sum("n").alias("n")), *keys, "n") == found(whole, *keys, "n")


def test_substring(docs, rows):
    got = found(substring.substring_dedup(docs).withColumn("h", F.sha2("kept_text", 256)), "doc_id", "n_words", "n_removed", "h")
    assert got == sorted(brute.substring(pairs(rows)), key=repr)


def test_suffix(docs, rows):
    got = found(suffixes.suffix_dedup(docs).withColumn("h", F.sha2("kept", 256)), "doc_id", "n_bytes", "n_removed", "n_spans", "h")
    assert got == sorted(brute.suffix(pairs(rows)), key=repr)


@pytest.mark.parametrize(("width", "num"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, width, num):
    got = neardup.near_duplicates(docs, width, num, 100).collect()
    assert len(got) == len(rows)
    want = brute.near(pairs(rows), width, num, 100)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    for r in got:
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])
        assert r["doc_id"] is not None or r["component_id"] is None
    odd = odd_ids(rows)
    sizes = {d: len(brute.shingle_set(t, width)) for d, t in pairs(rows)}
    assert all(r["n_shingles"] == sizes[r["doc_id"]] for r in got if r["doc_id"] not in odd)


def test_near_duplicates_of_repeated_ids(spark):
    """An id with two texts has the links of both, whatever the order of the rows; its row without a set too."""
    rng = random.Random(3)
    one, two, other = (prose(rng, 60) for _ in range(3))
    near_of = lambda t: " ".join(["changed", *t.split()[1:]])
    rows = [(1, one), (1, two), (1, None), (2, near_of(one)), (3, near_of(two)), (4, other), (5, other), (6, ""), (None, one)]
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        got = neardup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string").repartition(2), 3, 80, 100).collect()
        assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None) == [(1, 1, True)] * 3 + [(2, 1, False), (3, 1, False), (4, 4, True), (5, 4, False), (6, 6, True)]
        assert len(got) == len(rows)


def test_lines(docs, rows):
    kept = linededup.line_dedup(docs).collect()
    assert len(kept) == len(rows)
    odd = odd_ids(rows)
    want = brute.lines([r for r in pairs(rows) if r[0] not in odd or r[1] == dict(reversed(pairs(rows)))[r[0]]])
    texts = {d: t for d, t in pairs(rows) if d not in odd}
    for r in kept:
        d = r["doc_id"]
        if d not in texts:
            continue
        if texts[d] is None:
            assert r["kept_text"] is None
            continue
        gone = set(want.get(d, ()))
        assert r["n_removed"] == len(gone), d
        assert r["kept_text"] == "\n".join(x for k, x in enumerate(texts[d].split("\n")) if k not in gone)
    assert sum(r["n_removed"] > 0 for r in kept) >= 10


def test_decontamination(spark, docs, rows, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, benchmark).collect())
    want = Counter()
    for d, t in pairs(rows):
        for k, text in items:
            item, own = brute.words((text or "").lower()), brute.words((t or "").lower())
            if item and len(own) < 5000 and brute.edit_distance_within(item, own) <= 0.2 * len(item) + 1e-9:
                want[d, k] += 1
    assert got == want and len(want) >= 4
    clean = decontaminate.clean(docs, benchmark)
    dirty = {d for d, _ in want}
    assert clean.columns == docs.columns
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(d for d, _ in pairs(rows) if d not in dirty)


def test_language(docs, rows):
    judged = langid.identify(langid.of_documents(docs)).collect()
    assert len(judged) == len(rows)
    texts = dict(pairs(rows))
    odd = odd_ids(rows)
    for r in judged:
        if r["row_key"] is None or r["row_key"] in odd:
            continue
        letters = any(c.isalpha() for c in texts[r["row_key"]] or "")
        assert (r["text_language"] is not None) == letters, r
        assert r["accepted"] or not letters or r["posterior"] < langid.LEAST_POSTERIOR
    right = [r["language"] == rows[r["row_key"]][2] for r in judged if r["row_key"] is not None and r["row_key"] < 30]
    assert sum(right) >= 29


def test_secrets(docs, rows):
    got = {(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"]) for r in secrets.find_secrets(docs).collect() if r["n_spans"]}
    assert {x[1:] for x in got} >= {(2, 1, 1)} and len(got) == 1


def packed_rows(df):
    return [r.asDict() for r in df.collect()]


def check_packing(packed, texts):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(tokenizer()).encode
    whole = Counter()
    for t in texts:
        ids = b"".join(i.to_bytes(4, "little") for i in [*encode(t or "", add_special_tokens=False).ids, 2])
        n = len(ids) // 4
        first = n % 1024 or 1024
        for k, (a, b) in enumerate([(0, first), *((s, s + 1024) for s in range(first, n, 1024))]):
            whole[k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])] += 1
    assert Counter((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == whole
    by = defaultdict(list)
    for r in packed:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for members in by.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in packed)
    assert len(by) <= 1.05 * total / 1024 + 3


def test_packing(docs, rows):
    check_packing(packed_rows(packing.pack(docs, tokenizer())), [t for _, t in pairs(rows)])


def test_packing_in_rounds(docs, rows, monkeypatch):
    monkeypatch.setattr(packing, "ROUND_PIECES", 20)
    check_packing(packed_rows(packing.pack(docs, tokenizer())), [t for _, t in pairs(rows)])


def test_token_files(spark, docs, rows, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenfile, "SHARD_BYTES", 50_000)
    path = scratch_path(spark, "ids")
    tokenfile.write_ids(docs, tokenizer(), path)
    encode = Tokenizer.from_file(tokenizer()).encode
    got = sorted(tuple(r) for r in tokenfile.checksums(spark, path).select("start", "doc_id", "n_tokens", "ids_crc32").collect())
    at, want = 0, []
    for d, t in sorted(pairs(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*encode(t or "", add_special_tokens=False).ids, 2]
        want.append((at, d, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        at += len(ids)
    assert got == want
    back = {(r["shard"], r["place"]): r["ids"] for r in tokenfile.read_ids(spark, path).collect()}
    assert len(back) == len(rows) and all(ids[-1] == 2 for ids in back.values())


def test_empty_tables(spark, empty, docs):
    benchmark = spark.createDataFrame([(1, "some words of an item that is there")], "item_id long, text string")
    path = scratch_path(spark, "ids")
    tokenfile.write_ids(empty, tokenizer(), path)
    for df in (
        quality.judge(empty),
        substring.substring_dedup(empty),
        suffixes.suffix_dedup(empty),
        neardup.near_duplicates(empty),
        linededup.line_dedup(empty),
        decontaminate.contaminated(empty, benchmark),
        decontaminate.contaminated(docs, benchmark.limit(0)),
        langid.identify(langid.of_documents(empty)),
        secrets.find_secrets(empty),
        packing.pack(empty, tokenizer()),
        tokenfile.checksums(spark, path),
    ):
        assert df.count() == 0


def test_pipeline(spark, docs, rows, items, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path / "sf")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    at, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, folder)
        at.write.parquet(f"{folder}/{name}")
        at = spark.read.parquet(f"{folder}/{name}")
        seen.append(at)
    assert all(tuple(df.columns) == stages.COLUMNS for df in seen[:-1])
    language, lines, near, clean, packed = [[r.asDict() for r in df.collect()] for df in seen]

    judged = langid.identify(langid.of_documents(docs)).collect()
    no_letters = {d for d, t in pairs(rows) if not any(c.isalpha() for c in t or "")}
    assert len(language) == sum(r["accepted"] for r in judged) and not {r["doc_id"] for r in language} & (no_letters - odd_ids(rows))

    odd = odd_ids(rows)
    single = [(r["doc_id"], r["text"]) for r in language if r["doc_id"] not in odd]
    gone = brute.lines([(d, t) for d, t in sorted({(r["doc_id"], r["text"]) for r in language if r["doc_id"] is not None}, reverse=True)])
    left = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in set(gone.get(d, ()))) for d, t in single}
    assert {r["doc_id"]: r["text"] for r in lines if r["doc_id"] not in odd} == {d: t for d, t in left.items() if d not in gone or t.strip(" ")}

    component = brute.near([(r["doc_id"], r["text"]) for r in lines], 5, 80, 100)
    assert Counter(r["doc_id"] for r in near) == Counter({d for d, c in component.items() if d == c}) + Counter(r["doc_id"] for r in lines if r["doc_id"] is None)

    dirty = set()
    for r in near:
        own = brute.words((r["text"] or "").lower())
        for _, text in items:
            item = brute.words((text or "").lower())
            if item and len(own) < 5000 and brute.edit_distance_within(item, own) <= 0.2 * len(item) + 1e-9:
                dirty.add(r["doc_id"])
    assert Counter(r["doc_id"] for r in clean) == Counter(r["doc_id"] for r in near if r["doc_id"] not in dirty)
    check_packing(packed, [r["text"] for r in clean])


def test_base_digest_of_secrets(docs, rows):
    import re

    kinds = [
        ("assign", re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A), 2, 8),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
        ("hex", re.compile("[0-9a-f]+"), 0, 32),
    ]
    want = []
    for d, t in pairs(rows):
        spans = sorted((m.start(), k, m.end(), name) for k, (name, rx, group, least) in enumerate(kinds) for m in rx.finditer(t or "") if len(m[group]) >= least)
        text = ",".join(f"{name}:{a}:{b}" for a, _, b, name in spans)
        want.append((d, hashlib.sha256(text.encode()).hexdigest()))
    assert found(secrets.find_secrets(docs), "doc_id", "base_sha256") == sorted(want, key=repr)


def test_a_worker_gets_few_texts_at_a_time(spark):
    """The operators' sessions hand at most BATCH_ROWS rows to Python in one batch; a lower setting stays."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = spark.range(0, 3 * BATCH_ROWS, 1, 1)
    for before, most in (("10000", BATCH_ROWS), ("0", BATCH_ROWS), ("70", 70)):
        spark.conf.set(name, before)
        importable(spark)
        got = [r[0] for r in rows.mapInArrow(sizes, "n long").collect()]
        assert max(got) == most and sum(got) == 3 * BATCH_ROWS
    spark.conf.unset(name)
