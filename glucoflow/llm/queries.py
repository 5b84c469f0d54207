"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glucoflow.llm import decontaminate, exactdup, langid, lexical, linededup, neardup, packing, quality, secrets, substring, suffixes, tokenfile, whitening
from glucoflow.llm.common import importable, scratch_path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left by pairwise alignment, as digests."""
    kept = linededup.line_dedup(documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters, base rule and adaptive verdict of every document."""
    return quality.judge(documents(spark, sf_dir))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left by 20-word substring dedup, as digests."""
    kept = substring.substring_dedup(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left by 50-byte suffix dedup, as digests."""
    kept = suffixes.suffix_dedup(documents(spark, sf_dir))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it contains."""
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenizer() -> str:
    """Path of the public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids that hold all documents."""
    return packing.pack(documents(spark, sf_dir), tokenizer())


def op6_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written as coded blocks and read back."""
    docs = documents(spark, sf_dir)
    path = scratch_path(spark, "token-ids")
    tokenfile.write_ids(docs, tokenizer(), path)
    return tokenfile.checksums(spark, path)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document from text, declaration and source."""
    return langid.identify(langid.of_documents(documents(spark, sf_dir))).select(F.col("row_key").alias("doc_id"), "language", "posterior", "text_language", F.col("accepted").alias("kept"))


def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page from text, markup, address suffix and host."""
    pages = importable(spark).read.parquet(f"{sf_dir}/pages.parquet")
    return langid.identify(langid.of_pages(pages)).select(F.col("row_key").alias("page_id"), "language", "posterior", "text_language", "accepted")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components at 3-word shingles and similarity 0.85."""
    return neardup.near_duplicates(documents(spark, sf_dir), width=3, num=85, den=100)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text."""
    return secrets.find_secrets(documents(spark, sf_dir))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight leading whitened components of every valid embedding."""
    found = whitening.whiten(importable(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the largest id of each stays."""
    return exactdup.exact_dedup(spark, f"{sf_dir}/documents.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_token_id_output": op6_token_id_output,
    "op7_language_id": op7_language_id,
    "pages_language_id": pages_language_id,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_secret_scan": op9_secret_scan,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_ranked_lexical_search": op12_ranked_lexical_search,
    "op13_exact_dedup": op13_exact_dedup,
}

#: words of a whole text
_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_SUBSTRING_SQL = f"""WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, i, list_slice(ws, i, i + 19) AS s FROM w, unnest(range(1, len(ws) - 18)) AS t(i)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM later, unnest(range(0, 20)) AS t(k)),
word AS (SELECT doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(p)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS txt FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(txt, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id"""

_NEAR_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, list_slice(ws, i, i + 2) AS s FROM w, unnest(range(1, greatest(len(ws) - 2, least(len(ws), 1)) + 1)) AS t(i)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(d, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.d, edge.b FROM reach JOIN edge ON edge.a = reach.c)
SELECT d AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id, d = min(c) AS kept
FROM reach LEFT JOIN n ON n.doc_id = d GROUP BY d"""

_EXACT_SQL = """SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_RANKED_SQL = f"""WITH w AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL),
d AS (SELECT r, doc_id, CAST(len(ts) AS BIGINT) AS n, ts FROM w WHERE len(ts) > 0),
c AS (SELECT CAST(count(*) AS BIGINT) AS N_, CAST(sum(n) AS BIGINT) AS L_ FROM d),
q AS (SELECT DISTINCT i, item_id, unnest(ts) AS t FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS ts FROM benchmark WHERE text IS NOT NULL)),
tf AS (SELECT r, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY r, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
wt AS (SELECT t, CAST(floor(1000 * ln((2 * N_ + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, c),
m AS (SELECT r, doc_id, 100 - 90 + ((90 * n * N_) // L_) AS m FROM d, c),
s AS (SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN tf USING (t) JOIN wt USING (t) JOIN m USING (r) GROUP BY i, item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""

ORACLES: dict[str, str] = {"op12_ranked_lexical_search": _RANKED_SQL, "op3_substring_dedup": _SUBSTRING_SQL, "op8_minhash_near_dedup": _NEAR_SQL, "op13_exact_dedup": _EXACT_SQL}
