"""Language identification by Bayesian evidence fusion (operator 7).

Four kinds of evidence are combined, each as a likelihood or prior over the
languages of the model:

* the text: hashed character trigrams, naive Bayes, tempered, because
  neighbouring trigrams aren't independent;
* the declared language of the markup (or of the metadata);
* the suffix of the address;
* the host: a prior smoothed hierarchically, host towards registered domain
  towards corpus.

How far declarations, suffixes and hosts can be trusted is learned from the
corpus itself: grouped counts of the language that the text alone suggests.
All counts cover all rows and are summed before the shuffle; they come back by
joins salted with the row, because one host may hold a third of all rows.

The trigram model is fitted on a bounded sample: at most about ``TRAIN_ROWS``
labelled texts of each of the ``MOST_LANGUAGES`` most frequent labels, chosen by
a hash of the id.

Defined results: without trigrams of letters (null, empty, digits only) the
text is no evidence, and the document is rejected; null declaration, suffix or
host is no evidence; repeated rows are judged each; an empty table gives an
empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glucoflow.llm.common import encode, in_batches, materialize, null_key, rows_of

#: labelled rows per language that the model is fitted on, about
TRAIN_ROWS = 400
MOST_LANGUAGES = 100
#: hashed trigrams of the model
BUCKETS = 1 << 16
#: trigrams of a text count as at most so many independent ones
FULL_EVIDENCE = 60.0
#: smoothing: pseudo-rows of the parent level that a host or domain starts with
PARENT_ROWS = 20.0
#: pseudo-rows of a declaration or suffix, spread over the languages
SPREAD_ROWS = 5.0
#: a document below this posterior is rejected
LEAST_POSTERIOR = 0.6
SALTS = 64
SEGMENT_BYTES = 1 << 19

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def trigram_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts, one after the other, and their number per text.

    Trigrams are bytes of lower-cased words with a space on both sides.
    """
    raw = np.frombuffer(b"\n" + b"\n".join(texts).lower() + b"\n", np.uint8)
    clean = np.where(_LETTER[raw], raw, 32).astype(np.uint32)
    if len(clean) < 3:
        return np.zeros(0, np.uint16), np.zeros(len(texts), np.int64)
    code = (clean[:-2] << 16) | (clean[1:-1] << 8) | clean[2:]
    at = np.flatnonzero(clean[1:-1] != 32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    n = np.diff(np.searchsorted(at, ends - 1), prepend=0)
    return ((code[at] * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16), n


@dataclass(frozen=True)
class Model:
    """log P(trigram | language), one row per language."""

    languages: tuple[str, ...]
    logs: np.ndarray

    @staticmethod
    def fit(rows: list[tuple[str, str]]) -> Model:
        languages = tuple(sorted({lang for lang, _ in rows}))
        counts = np.zeros((max(1, len(languages)), BUCKETS))
        for k, lang in enumerate(languages):
            codes, _ = trigram_codes([encode(t) for own, t in rows if own == lang])
            counts[k] = np.bincount(codes, minlength=BUCKETS)
        counts += 0.1
        return Model(languages or ("und",), np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text, language) tempered log likelihoods, best 0; and trigrams per text."""
        codes, n = trigram_codes(texts)
        sums = np.zeros((len(texts), len(self.languages)))
        full = np.flatnonzero(n)
        if len(full):
            cut = (np.cumsum(n) - n)[full]
            for k, row in enumerate(self.logs):
                sums[full, k] = np.add.reduceat(row[codes], cut, dtype=np.float64)
        mean = sums / np.maximum(n, 1)[:, None]
        out = mean * np.minimum(n, FULL_EVIDENCE)[:, None]
        return out - out.max(axis=1, keepdims=True), n


def fit(docs: DataFrame, label: str = "declared") -> Model:
    """The model of a bounded sample of labelled rows (see the constants)."""
    labelled = docs.filter(F.col(label).isNotNull() & F.col("text").isNotNull() & (F.trim(label) != ""))
    counts = labelled.groupBy(label).count().orderBy(F.desc("count"), label).limit(MOST_LANGUAGES).collect()
    if not counts:
        return Model.fit([])
    chance = F.lit(0.0)
    for lang, n in counts:
        chance = F.when(F.col(label) == lang, F.lit(min(1.0, TRAIN_ROWS / n))).otherwise(chance)
    place = F.pmod(F.xxhash64("row_key"), F.lit(1 << 30)) / float(1 << 30)
    return Model.fit([(r[0], r[1]) for r in labelled.filter(place < chance).select(label, "text").collect()])


_SCORES = pa.schema([("row_key", pa.int64()), ("declared", pa.string()), ("suffix", pa.string()), ("domain", pa.string()), ("host", pa.string()), ("scores", pa.list_(pa.float64())), ("n_trigrams", pa.int64())])
_SCORES_DDL = "row_key long, declared string, suffix string, domain string, host string, scores array<double>, n_trigrams long"


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """Text scores per row; the text itself is left behind."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for part in _parts(rows_of(batches, *_SCORES.names[:-2], "text")):
                scores, n = model.scores([encode(r[-1]) for r in part])
                for r, s, k in zip(part, scores.tolist(), n.tolist(), strict=True):
                    yield *r[:-1], s, k

        return in_batches(made(), _SCORES)

    return rows.select(*_SCORES.names[:-2], "text").mapInArrow(score, _SCORES_DDL)


def _parts(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    part, size = [], 0
    for r in rows:
        part.append(r)
        size += len(r[-1] or "")
        if size >= SEGMENT_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def _counts(judged: DataFrame, *keys: str) -> DataFrame:
    """Per key the rows of each language that the text alone suggests: array n."""
    per = judged.groupBy(*keys, "guess").agg(F.count("*").alias("n"))
    return per.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("guess", "n"))).alias("by"))


def _array(by: str, size: int) -> Column:
    return F.array(*(F.coalesce(F.element_at(by, F.lit(k)), F.lit(0)).cast("double") for k in range(size)))


def _smoothed(own: Column, parent: Column) -> Column:
    """(n_k + PARENT_ROWS * parent_k) / (n + PARENT_ROWS)."""
    total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(own, parent, lambda n, p: (n + PARENT_ROWS * p) / (total + PARENT_ROWS))


def evidence_tables(judged: DataFrame, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of log evidence: (declared, logs), (suffix, logs), (domain, host, logs).

    judged: declared, suffix, domain, host, guess of every row with a guess.
    """
    corpus = _counts(judged.withColumn("one", F.lit(1)), "one").select("one", _array("by", size).alias("all"))
    share = corpus.select("one", F.transform("all", lambda n: (n + 1.0) / (F.aggregate("all", F.lit(0.0), lambda a, x: a + x) + float(size))).alias("share"))

    def likelihood(key: str) -> DataFrame:
        # P(key | language) up to a factor: (rows of both + spread) / (rows of the language + spread)
        table = _counts(judged, key).withColumn("one", F.lit(1)).join(corpus, "one")
        logs = F.zip_with(_array("by", size), F.col("all"), lambda n, a: F.log((n + SPREAD_ROWS / size) / (a + SPREAD_ROWS)))
        return table.select(key, logs.alias(f"{key}_logs"))

    domains = _counts(judged, "domain").withColumn("one", F.lit(1)).join(share, "one").select("domain", _smoothed(_array("by", size), F.col("share")).alias("domain_share"))
    hosts = _counts(judged, "domain", "host").join(domains, "domain").select(
        "domain", "host", F.transform(_smoothed(_array("by", size), F.col("domain_share")), lambda p: F.log(p)).alias("host_logs")
    )
    return likelihood("declared"), likelihood("suffix"), hosts


def _joined(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Left join, salted by the row."""
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(salted, [*keys, "salt"], "left")


def identify(rows: DataFrame, model: Model | None = None) -> DataFrame:
    """(row_key, language, posterior, text_language, accepted) of every row.

    rows: row_key long, text, declared, suffix, host, domain (strings).
    """
    rows = rows.select(F.col("row_key").cast("long").alias("row_key"), *(F.col(c).cast("string").alias(c) for c in ("text", "declared", "suffix", "domain", "host")))
    model = model or fit(rows)
    size = len(model.languages)
    names = F.array(*map(F.lit, model.languages))
    flat = F.array(*(F.lit(0.0) for _ in range(size)))

    keyed = scored(rows, model).withColumns({c: F.when(F.col(c).isNotNull(), null_key(c)).otherwise(F.lit("~")) for c in ("declared", "suffix", "domain", "host")})
    guess = F.when(F.col("n_trigrams") > 0, F.array_position("scores", F.array_max("scores")).cast("int") - 1)
    judged = materialize(keyed.withColumn("guess", guess), "langid")
    declared, suffix, hosts = evidence_tables(judged.filter("guess is not null"), size)

    salted = judged.withColumn("salt", F.pmod(F.xxhash64("row_key", "scores"), F.lit(SALTS)).cast("int"))
    for table, keys in ((declared, ["declared"]), (suffix, ["suffix"]), (hosts, ["domain", "host"])):
        salted = _joined(salted, table, keys)
    # a missing declaration or suffix says nothing; the host's prior always counts
    parts = [
        F.col("scores"),
        F.when(F.col("declared") == "~", flat).otherwise(F.coalesce("declared_logs", flat)),
        F.when(F.col("suffix") == "~", flat).otherwise(F.coalesce("suffix_logs", flat)),
        F.coalesce("host_logs", flat),
    ]
    total = parts[0]
    for p in parts[1:]:
        total = F.zip_with(total, p, lambda a, b: a + b)
    top = F.array_max("total")
    weight = F.aggregate("total", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    fused = salted.withColumn("total", total).withColumn("posterior", 1.0 / weight)
    return fused.select(
        "row_key",
        F.when(F.col("guess").isNotNull(), F.element_at(names, F.array_position("total", top).cast("int"))).alias("language"),
        F.when(F.col("guess").isNotNull(), F.col("posterior")).otherwise(F.lit(0.0)).alias("posterior"),
        F.when(F.col("guess").isNotNull(), F.element_at(names, F.coalesce("guess", F.lit(0)) + 1)).alias("text_language"),
        (F.col("guess").isNotNull() & (F.col("posterior") >= LEAST_POSTERIOR)).alias("accepted"),
    )


def of_documents(docs: DataFrame) -> DataFrame:
    """Evidence of ``documents``: declared is lang, the host is the source; there is no address."""
    return docs.select(
        F.col("doc_id").alias("row_key"), "text", F.col("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"),
        F.lit(None).cast("string").alias("domain"), F.col("source").alias("host"),
    )


def of_pages(pages: DataFrame) -> DataFrame:
    """Evidence of ``pages``: text of the markup, its lang attribute, and the parts of the address."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)", 1))
    plain = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    empty = lambda c: F.when(c != "", c)
    return pages.select(
        F.col("page_id").alias("row_key"), plain.alias("text"),
        empty(F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1))).alias("declared"),
        empty(F.regexp_extract(host, r"\.([a-z]+)$", 1)).alias("suffix"),
        empty(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("domain"), empty(host).alias("host"),
    )
