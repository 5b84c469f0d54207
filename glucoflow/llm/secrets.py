"""Secret scan through a trigram inverted index (operator 9).

From each rule's regular expression a Boolean trigram query is derived.  Per
chunk of documents an inverted index over the trigrams of all queries is
built; the posting lists are intersected, and only candidate documents are
searched with the expression.  A rule without mandatory trigrams (long hex
strings) searches every document.  The scan needs no shuffle: index, queries
and verification stay within a task, one bounded chunk at a time.

Defined results: null text is empty and has no spans; offsets are code points,
end exclusive; repeated rows are scanned each; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glucoflow.llm.common import encode, in_batches, rows_of
from glucoflow.llm.trigrams import Postings, compile_ascii, trigram_query

#: bytes of text that are indexed together
CHUNK_BYTES = 1 << 21


@dataclass(frozen=True)
class Rule:
    """A kind of secret: expression, and the least length of a group of the match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: fixed by the contract
BASE = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: published formats of well-known issuers
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("url_login", r"://[A-Za-z0-9._-]+:[^\s/@:]{3,}@"),
)
RULES = BASE + MORE

_SPANS = pa.schema(
    [("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64())]
)


class Scanner:
    """Rules compiled once per task."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.queries = [trigram_query(r.pattern) for r in rules]
        # a run of at least so many letters is found faster; the maximal runs are the same
        self.search = [compile_ascii(r.pattern[:-1] + f"{{{r.least},}}" if r.pattern.endswith("]+") and r.pattern.startswith("[") and not r.group else r.pattern) for r in rules]
        self.postings = Postings(self.queries)

    def chunk(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """Per text its spans (start, rule number, end), sorted."""
        found = self.postings.index([encode(t) for t in texts])
        spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, query, search) in enumerate(zip(self.rules, self.queries, self.search, strict=True)):
            for i in self.postings.candidates(query, found).nonzero()[0]:
                for m in search.finditer(texts[i] or ""):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        spans[i].append((m.start(), k, m.end()))
        for s in spans:
            s.sort()
        return spans


def joined(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans)


def _span_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
    scanner = Scanner()
    n_base = len(BASE)

    def finish(ids: list, texts: list) -> Iterator[tuple]:
        for doc_id, spans in zip(ids, scanner.chunk(texts), strict=True):
            base = [s for s in spans if s[1] < n_base]
            counts = [sum(s[1] == k for s in base) for k in range(n_base)]
            yield doc_id, *counts, hashlib.sha256(joined(base, RULES).encode()).hexdigest(), joined(spans, RULES), len(spans)

    ids, texts, size = [], [], 0
    for doc_id, text in rows:
        ids.append(doc_id)
        texts.append(text)
        size += len(text or "")
        if size >= CHUNK_BYTES:
            yield from finish(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield from finish(ids, texts)


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document row: counts of the base kinds, their digest, all spans."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(_span_rows(rows_of(batches, "doc_id", "text")), _SPANS)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long"
    )
