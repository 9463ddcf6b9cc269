"""License scans with ordered signature rules.

Rules are regular expressions over a text's words (license_rules.py), gated by keywords: a rule is tried only on a text that has
all of its keywords as words. What matches is a detection: a label and a range of words. Detections overlap, and one is
suppressed if it lies within another of the same or a higher priority; of equal ranges the higher priority stays, then the
earlier rule. Base phrases are rules of the highest priority, so they always stay. A document's labels are those of the
detections left, its score the confidence of the surest of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, external_id, internal_id, quoted, record_batches, slices
from .license_rules import RULES

#: Phrases that are always reported, with their labels.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: Kinds of rules, the highest priority first, and how sure a detection is.
CONFIDENCE = {"base": 0.9, "tag": 1.0, "text": 0.95, "notice": 0.9, "link": 0.85, "name": 0.8, "mention": 0.5}
PRIORITY = {kind: i for i, kind in enumerate(CONFIDENCE)}

#: Words are digits, lower-case letters and what is beyond ASCII; capitals become lower-case, the rest separates.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Rule:
    """A signature, with its place in the order."""

    order: int
    label: str
    kind: str
    keywords: frozenset[str]
    pattern: str

    @property
    def expression(self) -> str:
        """Over words with two spaces between and one at either end, so that neighbours do not share one."""
        spaced = self.pattern.replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?")
        return f" (?:{spaced}) "


def parse(text: str, first: int = 0) -> list[Rule]:
    out, label = [], ""
    for line in filter(None, map(str.strip, text.splitlines())):
        if line.startswith("["):
            label = line[1:-1]
            continue
        kind, keywords, pattern = (x.strip() for x in line.split("|", 2))
        if kind not in PRIORITY:
            raise ValueError(f"unknown kind in rule: {line}")
        out.append(Rule(first + len(out), label, kind, frozenset(keywords.split()), pattern))
    return out


@lru_cache(maxsize=1)
def signature_rules() -> tuple[Rule, ...]:
    """Base phrases, then the rules by kind and as written."""
    base = [Rule(i, label, "base", frozenset(phrase.split()), phrase) for i, (label, phrase) in enumerate(BASE)]
    return (*base, *parse(RULES, len(base)))


class Scanner:
    """Rules compiled, and indexed by the rarest-looking keyword, the longest."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.keywords = frozenset(w.encode() for r in rules for w in r.keywords)
        self.gate: dict[bytes, list[tuple[frozenset[bytes], re.Pattern[bytes], Rule]]] = {}
        for r in rules:
            words = frozenset(w.encode() for w in r.keywords)
            self.gate.setdefault(max(words, key=lambda w: (len(w), w)), []).append((words, re.compile(r.expression.encode()), r))

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, Rule]]]:
        """(number of words, the detections left as (first word, words, rule) in order)."""
        clean = text.translate(_WORDS)
        n, present = 0, set()
        for words in _pieces(clean):
            n += len(words)
            present |= self.keywords.intersection(words)
        tried = [(pattern, r) for w in present for needed, pattern, r in self.gate.get(w, ()) if needed <= present]
        if not tried:
            return n, []
        spaced = b" " + b"  ".join(b"  ".join(words) for words in _pieces(clean) if words) + b" "
        found = [(m.start(), m.end(), r) for pattern, r in tried for m in pattern.finditer(spaced)]
        if not found:
            return n, []
        cells = np.frombuffer(spaced, np.uint8)
        before = np.flatnonzero((cells[:-1] == 32) & (cells[1:] != 32))
        first = np.searchsorted(before, [s for s, _, _ in found])
        last = np.searchsorted(before, [e for _, e, _ in found])
        return n, suppress([(int(f), int(e - f), r) for f, e, (_, _, r) in zip(first, last, found, strict=True)])


def _pieces(clean: bytes) -> Iterator[list[bytes]]:
    """The words of a cleaned text, a slice at a time."""
    a = 0
    while a < len(clean):
        b = clean.find(b" ", a + SLICE_BYTES)
        b = len(clean) if b < 0 else b
        yield clean[a:b].split()
        a = b


def suppress(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """The detections that lie within no other of the same or a higher priority."""
    reach = [0] * len(PRIORITY)  # by priority, how far those that start no later reach
    kept = []
    for first, size, rule in sorted(found, key=lambda d: (d[0], -d[1], PRIORITY[d[2].kind], d[2].order)):
        rank = PRIORITY[rule.kind]
        if max(reach[: rank + 1]) < first + size:
            kept.append((first, size, rule))
        reach[rank] = max(reach[rank], first + size)
    return kept


@lru_cache(maxsize=1)
def _scanner() -> Scanner:
    return Scanner(signature_rules())


_FOUND = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("first_word", pa.int64()), ("words", pa.int64())]))
_SCHEMA = pa.schema(
    [("did", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", _FOUND)]
)
_DDL = "did long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,kind:string,first_word:long,words:long>>"


def _row(did: int, n: int, kept: list[tuple[int, int, Rule]]) -> tuple:
    base = [(first, r.label) for first, _, r in kept if r.kind == "base"]
    places = [first for first, _ in base]
    joined = lambda labels: ",".join(sorted(set(labels)))
    return (
        did, n, len(base), min(places, default=None), max(places, default=None), joined(label for _, label in base), joined(r.label for _, _, r in kept),
        max((CONFIDENCE[r.kind] for _, _, r in kept), default=0.0), [{"label": r.label, "kind": r.kind, "first_word": first, "words": size} for first, size, r in kept],
    )


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = _scanner()
    for rows, data, off in slices(batches, "text"):
        ids = rows.column("did").to_pylist()
        out = [_row(did, *scanner.scan(data[off[i] : off[i + 1]].tobytes())) for i, did in enumerate(ids)]
        yield from record_batches(_SCHEMA, dict(zip(_SCHEMA.names, zip(*out, strict=True), strict=True)), 4096)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: did, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    n_base counts all places of base phrases, first_word and last_word are the smallest and largest of their first words (from 0; null
    if there are none). Labels are distinct, sorted and joined by commas, empty if there are none; score is between 0 (none) and 1.
    detections are what suppression leaves, by place. A null or empty text has no words. Null ids and repeated rows come
    out as they are; equal ranges are settled by kind and the rules' order. A long text is cleaned in slices at its separators and
    matched whole: memory is about four times its length. An empty table gives no rows; names of other columns don't matter.
    """
    return docs.select(internal_id(quoted(id_col)).alias("did"), F.col(quoted(text_col)).cast("string").alias("text")).mapInArrow(_scan, _DDL)


def op13(docs: DataFrame) -> DataFrame:
    return scan_licenses(docs).select(external_id("did").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _rules_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({r.order}, {PRIORITY[r.kind]}, {quote(r.label)}, CAST({CONFIDENCE[r.kind]} AS DOUBLE), [{', '.join(map(quote, sorted(r.keywords)))}], {quote(r.expression)})" for r in signature_rules())


#: Every rule on every text that has its keywords; what matches is put between two marks that no word has, and words are counted up to there.
OP13_SQL = rf"""
WITH rules(ord, prio, label, confidence, keywords, pattern) AS (VALUES {_rules_sql()}),
w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), t AS MATERIALIZED (
  SELECT doc_id, ws, ' ' || array_to_string(ws, '  ') || ' ' AS t FROM w WHERE list_has_any(ws, (SELECT list_distinct(flatten(list(keywords))) FROM rules))
), m AS (
  SELECT doc_id, ord, prio, label, confidence, string_split(regexp_replace(t, pattern, chr(1) || '\0' || chr(2), 'g'), chr(1)) AS pieces FROM t JOIN rules ON list_has_all(ws, keywords)
), p AS (
  SELECT doc_id, ord, prio, label, confidence, replace(array_to_string(pieces[1:i], ''), chr(2), '') || ' ' AS before, split_part(pieces[i + 1], chr(2), 1) AS part FROM m, unnest(range(1, len(pieces))) AS r(i)
), d AS (
  SELECT doc_id, ord, prio, label, confidence, (length(before) - length(replace(before, '  ', ''))) // 2 AS a, (length(part) - length(replace(part, '  ', ''))) // 2 + 1 AS n FROM p
), k AS (
  SELECT * FROM d WHERE NOT EXISTS (
    SELECT 1 FROM d o WHERE o.doc_id = d.doc_id AND o.a <= d.a AND o.a + o.n >= d.a + d.n AND (o.n > d.n AND o.prio <= d.prio OR o.n = d.n AND (o.prio, o.ord) < (d.prio, d.ord)))
), g AS (
  SELECT doc_id, count(*) FILTER (prio = 0) AS n_base, min(a) FILTER (prio = 0) AS first_word, max(a) FILTER (prio = 0) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (prio = 0) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(confidence) AS score FROM k GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score FROM w LEFT JOIN g USING (doc_id)
"""
