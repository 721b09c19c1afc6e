"""Personal data, and the terms around it that give it away.

Base entities (e-mail and IP addresses, payment cards, telephone numbers) are found by patterns and checks. Then the corpus says
how strongly a term reveals that such an entity is near: with P as shares of documents, the disclosure of entity kind e by term
t is PMI(t; e) / IC(e) = log(P(t near e) / (P(t) P(e))) / -log P(e), which is 1 for a term that never stands without e. Terms
near at least SUPPORT different entities are removed at REMOVE or more and generalised at GENERALISE or more, wherever they
stand near such an entity; entities are always generalised to their kind.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.shared import id_or_none, texts, written
from eventloom.llm.words import word_hashes

KINDS = ("email", "ip", "card", "phone")
#: Words on each side of an entity that count as near.
NEAR = 8
SUPPORT, GENERALISE, REMOVE = 3, 0.8, 0.95

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
#: The look-behind only skips starts inside a run of digits, which fail as the run's start has failed.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]+")
_NO_LETTERS = re.compile(r"[\W\d_]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain: each @ is met once and its local part is read backwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (c := text[start - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def entities(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base entities, in this order; positions are code points, ends are exclusive."""
    found = [(s, 0, e) for s, e in _emails(text)]
    if text.count(".") > 2:
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p) <= 255 for p in (p.lstrip("0") or "0" for p in m[0].split("."))):
                found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def named(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def _numbers(text: str) -> np.ndarray:
    """Terms of a text: its runs of letters in lower case, hashed all at once."""
    return word_hashes(_NO_LETTERS.sub(" ", text.lower()))[0].view(np.int64)


def _around(text: str, spans: list[tuple[int, int, int]]) -> set[tuple[int, int, int, int, int]]:
    """(kind, entity, term, start, end) of the terms near each entity and outside all of them."""
    starts, ends = [s for s, _, _ in spans], np.maximum.accumulate([e for _, _, e in spans])
    out = set()
    for s, kind, e in spans:
        value = int(_numbers_of_value(text[s:e]))
        reach = 40 * NEAR  # grows until it holds enough words, so a long text is not read once for each entity
        while True:
            low, high = max(0, s - reach), min(len(text), e + reach)
            before, after = [m.span() for m in _TERM.finditer(text, low, s)], [m.span() for m in _TERM.finditer(text, e, high)]
            if (len(before) > NEAR or not low) and (len(after) > NEAR or high == len(text)):
                break
            reach *= 4
        for a, b in before[-NEAR:] + after[:NEAR]:
            k = bisect_left(starts, b)  # spans that start before the term ends
            if k and ends[k - 1] > a:
                continue
            out.add((kind, value, int(_numbers(text[a:b])[0]), a, b))
    return out


def _numbers_of_value(value: str) -> np.int64:
    return np.bitwise_xor.reduce(word_hashes(value.lower().replace(" ", ""))[0]).view(np.int64)


_SCAN = "_row int, _id bigint, _kind int, _value bigint, _term bigint, _start bigint, _end bigint, _docs bigint, _base array<struct<start:bigint,ord:int,end:bigint>>, _sha string, _text string"
_NAMES = ["_row", "_id", "_kind", "_value", "_term", "_start", "_end", "_docs", "_base", "_sha", "_text"]
_DOCUMENT, _NEAR_ROW, _COUNT = 0, 1, 2


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One reading: a row for each document, for each term near an entity, and counts of documents by term."""
    counts: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        t, inverse = np.unique(np.concatenate([c[0] for c in counts]), return_inverse=True)
        return t, np.bincount(inverse, np.concatenate([c[1] for c in counts])).astype(np.int64)

    def told() -> pd.DataFrame:
        t, n = merged()
        counts.clear()
        return pd.DataFrame({"_row": _COUNT, "_id": 0, "_kind": 0, "_value": 0, "_term": t, "_start": 0, "_end": 0, "_docs": n, "_base": None, "_sha": None, "_text": None})

    for pdf in batches:
        rows, terms = [], [np.zeros(0, np.int64)]
        for i, text in zip(pdf["_id"], pdf["_text"]):
            spans = entities(text)
            sha = hashlib.sha256(named([(s, KINDS[k], e) for s, k, e in spans]).encode()).hexdigest()
            rows.append((_DOCUMENT, i, 0, 0, 0, 0, 0, 0, [{"start": s, "ord": k, "end": e} for s, k, e in spans], sha, text if spans else None))
            rows += [(_NEAR_ROW, i, kind, value, term, a, b, 0, None, None, None) for kind, value, term, a, b in (_around(text, spans) if spans else ())]
            terms.append(np.unique(_numbers(text)))
        yield pd.DataFrame(rows, columns=_NAMES)
        counts.append(np.unique(np.concatenate(terms), return_counts=True))
        if sum(len(c[0]) for c in counts) > 3_000_000:
            counts[:] = [merged()]
            if len(counts[0][0]) > 1_500_000:
                yield told()
    if counts:
        yield told()


def _clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entities become their kind in brackets; terms become [TERM] or go."""
    for pdf in batches:
        spans_out, clean = [], []
        for text, base, added in zip(pdf["_text"], pdf["_base"], pdf["_added"]):
            spans = [(x["start"], x["ord"], x["end"], False) for x in base]
            spans += [(x["_start"], len(KINDS), x["_end"], x["_gone"]) for x in (added if added is not None else ())]
            spans.sort()
            spans_out.append(named([(s, (*KINDS, "term")[k], e) for s, k, e, _ in spans]))
            if not spans:
                clean.append(None)
                continue
            out, at = [], 0
            for s, k, e, gone in spans:
                if e <= at:
                    continue
                out += [text[at : max(at, s)], "" if gone else f"[{(*KINDS, 'term')[k].upper()}]"]
                at = e
            clean.append("".join(out) + text[at:])
        count = [[sum(x["ord"] == k for x in base) for base in pdf["_base"]] for k in range(len(KINDS))]
        yield pd.DataFrame({"_id": pdf["_id"], **{f"n_{kind}": count[k] for k, kind in enumerate(KINDS)}, "base_sha256": pdf["_sha"], "spans": spans_out, "clean": clean})


def sanitised(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, clean) of every row of ``docs`` (doc_id, text).

    ``spans`` are "kind:start:past the end" in code points, by start and then in the order email, ip, card, phone, term;
    ``base_sha256`` is the hash of the same list without terms; ``clean`` is the sanitised text, null where nothing was found.
    Statistics are those of all rows given. Null texts count as empty; rows with null or repeated ids each give a row, and terms
    found for an id apply to all its rows; other columns are ignored; an empty table gives an empty table.
    """
    scan = written(texts(docs).mapInPandas(_scan, _SCAN), "disclosure")
    documents = scan.where(F.col("_row") == _DOCUMENT)
    near = scan.where(F.col("_row") == _NEAR_ROW).select("_id", "_kind", "_value", "_term", "_start", "_end")
    n_docs = documents.count()
    with_kind = documents.select("_id", F.explode(F.array_distinct(F.transform("_base", lambda x: x["ord"]))).alias("_kind")).groupBy("_kind").agg(F.count("*").alias("_with"))
    by_term = scan.where(F.col("_row") == _COUNT).groupBy("_term").agg(F.sum("_docs").alias("_docs"))
    together = near.groupBy("_kind", "_term").agg(F.countDistinct("_value").alias("_support"), F.countDistinct("_id").alias("_both")).where(F.col("_support") >= SUPPORT)
    pmi = F.log(F.col("_both") * n_docs / (F.col("_docs") * F.col("_with")))
    ic = F.log(F.lit(n_docs) / F.col("_with"))
    telling = together.join(by_term, "_term").join(with_kind, "_kind").select("_kind", "_term", F.when(ic > 0, pmi / ic).alias("_disclosure")).where(F.col("_disclosure") >= GENERALISE)
    added = near.join(telling, ["_kind", "_term"]).groupBy("_id", "_start", "_end").agg(F.max(F.col("_disclosure") >= REMOVE).alias("_gone"))
    added = added.groupBy("_id").agg(F.collect_list(F.struct("_start", "_end", "_gone")).alias("_added"))
    out = documents.select("_id", "_base", "_sha", "_text").join(added, "_id", "left")
    out = out.mapInPandas(_clean, "_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, clean string")
    return out.withColumn("_id", id_or_none("_id")).withColumnRenamed("_id", "doc_id")
