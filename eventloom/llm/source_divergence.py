"""Which sources of a language use other words than the rest, by collapsing equal texts first.

Rows with equal texts of one language become one text with the number of its copies in each source, so a text is split into
terms once however often it occurs, and its counts are added with the copies as weights. That gives, for every term, source and
language, occurrences and document frequency; terms in fewer than ``least_docs`` documents of their language go. Shares are
smoothed and held as whole billionths, so all sums are exact. Pairs of sources are compared over the terms that at least one of
them has; all other terms differ by the same amount, which is multiplied instead of summed. Sums are taken in blocks of terms and
tiles of sources, so no task holds a language as a whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.shared import written

#: Documents of a language that a term must occur in, the pseudo-count of every term, and the unit of a share.
LEAST_DOCS, PSEUDO, UNIT = 30, 5, 1_000_000_000
#: Counters a task holds before it passes them on.
HELD = 1_000_000
#: Terms in a block and sources in a tile of the comparison; sources in one list of a text's copies.
BLOCK_TERMS, TILE, LIST = 1024, 128, 5000

#: Letters of ASCII in lower case; its other characters end a term, and bytes beyond ASCII belong to terms.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of letters A-Z (in lower case) and of characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERMS).split()


def collapsed(docs: DataFrame) -> DataFrame:
    """(_lang, _text, _copies): each different text of a language once, with the number of its rows by source.

    Null text, lang and source count as empty. Texts are equal when their SHA-256 digests are. Copies are merged in the tasks that
    read them, and the whole texts are shuffled once.
    """
    blank = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    rows = docs.select(blank("lang").alias("_lang"), blank("source").alias("_source"), blank("text").alias("_text"))
    rows = rows.withColumn("_digest", F.unhex(F.sha2("_text", 256)))
    sources = rows.agg(F.approx_count_distinct("_source").alias("n")).first()["n"]
    # a text that very many sources have is handed out in several lists
    part = F.pmod(F.xxhash64("_source"), F.lit(1 + sources // LIST))
    counted = rows.groupBy("_lang", "_digest", "_source").agg(F.count("*").alias("_n"))
    lists = counted.groupBy("_lang", "_digest", part.alias("_part")).agg(F.collect_list(F.struct("_source", "_n")).alias("_copies"))
    different = rows.groupBy("_lang", "_digest").agg(F.first("_text").alias("_text"))
    return different.join(lists, ["_lang", "_digest"]).select("_lang", "_text", "_copies")


def _tallied(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flushed() -> pd.DataFrame:
        langs, sources, terms, uses, texts = [], [], [], [], []
        for (lang, source), (use, have) in seen.items():
            langs += [lang] * len(use)
            sources += [source] * len(use)
            terms += [t.decode("utf-8", "replace") for t in use]
            uses += use.values()
            texts += [have[t] for t in use]
        seen.clear()
        return pd.DataFrame({"_lang": langs, "_source": sources, "_term": terms, "_uses": np.array(uses, np.int64), "_docs": np.array(texts, np.int64)})

    held = 0
    for pdf in batches:
        for lang, text, copies in zip(pdf["_lang"], pdf["_text"], pdf["_copies"]):
            found = terms_of(text)
            if not found:
                continue
            once: Counter | None = None
            for copy in copies:
                use, have = seen.setdefault((lang, copy["_source"]), (Counter(), Counter()))
                held -= len(use)
                if len(copies) == 1 and copy["_n"] == 1:
                    use.update(found)
                    have.update(set(found))
                else:
                    once = once or Counter(found)
                    for t, n in once.items():
                        use[t] += n * copy["_n"]
                        have[t] += copy["_n"]
                held += len(use)
            if held > most:
                yield flushed()
                held = 0
    if seen:
        yield flushed()


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(_lang, _term, _source, _count, _all): occurrences of each term kept in each source that has it, and in the language."""
    tallied = collapsed(docs).mapInPandas(partial(_tallied, most=HELD), "_lang string, _source string, _term string, _uses bigint, _docs bigint")
    # tasks have added up what they read, so terms are dealt out once, by what both sums below need
    summed = tallied.repartition("_lang", "_term").groupBy("_lang", "_term", "_source").agg(F.sum("_uses").alias("_count"), F.sum("_docs").alias("_docs"))
    whole = Window.partitionBy("_lang", "_term")
    summed = summed.withColumn("_all", F.sum("_count").over(whole)).withColumn("_in", F.sum("_docs").over(whole))
    return summed.where(F.col("_in") >= least_docs).select("_lang", "_term", "_source", "_count", "_all")


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT * (count + PSEUDO) / (total + PSEUDO * terms)), beyond 64 bits inside."""
    return F.expr(f"1 + (cast({count} + {PSEUDO} as decimal(20,0)) * {UNIT}) div cast({total} + {PSEUDO} * {terms} as decimal(20,0))")


def _compared(pdf: pd.DataFrame, tile: int) -> pd.DataFrame:
    """Sums of one block of terms over pairs of sources of two tiles: how much more they differ than two sources without the term."""
    marks = pdf[pdf["_term"].isna()].sort_values("_at")
    at, rest = marks["_at"].to_numpy(), marks["_rest"].to_numpy()
    entries = pdf[pdf["_term"].notna()]
    term, names = pd.factorize(entries["_term"])
    dense = np.repeat(rest[:, None], len(names), 1)
    dense[np.searchsorted(at, entries["_at"].to_numpy()), term] = entries["_share"].to_numpy()
    low, high = int(pdf["_low"].iloc[0]), int(pdf["_high"].iloc[0])
    own, other = np.flatnonzero(at // tile == low), np.flatnonzero(at // tile == high)
    parts = []
    for i in own:
        j = other[at[other] > at[i]]
        apart = np.abs(dense[j] - dense[i]).sum(1) - len(names) * np.abs(rest[j] - rest[i])
        parts.append(pd.DataFrame({"_a": at[i], "_b": at[j], "_sum": apart}))
    out = pd.concat(parts) if parts else pd.DataFrame({"_a": [], "_b": [], "_sum": []})
    return out.assign(_lang=pdf["_lang"].iloc[0])[["_lang", "_a", "_b", "_sum"]]


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = 50) -> tuple[DataFrame, DataFrame]:
    """How far the sources of each language in ``docs`` (text, lang, source) lie apart, and by which terms.

    Pairs (lang, source, other, distance, rank): a row for every two sources of a language in both orders, with the summed
    difference of their shares over the terms kept; rank from 1 by distance, largest first, then by name. Terms (lang, source, term,
    excess, rank): the ``top_terms`` terms that a source uses more than its language as a whole, by excess, then by term.

    Null text, lang and source count as empty. A source whose texts have no terms is compared like others, with the smoothed
    shares of nothing; in a language without terms kept all distances are 0. Repeated rows count as often as they occur; ids and
    other columns play no part; an empty table gives empty results.
    """
    kept = written(term_counts(docs, least_docs), "term-counts")
    blank = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    sizes = kept.groupBy("_lang", "_term").agg(F.first("_all").alias("_all")).groupBy("_lang").agg(F.count("*").alias("_terms"), F.sum("_all").alias("_lang_total"))
    totals = kept.groupBy("_lang", "_source").agg(F.sum("_count").alias("_total"))
    groups = docs.select(blank("lang").alias("_lang"), blank("source").alias("_source")).distinct()
    groups = groups.join(totals, ["_lang", "_source"], "left").join(sizes, "_lang", "left").na.fill(0, ["_total", "_terms", "_lang_total"])
    groups = groups.withColumn("_rest", F.when(F.col("_terms") > 0, share("0", "_total", "_terms")).otherwise(0))
    groups = written(groups.withColumn("_at", F.row_number().over(Window.partitionBy("_lang").orderBy("_source")) - 1), "sources")

    entries = kept.join(groups, ["_lang", "_source"]).withColumn("_share", share("_count", "_total", "_terms"))
    last = groups.groupBy("_lang").agg(F.floor(F.max("_at") / TILE).alias("_last"))
    blocks = F.ceil(F.col("_terms") / BLOCK_TERMS)
    block = F.pmod(F.xxhash64("_term"), blocks).alias("_block")
    mark = F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("_block")
    columns = ("_lang", "_at", "_rest", "_term", "_share")
    cells = entries.select(*columns, block).unionByName(groups.where("_terms > 0").select("_lang", "_at", "_rest", F.lit(None).cast("string").alias("_term"), F.lit(None).cast("bigint").alias("_share"), mark))
    # every two tiles meet once; with up to TILE sources there is one
    cells = cells.join(last, "_lang").withColumn("_tile", F.floor(F.col("_at") / TILE)).withColumn("_with", F.explode(F.sequence(F.lit(0).cast("bigint"), "_last")))
    cells = cells.select(*columns, "_block", F.least("_tile", "_with").alias("_low"), F.greatest("_tile", "_with").alias("_high"))
    tile = TILE
    sums = cells.groupBy("_lang", "_block", "_low", "_high").applyInPandas(lambda pdf: _compared(pdf, tile), "_lang string, _a int, _b int, _sum bigint")
    sums = sums.groupBy("_lang", "_a", "_b").agg(F.sum("_sum").alias("_sum"))
    both = sums.union(sums.select("_lang", F.col("_b").alias("_a"), F.col("_a").alias("_b"), "_sum"))
    one = groups.select("_lang", "_source", F.col("_at").alias("_a"), F.col("_rest").alias("_p"), "_terms")
    two = groups.select("_lang", F.col("_source").alias("_item"), F.col("_at").alias("_b"), F.col("_rest").alias("_q"))
    pairs = one.join(two, "_lang").where("_a != _b").join(both, ["_lang", "_a", "_b"], "left")
    pairs = pairs.withColumn("_value", F.col("_terms") * F.abs(F.col("_p") - F.col("_q")) + F.coalesce("_sum", F.lit(0)))

    more = entries.withColumn("_excess", F.col("_share") - share("_all", "_lang_total", "_terms")).where("_excess > 0")
    order = lambda value, item: F.row_number().over(Window.partitionBy("_lang", "_source").orderBy(F.col(value).desc(), item))
    named = [F.col("_lang").alias("lang"), F.col("_source").alias("source")]
    pairs = pairs.select(*named, F.col("_item").alias("other"), F.col("_value").cast("bigint").alias("distance"), order("_value", "_item").alias("rank"))
    terms = more.withColumn("rank", order("_excess", "_term")).where(F.col("rank") <= top_terms)
    return pairs, terms.select(*named, F.col("_term").alias("term"), F.col("_excess").cast("bigint").alias("excess"), "rank")


def digest(pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """Both results of ``audit`` as one table: lang, source, part, item, value, rank."""
    one = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), F.col("distance").alias("value"), "rank")
    return one.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.col("excess").alias("value"), "rank"))
