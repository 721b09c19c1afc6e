"""Phrases whose words stand together more often than apart, counted by tries of candidates.

Words are counted first; those that occur LEAST times get a code, and texts are written as arrays of codes in which a rarer word
and the end of a piece are both 0, so no phrase runs over one. Then phrases grow by a word a round. A phrase that occurs often
enough has a beginning and an end, one word shorter, that do too, so a round proposes only windows of which both are candidates,
and keeps those that the tasks' sums let through. Candidates form a double-array trie: a state's child by a symbol is at base +
symbol and is its own where check names the state. The trie is broadcast, and all positions of a batch of texts take one step at
once for each level. The last pass lets all positions run through the trie of all lengths and counts the states they stop in;
the counts of all shards are summed.

A trie holds at most TRIE_PHRASES phrases. More are cut by their first word into several tries, each with a pass of its own over the
coded texts, and words beyond BROADCAST_WORDS are coded by a join instead of a table sent to the tasks: more rounds, same result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.shared import written

#: Occurrences of a candidate, the longest phrase in words, and phrases a language returns at most.
LEAST, LONGEST, TOP = 100, 5, 2000
#: Phrases in a trie (some 40 bytes each with their words), and words in the table of codes sent to the tasks.
TRIE_PHRASES, BROADCAST_WORDS = 200_000, 1_000_000
#: Counters a task holds before it passes them on; words of the corpus for each bucket of proposals; states in a block of counts.
HELD, BUCKET_WORDS, STATES = 1_000_000, 1_000_000, 8192
#: The language of rows without one.
NO_LANG = "und"

#: ASCII letters in lower case; the signs that end a piece become line feeds, tabs become spaces.
_PIECES = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c == 9 else c for c in range(256))
_PATH = [f"_c{i + 1}" for i in range(LONGEST)]
_PATH_SCHEMA = ", ".join(f"{c} int" for c in _PATH)


def tokens_of(text: str | None) -> list[bytes]:
    """Words in lower case; a line feed stands for the end of a piece."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_PIECES)
    return list(filter(None, raw.replace(b"\n", b" \n ").split(b" ")))


@dataclass
class Trie:
    """Phrases as a double array. State 0 is the root, whose children are found by ``first``; ``symbol`` renumbers codes."""

    first: np.ndarray
    symbol: np.ndarray
    base: np.ndarray
    check: np.ndarray
    paths: np.ndarray

    def states(self, codes: np.ndarray, levels: int) -> list[np.ndarray]:
        """For 1 to ``levels`` words: the state that each position's window ends in, -1 where it leaves the trie."""
        state = self.first.take(codes)
        out = [state]
        symbols = self.symbol.take(codes)
        for k in range(1, levels):
            # windows that are still inside; those that run over the end of the batch leave
            at = np.flatnonzero(state >= 0)
            at = at[at < len(codes) - k]
            before = state[at]
            to = self.base.take(before) + symbols[at + k]
            fits = self.check.take(to) == before
            state = np.full(len(codes), -1, np.int32)
            state[at[fits]] = to[fits]
            out.append(state)
        return out

    @staticmethod
    def of(paths: np.ndarray, words: int) -> Trie:
        """The trie of phrases, given as rows of codes from 1 to ``words`` filled up with 0; every beginning is a phrase itself or is added."""
        width = paths.shape[1]
        cut = lambda rows, k: np.where(np.arange(width) < np.reshape(k, (-1, 1)), rows, 0)
        # rows as bytes sort like the rows themselves, so a parent is found by bisection
        as_bytes = lambda rows: np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * width}").ravel()
        nodes = np.concatenate([cut(paths, k) for k in range(1, width + 1)])
        nodes = nodes[np.unique(as_bytes(nodes), return_index=True)[1]]
        nodes = nodes[nodes[:, 0] > 0]
        depth = (nodes > 0).sum(1)
        last = nodes[np.arange(len(nodes)), depth - 1].astype(np.int64)
        inner = np.flatnonzero(depth > 1)
        parent = np.searchsorted(as_bytes(nodes), as_bytes(cut(nodes[inner], depth[inner] - 1))) if len(inner) else inner
        # frequent followers get small symbols, so that the children of a state lie close together
        uses = np.bincount(last[inner], minlength=words + 1)
        followers = int((uses > 0).sum())
        symbol = np.zeros(words + 1, np.int32)  # 0: never a follower
        symbol[np.argsort(-uses, kind="stable")[:followers]] = np.arange(1, followers + 1)
        wanted = symbol[last[inner]].astype(np.int64)

        heads = np.flatnonzero(depth == 1)
        slot = np.zeros(len(nodes), np.int64)
        slot[heads] = np.arange(1, len(heads) + 1)  # slot 0 is the root
        offset = np.full(len(nodes), -1, np.int64)
        used = np.ones(len(heads) + 1, bool)
        used.resize(len(heads) + 2 * len(nodes) + 4 * followers + 64, refcheck=False)
        order = np.lexsort((wanted, parent))
        starts = np.flatnonzero(np.diff(parent[order], prepend=-1))
        sizes = np.diff(starts, append=len(order))
        lowest = len(heads) + 1  # all slots below are taken
        begin: dict[int, int] = {}  # where a state of so many children last found room: before it there is hardly any
        # states with many children first: they need room that later ones fill up
        for g in np.argsort(-sizes, kind="stable")[: int((sizes > 1).sum())]:
            kids = order[starts[g] : starts[g] + sizes[g]]
            need = wanted[kids] - wanted[kids[0]]
            alike = len(kids).bit_length()
            seen, reach = max(lowest, int(wanted[kids[0]]), begin.get(alike, 0)), 256
            while True:
                if seen + reach + followers + 1 > len(used):
                    used.resize(2 * len(used) + reach, refcheck=False)
                free = seen + np.flatnonzero(~used[seen : seen + reach])
                for n in need[1:]:
                    if not len(free):
                        break
                    free = free[~used[free + n]]
                if len(free):
                    break
                seen, reach = seen + reach, min(8 * reach, 1 << 18)
            at, begin[alike] = int(free[0]), max(seen, begin.get(alike, 0))
            offset[parent[kids[0]]] = at - int(wanted[kids[0]])
            used[at + need] = True
            slot[inner[kids]] = at + need
            while used[lowest]:
                lowest += 1
        # a single child can stand in any free slot beyond its symbol
        single = order[starts[sizes == 1]]
        floor = max(lowest, followers)
        if floor + len(single) + 1 > len(used) - int(used[floor:].sum()):
            used.resize(len(used) + floor + len(single) + 1, refcheck=False)
        free = floor + np.flatnonzero(~used[floor:])[: len(single)]
        slot[inner[single]] = free
        offset[parent[single]] = free - wanted[single]

        top = int(slot.max(initial=0)) + 1
        base = np.full(top, top, np.int32)  # a state without children points at the end, where no slot is anyone's
        base[slot] = np.where(offset >= 0, offset, top)
        check = np.full(top + followers + 2, -1, np.int32)
        check[slot[inner]] = slot[parent]
        place = np.zeros((top, width), np.int32)
        place[slot] = nodes
        first = np.full(words + 1, -1, np.int32)
        first[last[heads]] = slot[heads]
        return Trie(first, symbol, base, check, place)


def _lang(docs: DataFrame) -> Column:
    return F.coalesce(docs["lang"].cast("string"), F.lit(NO_LANG))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(_lang(docs).alias("_lang"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("_text"))


def _words(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    counts: dict[str, Counter] = {}

    def flushed() -> pd.DataFrame:
        out = pd.DataFrame([(lang, w.decode("utf-8", "replace"), n) for lang, c in counts.items() for w, n in c.items() if w != b"\n"], columns=["_lang", "_word", "_n"])
        counts.clear()
        return out

    for pdf in batches:
        for lang, text in zip(pdf["_lang"], pdf["_text"]):
            counts.setdefault(lang, Counter()).update(tokens_of(text))
        if sum(map(len, counts.values())) > most:
            yield flushed()
    yield flushed()


def word_counts(docs: DataFrame) -> DataFrame:
    """(_lang, _word, _n): occurrences of every word in every language."""
    return _texts(docs).mapInPandas(partial(_words, most=HELD), "_lang string, _word string, _n bigint").groupBy("_lang", "_word").agg(F.sum("_n").alias("_n"))


def coded_words(frequent: DataFrame) -> DataFrame:
    """(_lang, _word, _n, _code): words with codes from 1 without gaps; ``frequent`` is a written table."""
    numbered = written(frequent.withColumn("_at", F.monotonically_increasing_id()), "words")
    part, row = F.shiftrightunsigned("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = {r["_part"]: r["n"] for r in numbered.groupBy(part).agg(F.count("*").alias("n")).collect()}  # a row for each file
    starts = [0]
    for p in range(max(sizes, default=-1) + 1):
        starts.append(starts[-1] + sizes.get(p, 0))
    start = F.element_at(F.array(*[F.lit(s) for s in starts]), (F.shiftrightunsigned("_at", 33) + 1).cast("int"))
    return numbered.select("_lang", "_word", "_n", (start + row + 1).cast("int").alias("_code"))


def _packed(codes: np.ndarray) -> bytes:
    """Codes in 32 bits; of zeros that follow each other one stays."""
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    return codes[keep].astype("<i4").tobytes()


def coded_texts(docs: DataFrame, words: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(_codes binary): the texts with a code for each frequent word of their language, and 0 for what no phrase runs over."""
    if words.count() <= broadcast_words:
        table: dict[str, dict[bytes, int]] = {}
        for r in words.select("_lang", "_word", "_code").toLocalIterator():
            table.setdefault(r["_lang"], {})[r["_word"].encode()] = r["_code"]
        send = docs.sparkSession.sparkContext.broadcast(table)

        def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for lang, text in zip(pdf["_lang"], pdf["_text"]):
                    get = send.value.get(lang, {}).get
                    out.append(_packed(np.array([get(w, 0) for w in tokens_of(text)], np.int64)))
                yield pd.DataFrame({"_codes": out})

        return _texts(docs).mapInPandas(coded, "_codes binary")

    # words with their places, coded by a join; a text's words come together again by the row's number
    rows = written(_texts(docs).withColumn("_row", F.monotonically_increasing_id()), "rows")

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row, lang, text in zip(pdf["_row"], pdf["_lang"], pdf["_text"]):
                found = np.array([w.decode("utf-8", "replace") for w in tokens_of(text)], object)
                if len(found):
                    yield pd.DataFrame({"_row": row, "_at": np.arange(len(found), dtype=np.int32), "_lang": np.full(len(found), lang, object), "_word": found})

    places = rows.mapInPandas(placed, "_row bigint, _at int, _lang string, _word string")
    known = places.join(words.select("_lang", "_word", "_code"), ["_lang", "_word"], "left")
    ordered = F.array_sort(F.collect_list(F.struct("_at", F.coalesce("_code", F.lit(0)).alias("_code"))))
    texts = known.groupBy("_row").agg(F.transform(ordered, lambda x: x["_code"]).alias("_list"))

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"_codes": [_packed(np.array(c, np.int64)) for c in pdf["_list"]]})

    return texts.select("_list").mapInPandas(listed, "_codes binary")


def _joined(pdf: pd.DataFrame) -> np.ndarray:
    """The codes of a batch of texts one after the other, with a 0 between."""
    return np.frombuffer(b"\0\0\0\0".join(pdf["_codes"]) + b"\0\0\0\0", "<i4")


def _frame(paths: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    filled = np.zeros((len(paths), LONGEST), np.int32)
    filled[:, : paths.shape[1]] = paths
    return pd.DataFrame(filled, columns=_PATH).assign(_n=counts.astype(np.int64))


def _small(values: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes each as the largest takes; the first byte says how many."""
    kind = np.dtype(np.min_scalar_type(int(values.max(initial=0))))
    return bytes([kind.itemsize]) + values.astype(kind).tobytes()


def _large(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"u{raw[0]}", offset=1).astype(np.int64)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    values, at = np.unique(np.concatenate(keys), return_inverse=True)
    return values, np.bincount(at, np.concatenate(counts), len(values)).astype(np.int64)


def _proposed(texts: DataFrame, send, words: int, length: int, own, least: int, buckets: int) -> DataFrame:
    """Windows of ``length`` words whose beginning and end, a word shorter, are candidates, and that occur ``least`` times.

    A window is a number: the state (or word) of its beginning and its last word. Tasks send the numbers they met, with counts, as
    gaps: numbers are turned about within their bits, so that buckets, ranges of them, are even, and lie close in each.
    """
    heads = len(send.value.paths) if send else words + 1
    bits = max(1, (heads * (words + 1)).bit_length())
    turn, mask = 0x9E3779B97F4A7C15 | 1, (1 << bits) - 1
    back = pow(turn, -1, 1 << bits)
    wide = -(-(1 << bits) // buckets)

    def propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie: Trie | None = send.value if send else None
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0

        def out() -> pd.DataFrame:
            key, n = _summed(keys, counts)
            key = key.astype(np.uint64) * np.uint64(turn) & np.uint64(mask)
            order = np.argsort(key)
            key, n = key[order].astype(np.int64), n[order]
            bucket = key // wide
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            pieces = list(zip(cuts, np.append(cuts[1:], len(key))))
            gaps = [_small(np.diff(key[i:j], prepend=bucket[i] * wide)) for i, j in pieces]
            return pd.DataFrame({"_bucket": bucket[cuts], "_gaps": gaps, "_counts": [_small(n[i:j]) for i, j in pieces]})

        for pdf in batches:
            codes = _joined(pdf)
            head = trie.states(codes, length - 1)[-1] if trie else np.where(codes > 0, codes, -1)
            fits = np.zeros(len(codes), bool)
            stop = len(codes) - length + 1
            if stop <= 0:
                continue
            # the end begins a word later; one that another trie holds is not asked for
            fits[:stop] = (head[:stop] >= 0) & (codes[length - 1 :] > 0) & ((head[1 : stop + 1] >= 0) | ~own(codes[1 : stop + 1]))
            key, n = np.unique(head[fits].astype(np.int64) * (words + 1) + codes[np.flatnonzero(fits) + length - 1], return_counts=True)
            keys.append(key)
            counts.append(n)
            held += len(key)
            if held > HELD:
                merged, sums = _summed(keys, counts)
                keys, counts, held = [merged], [sums], len(merged)
                if held > HELD // 2:
                    yield out()
                    keys, counts, held = [], [], 0
        if held:
            yield out()

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = [key[0] * wide + np.cumsum(_large(g)) for g in pdf["_gaps"]]
        values, n = _summed(found, [_large(c) for c in pdf["_counts"]])
        values, n = values[n >= least], n[n >= least]
        values = (values.astype(np.uint64) * np.uint64(back) & np.uint64(mask)).astype(np.int64)
        head, tail = values // (words + 1), (values % (words + 1))[:, None]
        return _frame(np.concatenate([send.value.paths[head][:, : length - 1] if send else head[:, None], tail], 1), n)

    return texts.mapInPandas(propose, "_bucket bigint, _gaps binary, _counts binary").groupBy("_bucket").applyInPandas(add, f"{_PATH_SCHEMA}, _n bigint")


def _counted(texts: DataFrame, send, length: int, least: int) -> DataFrame:
    """Phrases of the trie that occur ``least`` times: each position counts once for each state it passes; shards' counts come in blocks of states."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie: Trie = send.value
        total = np.zeros(len(trie.paths), np.int64)
        for pdf in batches:
            for state in trie.states(_joined(pdf), length)[1:]:
                total += np.bincount(state[state >= 0], minlength=len(total))
        blocks = [i for i in range(0, len(total), STATES) if total[i : i + STATES].any()]
        yield pd.DataFrame({"_block": np.array(blocks, np.int64), "_counts": [_small(total[i : i + STATES]) for i in blocks]})

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(_large(c) for c in pdf["_counts"])
        met = np.flatnonzero(total >= least)
        return _frame(send.value.paths[key[0] + met], total[met])

    return texts.mapInPandas(count, "_block bigint, _counts binary").groupBy("_block").applyInPandas(add, f"{_PATH_SCHEMA}, _n bigint")


def _everything(codes: np.ndarray) -> np.ndarray:
    return np.ones(len(codes), bool)


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, trie_phrases: int = TRIE_PHRASES, broadcast_words: int = BROADCAST_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases (_c1 to _c5, _n) of 2 to ``longest`` words that occur ``least`` times, by the codes of their words; the words (_lang,
    _word, _n, _code) that do; and the number of all words (_lang, _total)."""
    context = docs.sparkSession.sparkContext
    counted = written(word_counts(docs), "word-counts")
    totals = counted.groupBy("_lang").agg(F.sum("_n").alias("_total"))
    words = written(coded_words(written(counted.where(F.col("_n") >= least), "frequent")), "codes")
    size, buckets = words.count(), 1 + (totals.agg(F.sum("_total").alias("n")).first()["n"] or 0) // BUCKET_WORDS
    texts = written(coded_texts(docs, words, broadcast_words), "coded-texts")

    def tries(candidates: list[DataFrame]) -> Iterator[tuple]:
        """The tries of all candidates so far, one after the other, and which first words are theirs."""
        rows = candidates[0]
        for more in candidates[1:]:
            rows = rows.union(more)
        shards = max(1, -(-rows.count() // trie_phrases))
        for shard in range(shards):
            mine = rows.where(F.col("_c1") % shards == shard).select(*_PATH) if shards > 1 else rows.select(*_PATH)
            paths = mine.toPandas().to_numpy(np.int32)  # about ``trie_phrases`` rows of five numbers
            send = context.broadcast(Trie.of(paths, size))
            yield send, (lambda codes, shard=shard: codes % shards == shard) if shards > 1 else _everything

    empty = docs.sparkSession.createDataFrame([], f"{_PATH_SCHEMA}, _n bigint")
    candidates: list[DataFrame] = []
    for length in range(2, longest + 1):
        known = [(None, _everything)] if length == 2 else tries(candidates)
        proposals = [_proposed(texts, send, size, length, own, least, buckets) for send, own in known]
        rows = proposals[0]
        for more in proposals[1:]:
            rows = rows.union(more)
        found = written(rows, f"phrases-{length}")
        if found.isEmpty():
            break
        candidates.append(found)
    if not candidates:
        return empty, words, totals
    shards = [_counted(texts, send, len(candidates) + 1, least) for send, _ in tries(candidates)]
    rows = shards[0]
    for more in shards[1:]:
        rows = rows.union(more)
    counts = written(rows.where("_c2 > 0"), "phrases")
    return counts, words, totals


def _path(codes: Column) -> list[Column]:
    """The columns of a phrase given as an array of codes."""
    return [F.coalesce(F.try_element_at(codes, F.lit(i + 1)), F.lit(0)).alias(c) for i, c in enumerate(_PATH)]


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, trie_phrases: int = TRIE_PHRASES, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language in ``docs`` (text, lang).

    A phrase of 2 to ``longest`` words that occurs ``least`` times (a) is cut where floor(1000 * a * n / (l * r)) is least; l and r
    count both parts, n all words of the language. Phrases inside a longer one that occurs as often go. Null text counts as empty, null
    lang as ``und``; repeated rows count as often as they occur; equal scores are ordered by a, then by phrase; ids and other columns
    play no part; an empty table, or one without frequent phrases, gives an empty result.
    """
    counts, words, totals = phrase_counts(docs, least, longest, trie_phrases, broadcast_words)
    codes = F.filter(F.array(*_PATH), lambda c: c > 0)
    phrases = counts.withColumn("_codes", codes).withColumn("_size", F.size(codes))

    inside = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("_size") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("_size") - k + 1), lambda i: F.slice("_codes", i, k)))))
    longer = phrases.where("_size > 2").select("_n", inside.alias("_part")).groupBy("_part").agg(F.max("_n").alias("_longer"))
    lasting = phrases.join(longer, phrases["_codes"] == longer["_part"], "left").where(F.coalesce(F.col("_longer") < F.col("_n"), F.lit(True))).drop("_part", "_longer")

    single = words.select(*_path(F.array("_code")), F.col("_n"))
    known = counts.select(*_PATH, "_n").union(single)
    cuts = lasting.select("_codes", F.col("_n").alias("_a"), F.explode(F.sequence(F.lit(1), F.col("_size") - 1)).alias("_k"))
    cuts = cuts.withColumn("_left", F.struct(*_path(F.slice("_codes", F.lit(1), F.col("_k"))))).withColumn("_right", F.struct(*_path(F.expr("slice(_codes, _k + 1, size(_codes) - _k)"))))
    part = known.select(F.struct(*_PATH).alias("_key"), F.col("_n").alias("_f"))
    cuts = cuts.join(part.withColumnsRenamed({"_key": "_left", "_f": "_l"}), "_left").join(part.withColumnsRenamed({"_key": "_right", "_f": "_r"}), "_right")
    home = words.select(F.col("_code").alias("_first"), "_lang").join(totals, "_lang")
    cuts = cuts.withColumn("_first", F.col("_codes")[0]).join(home, "_first")
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(_a as decimal(16,0)) * cast(_total as decimal(16,0))) div (cast(_l as decimal(19,0)) * cast(_r as decimal(19,0)))")
    worst = cuts.withColumn("_score", score).groupBy("_lang", "_codes").agg(F.min(F.struct("_score", "_k", "_a", "_l", "_r", "_total")).alias("_w"))
    names = worst.select("_codes", F.posexplode("_codes").alias("_i", "_code")).join(words.select("_code", "_word"), "_code")
    names = names.groupBy("_codes").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_word"))), lambda x: x["_word"]), " ").alias("phrase"))
    ranked = worst.join(names, "_codes").withColumn("rank", F.row_number().over(Window.partitionBy("_lang").orderBy(F.col("_w._score").desc(), F.col("_w._a").desc(), "phrase")))
    return ranked.where(F.col("rank") <= top).select(
        F.col("_lang").alias("lang"), "rank", "phrase", F.col("_w._a").alias("a"), F.col("_w._l").alias("l"), F.col("_w._r").alias("r"), F.col("_w._total").alias("n"), F.col("_w._score").alias("score")
    )
