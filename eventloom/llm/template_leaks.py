"""Benchmark decontamination by templates, with DataFrame functions only.

A text's template has typed placeholders for what a question can be re-parameterised with: numbers (one with its separators),
units behind a number, and names (runs of capitalised words on a line, function words apart, wherever they stand). A text has two
readings: by case, with names, and without case, where names are words like others, so that a copy in other case is found too.
Windows of WINDOW template words are hashed and joined with those of the benchmark items; a window with hardly any word besides
its slots is hashed by its literal words, so it meets verbatim text only. A match is a document's and an item's words on one diagonal
(the offset between both) in matched windows. It counts when it covers LEAST_WORDS words or a whole shorter item. Then the slots are compared: an item's value must stand for one value of the document throughout and
the other way round, and a match with other values must have LEAST_LITERALS plain words, so a re-parameterised question is caught,
and text that is alike in form only is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.shared import id_or_none, texts

WINDOW = 8
#: Words that a match covers at least; plain words it needs (or half of the item's) where a slot's value differs.
LEAST_WORDS, LEAST_LITERALS = 13, 5
#: Windows of the benchmark's distinct texts up to which they are sent to every executor. Beyond, their distinct hashes are sent to pick
#: the documents' windows that are shuffled to them, and beyond BROADCAST_HASHES all windows are shuffled.
BROADCAST_WINDOWS, BROADCAST_HASHES = 500_000, 1_000_000

# Unit names as they stand in questions.
UNITS = (
    "kilometers kilometres kilometer kilometre meters metres meter metre centimeters centimetres centimeter centimetre miles mile feet foot inches inch yards yard "
    "kilograms kilogram grams gram pounds pound ounces ounce tons tonnes liters litres liter litre gallons gallon hours hour minutes minute seconds second days day "
    "weeks week months month years year dollars dollar cents cent euros euro percent degrees degree km cm mm kg mg lb lbs oz ml mph kmh"
).split()
#: Function words (English, Spanish, German, French) that may begin a sentence and are no part of a name.
FUNCTION_WORDS = (
    "a an the this that these those in on at by for from to of with without into after before during between under over about as if when while where which who whom whose what why how "
    "and or but so then there here it its he she they we you his her their our your is are was were do does did can could will would should may must has have had let find solve "
    "el la los las un una unos unas en de del al con sin por para si cuando donde que como y o pero se su sus es son der die das ein eine im am von zu mit ohne wenn wann wo wer wie und oder aber "
    "le les une dans du des au aux avec sans pour par sur quand est sont et ou mais il elle ils elles"
).split()
#: First characters of a slot, the sign between a name's words, and the one in place of a number's separators.
MARK, JOIN, POINT = "\u0001", "\u0002", "\u0003"
#: The readings of a text.
BY_CASE, CASELESS = 1, 0


def _tagged(text: Column) -> Column:
    """The words in lower case, a space between; a slot is the mark, its type (n name, d number, u unit) and its value."""
    name = rf"(?=\p{{Lu}}\p{{Ll}})(?<!\p{{L}})(?!(?i:{'|'.join(FUNCTION_WORDS)})(?![\p{{L}}\p{{N}}]))"
    marked = F.contains(text, F.lit(MARK)) | F.contains(text, F.lit(JOIN)) | F.contains(text, F.lit(POINT))
    t = F.when(marked, F.translate(text, MARK + JOIN + POINT, "   ")).otherwise(text)
    t = F.regexp_replace(t, r"[.,](?=\p{N})(?<=\p{N}[.,])", POINT)
    t = F.regexp_replace(t, name, f"{MARK}n")
    # a run of names on one line is one
    t = F.regexp_replace(t, rf"(?=[\x20\x09]+{MARK}n)(?<={MARK}n\p{{L}}{{1,60}})[\x20\x09]+{MARK}n", JOIN)
    t = F.regexp_replace(t, rf"(\p{{N}}[\p{{N}}{POINT}]*)", f" {MARK}d$1 ")
    t = F.regexp_replace(F.lower(t), rf"({MARK}d[\p{{N}}{POINT}]+[\x20-]+)(?:{MARK}n)?(?=(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}]))", f"$1{MARK}u")
    return F.regexp_replace(t, rf"[^\p{{L}}\p{{N}}{MARK}{JOIN}{POINT}]+", " ")


def _read(tagged: Column, reading: int) -> Column:
    """The tagged text in one reading: without case, names are plain words."""
    return tagged if reading == BY_CASE else F.replace(F.replace(tagged, F.lit(MARK + "n"), F.lit("")), F.lit(JOIN), F.lit(" "))


def _words(text: Column) -> Column:
    return F.when(F.trim(text) == "", F.array().cast("array<string>")).otherwise(F.split(F.trim(text), " "))


def _template(words: Column) -> Column:
    """Words, a space between, with each slot's mark and type only."""
    return F.regexp_replace(words, f"({MARK}[ndu])[^ ]*", "$1")


def _is_slot(w: Column) -> Column:
    return F.startswith(w, F.lit(MARK))


def _kind(w: Column) -> Column:
    """A word as its template has it."""
    return F.when(_is_slot(w), F.substring(w, 1, 2)).otherwise(w)


def _readings(tagged: Column, which: list[int]) -> Column:
    """(_reading, _words, _kinds) of a tagged text, one for each reading; without names the one by case is the other, and empty here."""
    none = F.array().cast("array<string>")
    named = lambda r, c: c if r == CASELESS else F.when(F.contains(tagged, F.lit(MARK + "n")), c).otherwise(none)
    return F.array(*[F.struct(F.lit(r).alias("_reading"), named(r, _words(_read(tagged, r))).alias("_words"), named(r, _words(_template(_read(tagged, r)))).alias("_kinds")) for r in which])


def _windows(rows: DataFrame, ks: list[int], own: list[str]) -> DataFrame:
    """(own columns, _reading, _pos, _words, _k, _h) for each window of k words, k in ``ks``; ``rows`` has _reading, _words and _kinds.

    A row refers to its text's words; they are not copied as long as it stays in the generated code, so callers take what they need
    of them before a shuffle or an aggregation, and before a join whose rows go there: rows that leave the generated code are copied, those of
    a whole text at once.
    """
    rows = rows.select(*own, "_reading", "_words", "_kinds", F.posexplode("_words").alias("_pos", "_w0"))

    def window(k: int) -> Column:
        words, kinds = ([F.get(c, F.col("_pos") + i) for i in range(k)] for c in ("_words", "_kinds"))
        plain = sum((F.when(_is_slot(t), 0).otherwise(1) for t in kinds), F.lit(0))
        # a window with hardly a word besides its slots goes by their values
        h = F.when(plain >= (2 if k > 5 else 1), F.xxhash64("_reading", F.lit(k), *kinds)).otherwise(F.xxhash64("_reading", F.lit(-k), *words))
        return F.when(F.col("_pos") + k <= F.size("_kinds"), h)

    rows = rows.select(*own, "_reading", "_pos", "_words", "_kinds")
    if len(ks) == 1:
        return rows.select("*", F.lit(ks[0]).alias("_k"), window(ks[0]).alias("_h")).drop("_kinds")
    return rows.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("_k"), window(k).alias("_h")) for k in ks])).alias("_x")).select(*own, "_reading", "_pos", "_words", "_x._k", "_x._h")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_words, coverage, n_slots, reparameterised): a row for each document of ``docs`` (doc_id, text) and item of
    ``benchmark`` (item_id, text) that it holds, verbatim or with other values in the slots.

    ``n_words`` counts the item's words in the longest consistent match, ``coverage`` their share of the item, ``n_slots`` the slots in it;
    ``reparameterised`` says that a slot's value differs. Null and blank texts on either side match nothing; null ids are matched
    like others (each text by itself, one row for all that hold the item) and given back as null; repeated rows give one row for each
    pair; other columns are ignored; an empty table on either side gives an empty result.
    """
    items = benchmark.select(benchmark["item_id"].cast("string").alias("_item"), _tagged(F.coalesce(benchmark["text"].cast("string"), F.lit(""))).alias("_it"))
    items = items.withColumn("_item", F.coalesce("_item", F.lit(MARK)))
    items = items.select("_item", F.inline(_readings(F.col("_it"), [CASELESS, BY_CASE]))).where(F.size("_words") > 0).withColumn("_which", F.xxhash64("_words"))
    owners, items = items.select("_item", "_which", "_reading").distinct(), items.drop("_item").dropDuplicates(["_which", "_reading"])
    # an item shorter than WINDOW is one window of its own length
    items = items.withColumn("_short", F.least(F.size("_words"), F.lit(WINDOW)))
    ks = sorted(r["_short"] for r in items.select("_short").distinct().collect()) or [WINDOW]  # WINDOW rows at most
    theirs = _windows(items, ks, ["_which", "_short"]).where("_k = _short").select("_which", "_reading", "_k", F.col("_pos").alias("_ipos"), "_h")
    n, readings = theirs.count(), sorted(r["_reading"] for r in items.select("_reading").distinct().collect()) or [CASELESS]

    rows = texts(docs).select("_id", F.xxhash64("_text").alias("_text"), _tagged(F.col("_text")).alias("_t"))
    rows = rows.select("_id", "_text", F.inline(_readings(F.col("_t"), readings)))
    # a window brings its own words, so no text is read again and none is copied with its hits
    ours = _windows(rows, ks, ["_id", "_text"]).select("_id", "_text", "_reading", "_pos", "_k", "_h", F.slice("_words", F.col("_pos") + 1, F.col("_k")).alias("_seen"))
    if n <= BROADCAST_WINDOWS:
        theirs = F.broadcast(theirs)
    else:
        hashes = theirs.select("_h").distinct()
        ours = ours.join(F.broadcast(hashes), ["_h"], "left_semi") if hashes.count() <= BROADCAST_HASHES else ours
    hits = ours.join(theirs, ["_h", "_k", "_reading"])
    hits = hits.groupBy("_id", "_text", "_which", "_reading", (F.col("_pos") - F.col("_ipos")).alias("_diagonal")).agg(F.collect_set(F.struct("_ipos", "_seen")).alias("_hits"))
    words = F.flatten(F.transform("_hits", lambda x: F.transform(x["_seen"], lambda w, i: F.struct((x["_ipos"] + i).alias("i"), w.alias("w")))))
    matches = hits.withColumn("_beside", F.array_sort(F.array_distinct(words))).drop("_hits").join(items.select("_which", "_reading", F.col("_words").alias("_iw")), ["_which", "_reading"])
    alike = lambda x: _kind(F.element_at("_iw", x["i"] + 1)) == _kind(x["w"])
    # what a hash alone took for the same goes
    matches = matches.withColumn("_beside", F.filter("_beside", alike)).where(F.size("_beside") > 0)

    width = lambda w: F.size(F.split(w, JOIN))
    its = lambda x: F.element_at("_iw", x["i"] + 1)
    total = F.aggregate("_iw", F.lit(0), lambda n, w: n + width(w))
    covered = F.aggregate("_beside", F.lit(0), lambda n, x: n + width(its(x)))
    plain = F.size(F.filter("_beside", lambda x: ~_is_slot(its(x))))
    matches = matches.withColumn("_total", total).withColumn("_n", covered).withColumn("_plain", plain)
    matches = matches.where(F.col("_n") >= F.least(F.lit(LEAST_WORDS), F.col("_total")))

    def pair(p: Column) -> Column:
        # a name at the match's border may have run together with a name outside
        x, y = its(p), p["w"]
        loose = ((p["i"] == F.element_at("_beside", 1)["i"]) | (p["i"] == F.element_at("_beside", -1)["i"])) & (width(x) < width(y))
        same = (x == y) | (loose & (F.startswith(y, F.concat(x, F.lit(JOIN))) | F.endswith(y, F.concat(F.lit(JOIN), F.substring(x, 3, 1 << 30)))))
        return F.struct(x.alias("x"), y.alias("y"), loose.alias("loose"), same.alias("same"))

    judged = matches.withColumn("_pairs", F.transform(F.filter("_beside", lambda x: _is_slot(its(x))), pair))
    judged = judged.withColumn("_different", F.array_distinct(F.transform(F.filter("_pairs", lambda p: ~p["loose"]), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))))
    values = lambda side: F.size(F.array_distinct(F.transform("_different", lambda p: p[side])))
    judged = judged.where((F.size("_different") == values("x")) & (F.size("_different") == values("y"))).withColumn("_changed", F.exists("_pairs", lambda p: ~p["same"]))
    judged = judged.where(~F.col("_changed") | (F.col("_plain") >= F.least(F.lit(LEAST_LITERALS), F.ceil(F.size("_iw") / 2))))
    found = judged.groupBy("_id", "_which", "_reading").agg(F.max(F.struct("_n", (F.col("_n") / F.col("_total")).alias("_share"), (~F.col("_changed")).alias("_same"), F.size("_pairs").alias("_slots"), "_changed")).alias("_b"))
    best = found.join(owners, ["_which", "_reading"]).groupBy("_id", "_item").agg(F.max("_b").alias("_b"))
    item = F.when(F.col("_item") != MARK, F.col("_item")).cast(benchmark.schema["item_id"].dataType)
    return best.select(id_or_none("_id").alias("doc_id"), item.alias("item_id"), F.col("_b._n").cast("bigint").alias("n_words"), F.col("_b._share").alias("coverage"), F.col("_b._slots").cast("bigint").alias("n_slots"), F.col("_b._changed").alias("reparameterised"))
