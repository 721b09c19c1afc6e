"""The operators against brute force on small tables, with nulls, blanks, ties, repeated rows and clashing columns."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from eventloom.llm import countmin_spans, disclosure, extendible_index, fm_toxicity, html_regions, minmax_near, simple8b, slack_packing, sparse_suffix, template_leaks
from eventloom.llm.queries import END_ID, tokenizer_path
from eventloom.llm.shared import new_path, prepare
from eventloom.llm.words import window_hashes, word_hashes

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORDS = [a + b for a in "ba ko mi tu re zo na li".split() for b in "s n r lo den vik ma".split()]


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Random texts with exact and near copies, shared passages, a very long text, blanks, and clashing extra columns."""
    prepare(spark)
    rng = random.Random(5)
    base = [prose(rng, rng.choice([3, 8, 40, 120, 260])) for _ in range(60)]
    passage = prose(rng, 70)
    texts = list(base)
    texts += [base[i % 7] for i in range(20)] + [base[3].replace(" ", "\n\t ") for _ in range(3)]
    for i in range(25):  # near copies
        w = base[50 + i % 5].split()
        for _ in range(rng.choice([1, 2, 6])):
            w[rng.randrange(len(w))] = "changed%d" % rng.randrange(99)
        texts.append(" ".join(w))
    texts += [prose(rng, 30) + " " + passage + " " + prose(rng, 20) for _ in range(15)]
    texts += [passage + " " + passage, "x " * 300, prose(rng, 9000), None, "", " \n\t ", "one two", "one  two", "ONE two", "İΣ café x"]
    rng.shuffle(texts)
    rows = [(i, t, "L", i, "S", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, _text string, _id int, component_id string, n int").repartition(7)


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def rows(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_word_hashes_tell_words_and_runs_apart():
    h, s, e = word_hashes("a bb  aé bb\na", lower=True)
    assert len(h) == 5 and h[0] == h[4] and h[1] == h[3] and len(set(h.tolist())) == 3
    assert [b"a bb  a\xc3\xa9 bb\na"[x:y] for x, y in zip(s, e)] == [b"a", b"bb", b"a\xc3\xa9", b"bb", b"a"]
    long = " ".join(f"w{i % 50}" for i in range(400_000))
    h, _, _ = word_hashes(long)
    assert len(h) == 400_000 and len(np.unique(h)) == 50
    w = window_hashes(h, 20)
    assert len(np.unique(w)) == 50 and len(w) == 400_000 - 19 and w[0] == w[50]


def shingle_set(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words(w)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_minmax_near_duplicates(docs, texts, empty):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = rows(minmax_near.near_duplicates(docs))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), find(i), find(i) == i) for i in sets}
    assert minmax_near.near_duplicates(empty).count() == 0


def test_second_round_links_what_stars_miss(spark):
    """A group whose smallest id is similar to few: members still meet each other."""
    rng = random.Random(1)
    base = prose(rng, 200).split()
    made = []
    for g in range(6):
        far = list(base)
        for k in rng.sample(range(200), 7):
            far[k] = f"g{g}x{k}"
        for j in range(3):
            near = list(far)
            near[rng.randrange(200)] = f"j{g}{j}"
            made.append(" ".join(near))
    made = [" ".join(base)] + made
    df = prepare(spark).createDataFrame(list(enumerate(made)), "doc_id bigint, text string")
    sets = [shingle_set(t) for t in made]
    link = [[100 * len(a & b) >= 85 * len(a | b) for b in sets] for a in sets]
    comp = list(range(len(made)))
    for _ in made:
        comp = [min(comp[j] for j in range(len(made)) if link[i][j]) for i in range(len(made))]
    assert [r["component_id"] for r in minmax_near.near_duplicates(df).orderBy("doc_id").collect()] == comp
    assert len(set(comp)) > 3


@pytest.mark.parametrize("linked", [False, True])
def test_a_large_bucket_makes_few_pairs(spark, monkeypatch, linked):
    """Members that nearly all are just below the threshold, and members all linked with each other but not with the smallest ids."""
    rng = random.Random(2)
    base = prose(rng, 200).split()
    # changed words stand apart, so each takes five shingles
    changes = [4] * 70 + [1] * 150 if linked else [3] * 200
    made = []
    for g, n in enumerate(changes):
        w = list(base)
        for k in rng.sample(range(2, 198, 6), n):
            w[k] = f"g{g}x{k}"
        made.append(" ".join(w))
    sets = [shingle_set(t) for t in made]
    near = [(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    comp = list(range(len(sets)))
    for _ in range(9):
        for i, j in near:
            comp[i] = comp[j] = min(comp[i], comp[j])
    tried, confirmed = [], minmax_near.confirmed
    monkeypatch.setattr(minmax_near, "confirmed", lambda pairs, *a: tried.append(pairs.count()) or confirmed(pairs, *a))
    df = prepare(spark).createDataFrame(list(enumerate(made)), "doc_id bigint, text string")
    assert [r["component_id"] for r in minmax_near.near_duplicates(df).orderBy("doc_id").collect()] == comp
    assert (len(near) > 10_000) == linked and sum(tried[1:]) < 10 * len(made)


def test_parities_never_differ_in_more_cells_than_sets_do():
    rng = np.random.default_rng(3)
    for n in (1, 15, 16, 17, 300, 40_000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        others = [np.unique(np.append(a[k:], rng.integers(0, 1 << 63, m, dtype=np.uint64))) for k, m in ((0, 0), (1, 0), (n // 9, n // 7), (0, n), (n, 1))]
        got = minmax_near.apart(minmax_near.parities(a), [minmax_near.parities(o) for o in others])
        real = [len(np.setxor1d(a, o)) for o in others]
        assert got[0] == 0 and all(x <= y for x, y in zip(got, real)) and got[1] == 1 and (n < 300 or n > 1000 or got[2] > 0.9 * real[2])


def brute_windows(texts, k=20):
    first, out = {}, {}
    for i in sorted(texts):
        w = words(texts[i])
        covered = [False] * len(w)
        for s in range(len(w) - k + 1):
            key = tuple(w[s : s + k])
            if key in first:
                covered[s : s + k] = [True] * k
            first.setdefault(key, (i, s))
        kept = [x for x, c in zip(w, covered) if not c]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def test_countmin_windows(docs, texts, empty, monkeypatch):
    want = brute_windows(texts)
    for bits, chunk in ((16, 1_000_000), (8, 500)):
        monkeypatch.setattr(countmin_spans, "LEAST_BITS", bits)
        monkeypatch.setattr(countmin_spans, "sketch_bits", lambda n, b=bits: max(b, 10))
        monkeypatch.setattr(countmin_spans, "CHUNK", chunk)
        got = rows(countmin_spans.repeated_windows_removed(docs))
        assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == want
    assert sum(x[1] for x in want.values()) > 1000
    assert countmin_spans.repeated_windows_removed(empty).count() == 0


def test_countmin_rows_given_twice(docs, spark):
    twice = docs.where("doc_id < 30").union(docs.where("doc_id < 30"))
    got = [tuple(r) for r in countmin_spans.repeated_windows_removed(twice).collect()]
    once = [tuple(r) for r in countmin_spans.repeated_windows_removed(docs.where("doc_id < 30")).collect()]
    assert sorted(got) == sorted(once + once)


def test_sparse_suffix_passages(docs, texts, empty):
    """Every word of a 50-word window found in another document is covered, and every span is such a passage."""
    where = {}
    for i, t in texts.items():
        w = words(t)
        for s in range(len(w) - 49):
            where.setdefault(tuple(w[s : s + 50]), set()).add(i)
    want = {}
    for i, t in texts.items():
        w = words(t)
        covered = set()
        for s in range(len(w) - 49):
            if where[tuple(w[s : s + 50])] - {i}:
                covered |= set(range(s, s + 50))
        if covered:
            want[i] = covered
    got = {i: {p for x in r["spans"].split(",") for p in range(*map(int, x.split(":")))} for i, r in rows(sparse_suffix.repeated_passages(docs)).items()}
    assert got == want and len(want) > 20
    assert sparse_suffix.repeated_passages(empty).count() == 0


def test_sparse_suffix_in_small_chunks(docs, monkeypatch):
    want = sorted(map(tuple, sparse_suffix.repeated_passages(docs).select("doc_id", "spans").collect()))
    monkeypatch.setattr(sparse_suffix, "CHUNK", 50)
    assert sorted(map(tuple, sparse_suffix.repeated_passages(docs).select("doc_id", "spans").collect())) == want


@pytest.mark.parametrize("within", [False, True])
def test_sparse_suffix_of_seeds_with_many_suffixes(spark, docs, monkeypatch, within):
    """Groups too large to be sorted in one task find what sorting them does."""
    rng = random.Random(9)
    shared = prose(rng, 45)  # one seed whose suffixes go on in several ways, before and after it
    ends, fronts = [prose(rng, 30) for _ in range(3)], [prose(rng, 30) for _ in range(3)]
    more = [(1000 + i, f"{rng.choice(fronts)} {shared} {rng.choice(ends)}") for i in range(40)] + [(2000, f"{fronts[0]} {shared} {prose(rng, 5)} {shared} {ends[1]}")]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(more, docs.select("doc_id", "text").schema))
    spans = lambda: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["spans"]) for r in sparse_suffix.repeated_passages(both, within).collect())
    want = spans()
    assert len(want) > 60
    for rows_ in (0, 3, 20):
        monkeypatch.setattr(sparse_suffix, "GROUP_ROWS", rows_)
        assert spans() == want


def test_sparse_suffix_loses_no_partner_of_a_large_group(spark, monkeypatch):
    """All documents hold one run of 46 words; with the five words before it each has one partner, whatever follows."""
    prepare(spark)
    rng = random.Random(21)
    shared, fronts = prose(rng, 46), [prose(rng, 5) for _ in range(40)]
    df = spark.createDataFrame([(i, f"{prose(rng, 9)} end{i} {fronts[i % 40]} {shared} next{i} {prose(rng, 30)}") for i in range(80)], "doc_id long, text string")
    monkeypatch.setattr(sparse_suffix, "GROUP_ROWS", 3)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = {r["doc_id"]: (r["spans"], r["partner_doc_id"]) for r in sparse_suffix.repeated_passages(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert got == {i: ("10:61", (i + 40) % 80) for i in range(80)}


def test_windows_meet_over_chunks():
    """A window's rows that come in several chunks are one group, and a lone one is no match."""
    def chunk(*rows_):
        return pd.DataFrame([(i, q, w, b"12345678" + (i + (1 << 63)).to_bytes(8, "big") + q.to_bytes(4, "big"), None, None) for w, i, q in rows_], columns=["_id", "_at", "_seed", "_cut", "_left", "_right"])

    def run(within):
        got = pd.concat(sparse_suffix._matches(iter([chunk((1, 5, 0), (2, -7, 3)), chunk((2, -7, 9)), chunk((2, 4, 1), (2, 8, 2), (3, 6, 0), (4, 6, 1)), chunk((4, 6, 5))]), 50, within))
        return {tuple(map(int, r)) for r in got.itertuples(index=False)}

    two = {(-7, 3, 53, 4), (-7, 9, 59, 4), (4, 1, 51, -7), (8, 2, 52, -7)}
    assert run(False) == two
    assert {x[:3] for x in run(True)} == {x[:3] for x in two} | {(6, 1, 51), (6, 5, 55)}


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def base_entities(text):
    out = []
    for k, (kind, p) in enumerate(BASE):
        for m in re.finditer(p, text):
            d = re.sub(r"\D", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and disclosure.luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_entities_equal_the_patterns():
    rng = random.Random(3)
    parts = ["a.b@c.de", "@", ".", "x@y", "1.2.3.4", "999.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (517) 555-5141", "+12", "++49 30 1234567", "a@b.c@d.e", "é", " ", "-", "0001.02.3.255", "12345678901234567890", "_%+", "7", "١", "x" * 50]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))
        assert disclosure.entities(t) == base_entities(t), t
    disclosure.entities("a" * 200_000 + "@" + "1" * 200_000 + ".+" + "1." * 50_000)  # linear on long runs


def test_disclosure(spark):
    """A term that stands only near entities is told apart from a common one; the base spans and their hash stay."""
    rng = random.Random(2)
    rows_in = [(i, prose(rng, 20) + f" account zebrafon user{i}.x@mail{i}.org " + prose(rng, 20)) for i in range(8)]
    rows_in += [(100 + i, prose(rng, 60) + " account") for i in range(60)] + [(900, None), (901, ""), (None, "call +1 517 555 5141 now")]
    df = prepare(spark).createDataFrame([(i, t, "x") for i, t in rows_in], "doc_id bigint, text string, spans string")
    got = rows(disclosure.sanitised(df))
    for i, t in rows_in:
        spans = ",".join(f"{BASE[k][0]}:{s}:{e}" for s, k, e in base_entities(t or ""))
        assert got[i]["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert [x for x in got[i]["spans"].split(",") if not x.startswith("term")] == spans.split(",")
        assert (got[i]["n_email"], got[i]["n_phone"]) == (i is not None and i < 8, i is None)
    for i, t in rows_in[:8]:
        s = t.index("zebrafon")
        assert f"term:{s}:{s + 8}" in got[i]["spans"] and "zebrafon" not in got[i]["clean"] and "[EMAIL]" in got[i]["clean"] and "account" in got[i]["clean"]
    assert got[900]["spans"] == got[901]["spans"] == "" and got[900]["clean"] is None
    assert disclosure.sanitised(df.where("false")).count() == 0


def test_template_leaks(spark):
    prepare(spark)
    rng = random.Random(9)
    item = "A train leaves Paris with 120 people and after 3 hours at 80 km it meets a second train from Berlin with 45 people, how far are they apart?"
    plain = prose(rng, 40)
    items = [("q1", item), ("q2", plain), ("q3", "what is six by nine"), ("q4", None), (None, ""), ("q5", item.replace("120", "45"))]
    other = item.replace("Paris", "Oslo").replace("120", "310").replace("Berlin", "Rome").replace("45", "77").replace("80", "95").replace("3 hours", "6 hours")
    mixed = item.replace("120", "45").replace("with 45 people, how", "with 99 people, how")
    docs = [(1, prose(rng, 30) + ". " + item), (2, prose(rng, 30) + ". " + other + " " + prose(rng, 10)), (3, prose(rng, 80)), (4, plain.upper()), (5, "what is six by nine"), (6, None), (7, " "), (8, " ".join(plain.split()[:6])), (None, plain), (9, mixed)]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, item_id string")
    b = spark.createDataFrame(items, "item_id string, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in template_leaks.leaks(d, b).collect()}
    assert {(1, "q1"), (2, "q1"), (4, "q2"), (None, "q2"), (5, "q3")} <= set(got)
    assert not {k for k in got if k[0] in (3, 6, 7, 8)}
    assert got[2, "q1"]["reparameterised"] and not got[1, "q1"]["reparameterised"] and got[2, "q1"]["n_slots"] >= 5
    # q5 has one number twice where document 1 has two: not consistent
    assert (1, "q5") not in got
    assert template_leaks.leaks(d.where("false"), b).count() == template_leaks.leaks(d, b.where("false")).count() == 0
    assert {(r["doc_id"], r["item_id"]) for r in template_leaks.leaks(d.union(d), b.union(b)).collect()} == set(got)


def leak_pairs(spark, docs, items):
    d = prepare(spark).createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id string, text string")
    return {(r["doc_id"], r["item_id"]): r for r in template_leaks.leaks(d, b).collect()}


def test_leaks_full_of_slots(spark):
    """Items whose windows are mostly slots are found verbatim, and not by their form."""
    items = {
        "sum": "Solve 3x + 4y = 12, 5x - 2y = 8",
        "list": "Which of these is the largest: 1,204,500 or 1,240,500 or 1,024,500 or 1,250,400?",
        "table": "12 15 18 21 24 27 30 33 36 39 42 45 48 51 54 57",
        "date": "2024-01-05 10.0.0.1",
    }
    docs = [(i, f"some words before. {t} and some behind") for i, t in enumerate(items.values())]
    docs += [(9, "some words before. 92 95 98 91 94 97 90 93 96 99 92 95 98 91 94 97 and 2023-02-06 10.0.0.2")]
    got = leak_pairs(spark, docs, list(items.items()))
    assert set(got) == set(enumerate(items))
    assert all(r["coverage"] == 1 and not r["reparameterised"] for r in got.values())


def test_leaks_in_other_case_place_and_values(spark):
    """Names at the begin of a sentence, copies in other case, names behind any sign, and values of several words or parts."""
    apples = "Alice has 3 red apples and gives 2 of them to Tom. Alice then buys 5 pears."
    train = "A train leaves Paris at noon and meets Anna near Berlin while Peter waits in Rome for 45 minutes with Maria"
    trade = "A shop in New York sells 1,204,500 books a year, and the owner from New York pays 2.5 percent of it as rent"
    items = [("apples", apples), ("train", train), ("trade", trade)]
    docs = {
        1: ("apples", apples.replace("Alice", "Maria").replace("3", "7")),
        2: ("train", train.lower()),
        3: ("train", train.upper()),
        4: ("train", train.upper().replace("45", "95")),
        5: ("trade", trade.replace("New York", "Berlin").replace("1,204,500", "950")),
        6: ("trade", trade.replace("2.5", "12")),
        7: ("apples", "Dear Reader " + apples + " Good"),
        8: ("apples", "(" + apples.replace("to Tom", 'to "Tom"').replace("Alice", "Zoe").replace("Tom", "Ben") + ")"),
    }
    changed = {1, 4, 5, 6, 8}
    # a name that stands for two is another story
    wrong = [(20, apples.replace("Alice has", "Maria has").replace("Alice then", "Eve then"))]
    got = leak_pairs(spark, [(i, "some words before: " + t) for i, (_, t) in docs.items()] + wrong, items)
    assert set(got) == {(i, item) for i, (item, _) in docs.items()}
    assert {i for (i, _), r in got.items() if r["reparameterised"]} == changed
    assert all(r["coverage"] == 1 for r in got.values())


def shuffled(node):
    """Bytes that each exchange of an executed plan got."""
    name = node.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return shuffled(node.executedPlan())
    if name.endswith("QueryStage"):
        return shuffled(node.plan())
    mine = [node.metrics().get("dataSize").get().value()] if name == "Exchange" else []
    return sum((shuffled(node.children().apply(i)) for i in range(node.children().size())), mine)


@pytest.mark.parametrize("limits", [(500_000, 1_000_000), (0, 1_000_000), (0, 0)])
def test_leaks_with_windows_of_a_large_benchmark(spark, monkeypatch, limits):
    """However the benchmark's windows meet the documents', pairs are the same, and a window brings its own words, not those of its whole text."""
    monkeypatch.setattr(template_leaks, "BROADCAST_WINDOWS", limits[0])
    monkeypatch.setattr(template_leaks, "BROADCAST_HASHES", limits[1], raising=False)
    rng = random.Random(11)
    item, other, short = prose(rng, 30), prose(rng, 20) + " costs 12 euros in Rome", "what is six by nine"
    # two items of one text, one item of two texts, a null id
    items = [("a", item), ("b", item), ("c", other), ("c", short), (None, short)]
    docs = [(1, prose(rng, 2000) + ". " + item + ". " + prose(rng, 1000)), (2, other.replace("12", "15")), (3, "so " + short), (None, item.upper()), (4, prose(rng, 50))]
    d = prepare(spark).createDataFrame(docs, "doc_id bigint, text string")
    found = template_leaks.leaks(d, spark.createDataFrame(items, "item_id string, text string"))
    got = {(r["doc_id"], r["item_id"]): r for r in found.collect()}
    assert set(got) == {(1, "a"), (1, "b"), (2, "c"), (3, "c"), (3, None), (None, "a"), (None, "b")}
    assert {k for k, r in got.items() if r["reparameterised"]} == {(2, "c")} and all(r["coverage"] == 1 for r in got.values())
    # before, each of 3,000 windows took the text's 3,000 words to the shuffle
    assert max(shuffled(found._jdf.queryExecution().executedPlan())) < 4 << 20


@pytest.mark.parametrize("capacity", [4096, 4])
def test_exact_duplicates(docs, texts, empty, capacity):
    norm = {i: SPACE.sub(" ", t or "") for i, t in texts.items()}
    groups = {}
    for i in sorted(norm):
        groups.setdefault(norm[i], []).append(i)
    got = rows(extendible_index.exact_duplicates(docs, capacity))
    want = {i: (groups[t][0], len(groups[t]), groups[t][0] == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}
    assert {i: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for i, r in got.items()} == want
    assert extendible_index.exact_duplicates(empty, capacity).count() == 0


def test_directory_splits_only_full_buckets(docs):
    index, _ = extendible_index.exact_index(docs, 8)
    held = {}
    for r in index.select("_bucket", "_depth", "_key", "_chain").collect():
        held.setdefault((r["_bucket"], r["_depth"]), set()).add(r["_key"])
        assert r["_chain"] == 0
    assert len(held) > 8 and max(map(len, held.values())) <= 8
    # buddies that would fit together were not split
    depth = max(d for _, d in held)
    assert any(d < depth for _, d in held)


def test_documents_are_looked_up_through_the_directory(docs, monkeypatch):
    """Without a bucket's slots its documents are not found; with a chain's first entry gone, nor are the texts it stands for."""
    whole = extendible_index.directory
    monkeypatch.setattr(extendible_index, "directory", lambda keys, capacity: (lambda slots, depth: (slots.where("_bucket <> 0"), depth))(*whole(keys, capacity)))
    index, keys = extendible_index.exact_index(docs, 8)
    found = extendible_index.exact_duplicates(docs, 8).count()
    assert 0 < found == keys.count() < docs.count() and index.where("_bucket = 0").count() == 0


def test_machine_learns_a_pair():
    """Neither term alone says anything; together they do: weights cannot learn that, factors can."""
    rng = np.random.default_rng(0)
    sets, labels = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        sets.append(np.unique(np.concatenate((rng.integers(100, 200, 6), [1] * a + [2] * (1 - a), [3] * b + [4] * (1 - b)))).astype(np.int32))
        labels.append(float(a == b))
    m = fm_toxicity.learn(sets, np.array(labels), rounds=120, rate=0.05, shrink=1e-4)
    assert ((m.score(sets) >= 0.5) == np.array(labels)).mean() > 0.95


def test_toxicity(spark, docs, empty):
    rng = random.Random(4)
    made, marks = [], []
    for i in range(600):
        bad = i % 4 == 0
        w = prose(rng, 60).split()
        for _ in range(3 * bad):
            w.insert(rng.randrange(60), rng.choice(["grobian", "schuft", "lump"]))
        made.append((i, " ".join(w), 1 - bad))
        marks.append((i, int(bad)))
    d = prepare(spark).createDataFrame(made + [(None, None, 0), (1000, "", 0)], "doc_id bigint, text string, toxic int")
    labels = spark.createDataFrame(marks + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    got = rows(fm_toxicity.toxicity(d, labels))
    assert len(got) == 602 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i in range(600))
    assert np.mean([got[i]["predicted"] == (i % 4 == 0) for i in held]) > 0.9
    assert fm_toxicity.toxicity(empty, labels).count() == 0
    assert fm_toxicity.toxicity(d, labels.where("false")).count() == 602


def test_toxicity_is_not_learnt_by_the_driver(spark, monkeypatch):
    d = prepare(spark).createDataFrame([(i, ("schuft " if i % 2 else "freund ") + WORDS[i % 40]) for i in range(400)], "doc_id bigint, text string")
    labels = d.selectExpr("doc_id", "cast(doc_id % 2 as int) toxic")
    here, fit = os.getpid(), fm_toxicity.fit

    def elsewhere(*a, **how):
        assert os.getpid() != here or not len(a[1])
        return fit(*a, **how)

    monkeypatch.setattr(fm_toxicity, "fit", elsewhere)
    m = fm_toxicity.fitted(d, labels)
    low, high = m.score([fm_toxicity.features("freund"), fm_toxicity.features("schuft")])
    assert m.weights.shape == (1 << fm_toxicity.BITS,) and low < 0.5 < high


@pytest.mark.parametrize("top", [1, 2, 900, 50_000, 1 << 35, 1 << 63])
def test_simple8b_round_trip(top):
    rng = np.random.default_rng(top % 97)
    for n in (0, 1, 5, 240, 1023, 1024, 1025, 9000):
        ids = rng.integers(0, top, n, dtype=np.uint64)
        ids[rng.random(n) < 0.5] = 0
        docs, lengths, back = simple8b.read_chunk(simple8b.chunk_bytes([7, 8], [ids[: n // 3], ids[n // 3 :]]))
        assert back.tolist() == ids.tolist() and docs.tolist() == [7, 8] and lengths.sum() == n
        for block in range(-(-n // simple8b.BLOCK)):
            part = simple8b.read_chunk(simple8b.chunk_bytes([7], [ids]), block)[2]
            assert part.tolist() == ids[block * simple8b.BLOCK : (block + 1) * simple8b.BLOCK].tolist()


@pytest.fixture(scope="module")
def tokens(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return {i: t.encode(x or "", add_special_tokens=False).ids + [END_ID] for i, x in texts.items()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_coder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    from eventloom.llm.coder import Coder

    t = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(8)
    parts = ["it's", "'S", "don't.", "...", "A", "é", "é", "İ", "ΣΣ", "<|endoftext|>", "<|ENDOFTEXT|>", "12", "x1y", " ", " ", "\x1c", "\x85", " ", "\n", "\t", "\U0001f600", "中文", "́", "!?", "", "straße", "Å", "\x00", "ﬁ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(3000)]
    got = Coder(tokenizer_path(), END_ID).encode(texts)
    assert [x.tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids + [END_ID] for x in texts]


def test_ids_written_and_read(spark, docs, texts, tokens, empty, monkeypatch):
    monkeypatch.setattr(simple8b, "CHUNK_IDS", 2000)
    path = new_path(spark, "ids")
    simple8b.write_ids(docs, path, tokenizer_path(), END_ID)
    got = rows(simple8b.read_ids(spark, path))
    start = 0
    for i in sorted(texts):
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"], got[i]["ids"]) == (start, len(tokens[i]), crc(tokens[i]), tokens[i])
        start += len(tokens[i])
    path = new_path(spark, "ids")
    simple8b.write_ids(empty, path, tokenizer_path(), END_ID)
    assert simple8b.read_ids(spark, path).count() == 0


def test_fill_is_the_best_subset_sum():
    rng = random.Random(6)
    for _ in range(200):
        counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(5)}
        room = rng.randrange(0, 80)
        sums = {0}
        for k, n in counts.items():
            sums = {s + j * k for s in sums for j in range(n + 1) if s + j * k <= room}
        used = slack_packing.fill(room, counts)
        assert sum(k * n for k, n in used.items()) == max(sums) and all(n <= counts[k] for k, n in used.items())


@pytest.mark.parametrize("capacity", [4096, 256])
def test_packing(docs, tokens, empty, capacity, monkeypatch):
    monkeypatch.setattr(slack_packing, "GROUP_PIECES", 40)
    got = slack_packing.pack(docs, tokenizer_path(), END_ID, capacity).collect()
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["ids_crc32"] == crc(tokens[r["doc_id"]][r["start"] : r["start"] + r["length"]]) and r["doc_tokens"] == len(tokens[r["doc_id"]])
    for i, ids in tokens.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == len(ids)
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) <= -(-sum(map(len, tokens.values())) // capacity) + 2
    assert slack_packing.pack(empty, tokenizer_path(), END_ID).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies on this page all day long.</div>
<article><h1>Head &amp; line</h1><p>First  <b>bold</b>
text<br>after.<p>Short.</p><div class="ad">Buy this now, buy it today!</div><p>Second &eacute;&#233; paragraph with words.</p>
<section class="comments"><p>I am a reader with a long comment about all of this.</p></section></article>
<aside>Other things to read</aside><form>Name <input></form><footer>&copy; all</footer></body></html>"""


def test_main_text(spark):
    want = "Head & line First bold text after. Short. Second éé paragraph with words."
    assert html_regions.main_text(PAGE) == want
    assert html_regions.main_text(PAGE[: PAGE.index("<aside>")]) == want
    assert html_regions.main_text("<nav>menu <article><p>An article of words.</p></article>") == "An article of words."
    assert html_regions.main_text("<div><p>" + "Plain page without article. " * 9 + "</p><ul><li><a>x</a></li></ul></div>").startswith("Plain page")
    assert html_regions.main_text(None) == html_regions.main_text("") == html_regions.main_text("<nav>x</nav>") == ""
    df = prepare(spark).createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, "v", "<p>" + "long words " * 50_000, "x")], "page_id bigint, url string, html string, text string")
    got = html_regions.extract_pages(df).collect()
    assert [r["text"] for r in got[:3]] == [want, want, ""] and [r["n_chars"] for r in got[:3]] == [len(want)] * 2 + [0]
    assert got[3]["n_chars"] == 11 * 50_000 - 1 and got[2]["page_id"] is None
    assert html_regions.extract_pages(df.where("false")).count() == 0


@pytest.mark.parametrize("name", ["near", "windows", "suffix", "exact", "pack", "ids"])
def test_null_and_repeated_ids(spark, name):
    """Null ids are one id below all others; repeated rows come back as often as they came."""
    prepare(spark)
    rng = random.Random(7)
    t = prose(rng, 90)
    df = spark.createDataFrame([(None, t), (4, t), (4, t), (None, None), (5, prose(rng, 12))], "doc_id bigint, text string")
    if name == "near":
        got = minmax_near.near_duplicates(df).collect()
        assert len(got) == 5 and {(r["doc_id"], r["component_id"]) for r in got} == {(None, None), (4, None), (5, 5)}
    elif name == "windows":
        got = countmin_spans.repeated_windows_removed(df).collect()
        assert sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in got) == [(0, 0, 0), (0, 90, 0), (4, 90, 90), (4, 90, 90), (5, 12, 0)]
    elif name == "suffix":
        assert {r["doc_id"] for r in sparse_suffix.repeated_passages(df).collect()} == {None, 4}
    elif name == "exact":
        got = extendible_index.exact_duplicates(df).collect()
        assert sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in got) == [(0, 0, 1, True), (0, 0, 3, True), (4, 0, 3, False), (4, 0, 3, False), (5, 5, 1, True)]
    elif name == "pack":
        assert slack_packing.pack(df, tokenizer_path(), END_ID).count() == 5
    else:
        path = new_path(spark, "ids")
        simple8b.write_ids(df, path, tokenizer_path(), END_ID)
        got = simple8b.read_ids(spark, path, with_ids=False).orderBy("start").collect()
        assert [r["doc_id"] for r in got] == [None, None, 4, 4, 5]
