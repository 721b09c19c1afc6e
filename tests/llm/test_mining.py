"""Source divergence, collocations and license scans against brute force."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from eventloom.llm import collocations, license_scan, source_divergence
from eventloom.llm.shared import prepare

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCABULARY = "ab cd été Éa straße x9 o'clock naïve 東京 K q r".split(" ")


@pytest.fixture(scope="module")
def rows():
    """Texts in several languages and sources with copies within and across them, nulls, blanks, and a long text."""
    rng = random.Random(12)

    def text(n):
        return "".join(rng.choice(VOCABULARY) + rng.choice([" ", " ", " ", ", ", "\t", "  ", ".\n", "; "]) for _ in range(n))

    hot = text(40)
    out = [(rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "S3", "", None]), rng.choice([text(rng.randrange(1, 60)), hot, hot.upper()])) for _ in range(160)]
    out += [("fr", f"w{i:03}", "ab cd. ab cd ab") for i in range(9)] + [("xx", "only", None), ("xx", "other", " \n 12 "), ("en", "long", text(6000))]
    return [(None if i % 11 == 0 else i % 37, t, lang, source, "x", 3) for i, (lang, source, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    prepare(spark)
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, _lang string, _term int").repartition(6)


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def divergence(rows, least, top):
    docs = [(t or "", lang or "", source or "") for _, t, lang, source, *_ in rows]
    found = [Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(UPPER))) for t, _, _ in docs]
    out = []
    for lang in {d[1] for d in docs}:
        mine = [(c, d[2]) for c, d in zip(found, docs) if d[1] == lang]
        df = Counter(t for c, _ in mine for t in c)
        kept = [t for t in df if df[t] >= least]
        counts = {s: Counter() for _, s in mine}
        for c, s in mine:
            counts[s].update(c)
        whole = sum(counts.values(), Counter())

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        q, p = shares(whole), {s: shares(c) for s, c in counts.items()}
        for s in counts:
            far = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s]
            more = [(q[t] - p[s][t], t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(sorted(far))]
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(sorted(more)[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block, tile, held, lists", [(4096, 128, 1_000_000, 5000), (2, 2, 5, 2)])
def test_divergence(docs, rows, monkeypatch, block, tile, held, lists):
    for name, value in (("BLOCK_TERMS", block), ("TILE", tile), ("HELD", held), ("LIST", lists)):
        monkeypatch.setattr(source_divergence, name, value)
    got = source_divergence.digest(*source_divergence.audit(docs, 6, 4))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert tuples(got) == divergence(rows, 6, 4)


def test_divergence_collapses_copies(docs, rows):
    got = source_divergence.collapsed(docs).collect()
    assert len(got) == len({(lang or "", t or "") for _, t, lang, *_ in rows})
    assert sum(c["_n"] for r in got for c in r["_copies"]) == len(rows)


def test_share_beyond_64_bits(spark):
    df = spark.createDataFrame([(10**13, 3 * 10**13, 10**6)], "c long, n long, v long")
    assert df.select(source_divergence.share("c", "n", "v").alias("p")).first()["p"] == 1 + 10**9 * (10**13 + 5) // (3 * 10**13 + 5 * 10**6)


def phrases(rows, least, longest, top):
    n, f = Counter(), defaultdict(Counter)
    for _, t, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(UPPER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        kept = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in kept.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        found = []
        for p, a in kept.items():
            if inside[p] < a:
                score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), " ".join(p), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p, -a, left, right, n[lang], -score) for i, (score, a, _, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("trie_phrases, broadcast_words, held", [(500_000, 1_000_000, 1_000_000), (40, 0, 50)])
def test_collocations(docs, rows, monkeypatch, trie_phrases, broadcast_words, held):
    """One trie and a table of words, and several tries with words coded by a join: the same, and that of brute force."""
    for name, value in (("HELD", held), ("BUCKET_WORDS", held), ("STATES", held)):
        monkeypatch.setattr(collocations, name, value)
    got = collocations.collocations(docs, 4, 5, 60, trie_phrases, broadcast_words)
    want = phrases(rows, 4, 5, 60)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert tuples(got) == want and len(want) > 100 and len({r[0] for r in want}) == 4


def test_trie_of_many_phrases():
    rng = np.random.default_rng(1)
    words, texts = 300, rng.zipf(1.3, 40_000) % 300
    paths = np.unique(np.concatenate([np.pad(texts[rng.integers(0, 39_000, 900)[:, None] + np.arange(k)], ((0, 0), (0, 5 - k))) for k in (2, 3, 5)]), axis=0)
    paths = paths[(paths[:, :2] > 0).all(1)]
    paths = np.array([p for p in paths if (p[: (p > 0).sum()] > 0).all()], np.int32)
    trie = collocations.Trie.of(paths, words)
    wanted = {tuple(x for x in p if x)[:k] for p in paths.tolist() for k in range(1, 6)}
    for k, state in enumerate(trie.states(texts, 5)):
        for i in range(0, len(texts) - 5):
            window = tuple(texts[i : i + k + 1].tolist())
            assert (window in wanted) == (state[i] >= 0)
            if state[i] >= 0:
                assert tuple(x for x in trie.paths[state[i]].tolist() if x) == window


def test_empty_tables(docs):
    none = docs.where("false")
    assert tuples(source_divergence.digest(*source_divergence.audit(none))) == []
    assert tuples(collocations.collocations(none)) == []
    assert tuples(license_scan.scan(none)) == [] and tuples(license_scan.license_spans(none)) == []


@pytest.fixture(scope="module")
def notices(spark):
    rng = random.Random(4)
    words = "the of a work license mit apache general public under free software is licensed cc by 4 0 nc all rights reserved été".split()
    notice = dict.fromkeys(label for label, _ in license_scan.TEMPLATES)
    notice = {label: max((t for x, t in license_scan.TEMPLATES if x == label), key=len) for label in notice}
    out = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 90))) for _ in range(120)]
    for label, text in notice.items():
        w = text.split()
        changed = [*w[: len(w) // 2], "one", "or", "two", *w[len(w) // 2 :]]
        out += [f"Und so. {text.upper()}; weiter", "x " + " ".join(changed) + " y", text + " - " + text]
    out += [None, "", "MIT License", "mit  license, MIT-license mit\nlicense", "the MIT licenses", "Ⓜit license", "GENERAL PUBLIC LICENSE" * 2, "mİt license", "all rights reserved " * 400]
    rng.shuffle(out)
    rows = [(None if i % 7 == 0 else i % 60, t, "a") for i, t in enumerate(out)]
    rows += [r for r in rows if r[1] == "MIT License"] * 3
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, _words string").repartition(5)


def scanned(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    spans = []
    for i, (label, template) in enumerate(license_scan.PHRASES + license_scan.TEMPLATES):
        t, phrase = template.split(), i < len(license_scan.PHRASES)
        k = min(3, len(t))
        diagonals = defaultdict(list)
        for p, s in itertools.product(range(len(w) - k + 1), range(len(t) - k + 1)):
            if w[p : p + k] == t[s : s + k]:
                diagonals[p - s].append((p, s))
        groups = []
        for d in sorted(diagonals):
            if phrase or not groups or d - last > license_scan.DRIFT:
                groups.append([])
            groups[-1] += diagonals[d]
            last = d
        for g in groups:
            share = len({s + j for _, s in g for j in range(k)}) / len(t)
            first, past = min(p for p, _ in g), max(p for p, _ in g) + k
            if phrase or (share >= license_scan.LEAST and (len(g) + k - 1) / (past - first) >= license_scan.LEAST_FILL):
                spans.append((label, phrase, first, past, share))
    return len(w), spans


def test_license_scan(notices):
    rows, df = notices
    want = []
    for id_, text, _ in rows:
        n, spans = scanned(text)
        base = [s for s in spans if s[1]]
        at = [s[2] for s in base]
        score = max([s[4] for s in spans if not s[1]] + [0.5 if base else 0.0])
        want.append((id_, n, len(base), min(at, default=None), max(at, default=None), ",".join(sorted({s[0] for s in base})), ",".join(sorted({s[0] for s in spans})), score))
    got = license_scan.scan(df)
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert tuples(got) == sorted(want, key=repr)
    assert len({x for r in want for x in r[6].split(",")}) > 12


def test_license_spans(notices):
    rows, df = notices
    want = {(id_, *s) for id_, text, _ in rows for s in scanned(text)[1]}
    assert set(tuples(license_scan.license_spans(df))) == want


def test_changed_notices_are_found(notices):
    rows, _ = notices
    changed = [t for _, t, _ in rows if t and t.startswith("x ") and t.endswith(" y")]
    found = [bool(scanned(t)[1]) for t in changed]
    assert len(found) > 12 and sum(found) >= 0.7 * len(found)  # three words put in; short notices lose too much


def test_license_scan_stays_in_the_jvm(notices):
    plan = license_scan.scan(notices[1])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
