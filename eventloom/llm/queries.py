"""The queries of these operators, and SQL where it can state their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import collocations, countmin_spans, disclosure, extendible_index, fm_toxicity, html_regions, license_scan, minmax_near, simple8b, slack_packing, source_divergence, sparse_suffix, template_leaks
from eventloom.llm.shared import new_path, prepare

TOKENIZER, END_ID = "word_bpe_49k.json", 2


def tokenizer_path() -> str:
    """The public tokenizer's file, installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_regions.extract_pages(table(prepare(spark), sf_dir, "pages"))


def op2_minmax_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_near.near_duplicates(table(prepare(spark), sf_dir, "documents"))


def op3_sparse_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_suffix.repeated_passages(table(prepare(spark), sf_dir, "documents"))


def op4_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.sanitised(table(prepare(spark), sf_dir, "documents")).drop("clean")


def op5_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return template_leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_countmin_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return countmin_spans.repeated_windows_removed(table(prepare(spark), sf_dir, "documents")).drop("kept")


def op7_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(prepare(spark), "ids")
    simple8b.write_ids(table(spark, sf_dir, "documents"), path, tokenizer_path(), END_ID)
    return simple8b.read_ids(spark, path, with_ids=False)


def op8_extendible_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_index.exact_duplicates(table(prepare(spark), sf_dir, "documents"))


def op9_fm_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return fm_toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slack_packing.pack(table(prepare(spark), sf_dir, "documents"), tokenizer_path(), END_ID)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.digest(*source_divergence.audit(table(prepare(spark), sf_dir, "documents")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(prepare(spark), sf_dir, "documents"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(prepare(spark), sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_main_text,
        op2_minmax_near,
        op3_sparse_suffix,
        op4_disclosure,
        op5_template_leaks,
        op6_countmin_windows,
        op7_simple8b,
        op8_extendible_index,
        op9_fm_toxicity,
        op10_slack_packing,
        op11_source_divergence,
        op12_collocations,
        op13_license_scan,
    )
}

SQL: dict[str, str] = {
    "op13_license_scan": license_scan.sql(),
    "op8_extendible_index": r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t""",
    "op6_countmin_windows": r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20),
k AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS h FROM s),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM k) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, i + o AS p FROM r, range(0, 20) t(o)),
p AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w WHERE len(ws) > 0),
a AS (
  SELECT p.doc_id, count(*) AS n_words, count(c.p) AS n_removed,
    coalesce(string_agg(CASE WHEN c.p IS NULL THEN p.x END, ' ' ORDER BY p.p), '') AS kept
  FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.p = c.p GROUP BY p.doc_id)
SELECT w.doc_id, coalesce(a.n_words, 0) AS n_words, coalesce(a.n_removed, 0) AS n_removed, sha256(coalesce(a.kept, '')) AS kept_sha256
FROM w LEFT JOIN a ON w.doc_id = a.doc_id""",
    "op11_source_divergence": r"""
WITH d AS (SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS i FROM documents),
w AS (
  SELECT lang, source, i, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+')) AS term FROM d),
t AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT l.lang, count(t.term) AS v FROM (SELECT DISTINCT lang FROM g) l LEFT JOIN t ON l.lang = t.lang GROUP BY l.lang),
c AS (SELECT w.lang, w.source, w.term, count(*) AS c FROM w JOIN t ON w.lang = t.lang AND w.term = t.term GROUP BY w.lang, w.source, w.term),
a AS (
  SELECT g.lang, g.source, t.term, coalesce(c.c, 0) AS c
  FROM g JOIN t ON g.lang = t.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
p AS (
  SELECT a.lang, a.source, a.term, a.c, CAST(1 + (1000000000::HUGEINT * (a.c + 5)) // (sum(a.c) OVER (PARTITION BY a.lang, a.source) + 5 * v.v) AS BIGINT) AS p
  FROM a JOIN v ON a.lang = v.lang),
q AS (
  SELECT x.lang, x.term, CAST(1 + (1000000000::HUGEINT * (x.c + 5)) // (sum(x.c) OVER (PARTITION BY x.lang) + 5 * v.v) AS BIGINT) AS q
  FROM (SELECT lang, term, sum(c) AS c FROM a GROUP BY lang, term) x JOIN v ON x.lang = v.lang),
r AS (
  SELECT g.lang, g.source, h.source AS item, CAST(coalesce(f.f, 0) AS BIGINT) AS value
  FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS f
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source) f
  ON f.lang = g.lang AND f.source = g.source AND f.item = h.source),
e AS (
  SELECT p.lang, p.source, p.term AS item, p.p - q.q AS value, row_number() OVER (PARTITION BY p.lang, p.source ORDER BY p.p - q.q DESC, p.term) AS n
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.c > 0 AND p.p > q.q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM r
UNION ALL
SELECT lang, source, 'term' AS part, item, value, CAST(n AS INTEGER) AS rank FROM e WHERE n <= 50""",
    "op12_collocations": r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents),
w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws
  FROM (SELECT lang, unnest(pieces) AS piece FROM d)),
t AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
p AS (
  SELECT lang, k, ws[i:i + k - 1] AS ph, count(*) AS f
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 6) r(k) WHERE len(ws) >= k)
  GROUP BY lang, k, ph HAVING count(*) >= 100),
b AS (
  SELECT lang, part, max(f) AS f
  FROM (SELECT lang, f, m, ph, unnest(range(1, k - m + 2)) AS i FROM p, range(2, 5) r(m) WHERE m < k) x, LATERAL (SELECT x.ph[x.i:x.i + x.m - 1] AS part)
  GROUP BY lang, part),
c AS (
  SELECT p.lang, p.ph, p.k, p.f AS a FROM p LEFT JOIN b ON p.lang = b.lang AND p.ph = b.part
  WHERE p.k >= 2 AND (b.f IS NULL OR 100 * b.f < 100 * p.f)),
s AS (
  SELECT c.lang, c.ph, c.a, j, x.f AS l, y.f AS r, t.n, CAST((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM c JOIN range(1, 5) q(j) ON j < c.k JOIN p x ON x.lang = c.lang AND x.ph = c.ph[1:j] JOIN p y ON y.lang = c.lang AND y.ph = c.ph[j + 1:c.k] JOIN t ON t.lang = c.lang),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, ph ORDER BY score, j) AS o FROM s) WHERE o = 1),
z AS (
  SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ph, ' ')) AS INTEGER) AS rank,
    array_to_string(ph, ' ') AS phrase, a, l, r, n, score
  FROM m)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM z WHERE rank <= 2000""",
}
