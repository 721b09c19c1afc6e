"""The pipeline's stages take their decisions by row, with null and repeated ids."""

import random

import numpy as np

import corpus_pipeline
from eventloom.llm import fm_toxicity, template_leaks
from eventloom.llm.shared import prepare
from test_operators import shuffled


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("bdklmnrst") + rng.choice("aeiou") for _ in range(3)) for _ in range(n))


def left(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_null_and_repeated_ids_by_row(spark, tmp_path, monkeypatch):
    prepare(spark)
    a, b, c, d, leak = (prose(i) for i in range(5))
    near = a.rsplit(" ", 1)[0] + " changed"
    d_ = str(tmp_path)
    spark.createDataFrame([("q", leak)], "item_id string, text string").write.parquet(f"{d_}/benchmark.parquet")
    spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int").write.parquet(f"{d_}/labels.parquet")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)

    rows = [(None, a), (None, b), (None, "x " + leak), (4, c), (4, leak + " y"), (5, d)]
    assert left(corpus_pipeline.drop_leaks(spark, frame(rows), d_)) == sorted([(None, a), (None, b), (4, c), (5, d)], key=str)

    size = 1 << fm_toxicity.BITS
    machine = fm_toxicity.Machine(5.0, np.full(size, -10.0, np.float32), np.zeros((size, fm_toxicity.FACTORS), np.float32))  # no letters: toxic
    monkeypatch.setattr(fm_toxicity, "fitted", lambda docs, labels: machine)
    rows = [(None, a), (None, "1 2"), (4, c), (4, "3"), (5, d), (5, d)]
    assert left(corpus_pipeline.drop_toxic(spark, frame(rows), d_)) == sorted([(None, a), (4, c), (5, d), (5, d)], key=str)

    rows = [(None, a), (None, a), (None, b), (3, b), (4, c), (4, c), (4, d), (7, d), (2, d)]
    assert left(corpus_pipeline.drop_exact_copies(spark, frame(rows), d_)) == sorted([(None, a), (None, b), (4, c), (2, d)], key=str)

    rows = [(None, a), (None, near), (None, b), (3, b), (4, c), (4, c), (4, d), (7, d), (2, d)]
    got = left(corpus_pipeline.drop_near_copies(spark, frame(rows), d_))
    assert [x for x in got if x[1] not in (a, near)] == sorted([(None, b), (4, c), (2, d)], key=str) and len(got) == 4


def test_a_column_that_looks_like_the_key_decides_nothing(spark, tmp_path):
    prepare(spark)
    a, b = prose(1), prose(2)
    rows = [(1, a, 7, "x"), (2, a, 7, "y"), (3, b, 7, None), (4, None, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _pipeline_row int, _key string")
    got = corpus_pipeline.drop_exact_copies(spark, docs, str(tmp_path))
    assert got.columns[:4] == docs.columns and sorted(r["doc_id"] for r in got.collect()) == [1, 3, 4]
    got.write.parquet(f"{tmp_path}/kept")
    again = spark.read.parquet(f"{tmp_path}/kept")
    assert corpus_pipeline._row(again) == "_pipeline_row_"
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, again, str(tmp_path)).collect()) == [1, 3, 4]


def test_run_over_empty_and_long_texts(spark, tmp_path):
    prepare(spark)
    d, leak = str(tmp_path), prose(4)
    long = " ".join(prose(100 + i, 400) for i in range(20))
    rows = [(1, long, "s"), (2, long, "t"), (3, None, "s"), (4, "", "s"), (5, "word " + leak, "s"), (None, prose(9), None)]
    spark.createDataFrame([("q", leak)], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, 0), (3, 0)], "doc_id bigint, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    docs.write.parquet(f"{d}/documents.parquet")
    got = corpus_pipeline.run(spark, d).collect()
    # copies, one of two empty texts and the leak are gone; each piece of what is left is in one place
    assert {r["doc_id"] for r in got} == {None, 1, 3}
    for id_ in (None, 1, 3):
        mine = sorted((r["start"], r["length"]) for r in got if r["doc_id"] == id_)
        assert [s for s, _ in mine] == [sum(n for _, n in mine[:i]) for i in range(len(mine))]
        assert sum(n for _, n in mine) == next(r["doc_tokens"] for r in got if r["doc_id"] == id_)
    docs.where("false").write.mode("overwrite").parquet(f"{d}/documents.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0


def test_leaks_of_a_long_text_leave_without_its_words(spark, tmp_path, monkeypatch):
    """The stage's exchanges get texts once, and no window takes the words of its whole text along."""
    prepare(spark)
    monkeypatch.setattr(template_leaks, "BROADCAST_WINDOWS", 0)
    leak, d_ = prose(7, 40), str(tmp_path)
    spark.createDataFrame([("q", leak)], "item_id string, text string").write.parquet(f"{d_}/benchmark.parquet")
    rows = [(1, prose(8, 1500) + " " + leak + " " + prose(9, 1500)), (None, prose(10)), (2, prose(11, 100))]
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.drop_leaks(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), d_)
        assert left(out) == left(spark.createDataFrame(rows[1:], "doc_id bigint, text string"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert max(shuffled(out._jdf.queryExecution().executedPlan())) < 4 << 20
