"""The corpus pipeline against a brute-force version of its stages."""

import brute
import cases
import corpus_pipeline
from pyspark.sql import functions as F
from skein.llm import decontaminate, quality_rules
from test_operators import check_packing, pairs_of


def test_stages_and_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) < 15000").cache()
    kept = {r.doc_id for r in quality_rules.quality(docs).filter("kept").collect()}
    rows = [r for r in pairs_of(docs) if r[0] in kept]
    classes = brute.near_components(rows)
    rows = [r for r in rows if classes[r[0]][1] == r[0]]
    rows = sorted(brute.strip_earlier_text(rows).items())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    frame = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        frame = stage(spark, frame, sf)
        if i < 4:
            assert frame.columns == docs.columns and frame.dtypes == docs.dtypes
            frame = frame.cache()
        if i == 2:
            assert dict(pairs_of(frame)) == dict(rows)
            assert frame.filter("n_chars <> length(text)").isEmpty()
        if i == 3:
            want = dict(rows)
            hits = brute.contaminated(rows, items)
            got = dict(pairs_of(frame))
            assert {k for k in want if got[k] != want[k]} == {k for k, h in hits.items() if h[1]}
            for k, h in hits.items():  # the words that stay are those outside of the hits
                assert len(brute.lower_words(got[k])) == h[0] - h[1]
            assert not any(h[1] for h in brute.contaminated(list(got.items()), items).values())
            cleaned = sorted(got.items())
    assert check_packing(cleaned, frame.collect()) > 0.95


def test_run_matches_brute_force(spark, duck, sf):
    texts = dict(pairs_of(spark.read.parquet(f"{sf}/documents.parquet")))
    kept = duck.execute(f"SELECT doc_id FROM ({quality_rules.OP1_SQL}) WHERE kept").fetchall()
    rows = sorted((k, texts[k]) for (k,) in kept)
    classes = brute.near_components(rows)
    rows = sorted(brute.strip_earlier_text([r for r in rows if classes[r[0]][1] == r[0]]).items())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert check_packing(brute.cleaned(rows, items), corpus_pipeline.run(spark, sf).collect()) > 0.95


def test_stages_on_odd_rows(spark, sf):
    docs = frame = cases.clashing(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, sf)
        assert frame.columns == docs.columns and frame.dtypes == docs.dtypes
    assert corpus_pipeline.pack(spark, frame, sf).count() >= frame.count()
    cleaned = corpus_pipeline.benchmark(spark, docs, sf)  # without the rules, which reject most of the odd rows
    assert cleaned.count() == docs.count() and corpus_pipeline.near(spark, cleaned, sf).count() < docs.count()


def test_stages_on_an_empty_table(spark, sf):
    frame = cases.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, sf)
        assert frame.isEmpty() and (frame.columns == cases.empty(spark).columns or stage is corpus_pipeline.pack)


def test_cut_spans(spark):
    rows = [("one two three", [4, 7]), (None, [1, 2]), ("é x", []), ("a b c", [0, 1, 4, 5]), ("ü é ö", [3, 5]), ("x", None)]
    got = spark.createDataFrame(rows, "t string, s array<bigint>").select(decontaminate.cut_spans(F.col("t"), F.col("s")).alias("t")).collect()
    assert [r.t for r in got] == ["one   three", None, "é x", "  b  ", "ü   ö", "x"]
