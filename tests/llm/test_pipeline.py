import brute
import corpus_pipeline
from test_decontaminate import plain


def test_stages_decide_as_plain_versions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, sf).cache()
    assert clean.columns == columns
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 0").collect()}
    assert toxic <= {r.doc_id for r in clean.select("doc_id").collect()}  # clean documents stay

    one = stages["near_dup"](spark, clean, sf).cache()
    want = brute.near_dup([tuple(r) for r in clean.select("doc_id", "text").collect()])
    assert one.columns == columns and sorted(r.doc_id for r in one.select("doc_id").collect()) == sorted(i for i, r in want.items() if r[3])

    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    fresh = stages["decontamination"](spark, one, sf).cache()
    kept = {r.doc_id for r in one.select("doc_id", "text").collect() if not plain(r.text, items)[4]}
    assert fresh.columns == columns and {r.doc_id for r in fresh.select("doc_id").collect()} == kept

    pieces = stages["packing"](spark, fresh, sf).collect()
    assert {r.doc_id for r in pieces} == kept


def test_edge_rows_pass_through(spark, sf):
    rows = [(10 ** 9, None, None, None, None), (10 ** 9 + 1, "", "en", "s", 0), (10 ** 9 + 1, "", "en", "s", 0), (None, None, None, None, None),
            (10 ** 9 + 2, "plain words " * 30000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert {r.doc_id for r in docs.collect()} == {None, 10 ** 9, 10 ** 9 + 1, 10 ** 9 + 2}


def test_only_ids_that_go_or_repeat_are_listed(spark, monkeypatch):
    written, durable = [], corpus_pipeline.durable
    monkeypatch.setattr(corpus_pipeline, "durable", lambda df: written.append(durable(df)) or written[-1])
    rows = [(i, f"u{i} v{i} w{i} x{i} y{i} z{i}") for i in range(20)] + [(30, "a b c d e f"), (31, "a b c d e f"), (5, "u5 v5 w5 x5 y5 z5"), (None, "a b c d e f")]
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), None)
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted([*range(20), 30, None], key=str)
    assert sorted((r.doc_id, r.n, r.kept) for r in written[-1].collect()) == [(5, 2, True), (31, 1, False)]
