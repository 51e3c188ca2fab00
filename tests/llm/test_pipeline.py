"""Each stage of the pipeline against its operator's rule, by brute force."""

import re

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_operators import SF, brute_components, brute_hits, plain_base


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        kept[name] = (before.collect(), docs.collect())
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = kept["quality"]
    ids = {r.doc_id for r in after}
    told = [(r.doc_id in ids) == (labels[r.doc_id] == 1) for r in before if r.doc_id in labels]
    assert sum(told) / len(told) > 0.97
    before, after = kept["near_duplicates"]
    order = sorted(before, key=lambda r: r.doc_id)
    _, root = brute_components([r.text for r in order])
    assert {r.doc_id for r in after} == {order[i].doc_id for i in set(root)} and len(after) == len(set(root))
    before, after = kept["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    some = sorted(before, key=lambda r: r.doc_id)[:60]
    ids = {r.doc_id for r in after}
    for r in some:
        n, hit, _ = brute_hits(r.text[:4000], items, 13) if len(r.text) <= 4000 else (None, None, None)
        if n is not None:
            assert (r.doc_id in ids) == (not (hit and 20 * hit >= n))
    before, after = kept["personal_data"]
    old = {r.doc_id: r for r in before}
    assert len(before) == len(after)
    for r in after:
        assert plain_base(r.text) == [] and r.n_chars == len(r.text)
        if not re.search("[0-9@]", old[r.doc_id].text):
            assert r.text == old[r.doc_id].text
    before, after = kept["packing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    total = {r.doc_id: r.doc_tokens for r in after}
    assert sum(r.length for r in after) == sum(total.values())


def test_stages_of_odd_documents(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "plain words go here and there", "en", "s", 29), (2, "plain words go here and there", "en", "s", 29)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("mine") for c in ("score", "predicted", "spans", "items", "n_words", "component_id", "masked", "found", "row")})
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
    assert all(r.score == r.spans == r.masked == r.row == "mine" for r in docs.collect())
    assert sorted(r.doc_id or 0 for r in docs.collect()) == [0, 1, 2]
    assert corpus_pipeline.STAGES[4][1](spark, docs, SF).agg(F.count_distinct("sequence_id")).first()[0] == 1
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
