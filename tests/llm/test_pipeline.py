from collections import Counter

import corpus_pipeline
from panelwise.llm.decontam import contained_items
from panelwise.llm.simhash import simhash_groups
from panelwise.llm.toxicity import score_toxicity

SMALL = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, small):
    tables, docs = [small], small
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SMALL)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        tables.append(docs)
    raw, clean, single, whole, mixed, sharded = tables
    ids = [Counter(r.doc_id for r in t.select("doc_id").collect()) for t in tables]
    toxic = {r.doc_id for r in score_toxicity(raw, spark.read.parquet(f"{SMALL}/labels.parquet")).where("predicted = 1").collect()}
    assert ids[1] == Counter({i: n for i, n in ids[0].items() if i not in toxic})
    first = {r.component_id for r in simhash_groups(clean).collect()}
    assert ids[2] == Counter(first)
    leaked = {r.doc_id for r in contained_items(single, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    assert leaked and set(ids[3]) == set(ids[2]) - leaked
    assert set(ids[4]) <= set(ids[3]) and max(ids[4].values()) <= 3
    assert ids[5] == ids[4]
    assert all(t.columns == raw.columns for t in tables[:5])
    assert sharded.columns == [*raw.columns, "size", "shard", "slot"]
    run = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(str, run.collect())) == sorted(map(str, sharded.collect()))


def test_odd_documents(spark, odd, none):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars", "key")
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, docs.limit(0), SMALL).count() == 0
        docs = step(spark, docs, SMALL)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert docs.count() > 0
