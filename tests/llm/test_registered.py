"""Registered training-data queries: twins, contract columns, the pipeline."""

import pytest
from oracle import compare, connect

import corpus_pipeline
from atlas.llm import queries

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    1: ["doc_id", "start", "n_tokens", "ids_crc32"],
    2: ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    3: ["doc_id", "held_out", "score", "predicted"], 4: ["doc_id", "held_out", "score", "predicted"],
    5: ["doc_id", "fingerprint", "component_id"],
    6: ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    7: ["doc_id", "size", "source_size", "target", "taken"], 8: ["query_id", "rank", "vec_id", "score"],
    9: ["vec_id", "n_links", "component_id", "kept"],
    10: ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    11: ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    12: ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
    13: ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]}


@pytest.mark.parametrize("name", sorted(queries.TWINS))
def test_equals_twin(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, name, queries.QUERIES[name], queries.TWINS[name]) is None


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_contract_columns(spark, name):
    found = queries.QUERIES[name](spark, FOLDER)
    wanted = COLUMNS[int(name[2:].split("_")[0])]
    assert found.columns[:len(wanted)] == wanted or set(wanted) <= set(found.columns)
    assert found.count() > 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append(docs.count())
    assert seen[0] <= 200 and seen[1] < seen[0] and seen[2] == seen[1]
    assert not docs.where("text RLIKE '[a-z]@[a-z0-9]+[.][a-z]'").count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    # cuts depend on how the rows are dealt to tasks, the tokens do not
    tokens = [p.groupBy("doc_id").sum("length").collect() for p in (corpus_pipeline.run(spark, FOLDER), pieces)]
    assert sorted(tokens[0]) == sorted(tokens[1])


def test_pipeline_of_no_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0, name
