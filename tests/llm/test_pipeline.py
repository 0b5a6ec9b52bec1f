import importlib

import pytest
from pyspark.sql import functions as F

from parlquery.llm import bpe, mixing, secret_lexing, simhash, toxicity

pipeline = pytest.importorskip("corpus_pipeline") if importlib.util.find_spec("corpus_pipeline") else None
pytestmark = pytest.mark.skipif(pipeline is None, reason="the pipeline is not here")

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark, documents):
    from tokenizers import Tokenizer

    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "simhash_dedup", "secrets", "mixing", "bpe"]
    docs = documents
    f = dict(pipeline.STAGES)
    chain = toxicity.train(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r["doc_id"] for r in toxicity.score(documents, chain).filter("toxic").collect()}
    clean = f["toxicity"](spark, docs, SF)
    assert clean.columns == documents.columns
    assert {r["doc_id"] for r in clean.select("doc_id").collect()} == {r["doc_id"] for r in documents.select("doc_id").collect()} - toxic
    unique = f["simhash_dedup"](spark, clean, SF)
    assert unique.columns == documents.columns
    groups = simhash.cluster(clean).select("component_id").distinct().count()
    assert unique.count() == groups
    masked = f["secrets"](spark, unique, SF)
    assert masked.columns == documents.columns and masked.count() == unique.count()
    before = {r["doc_id"]: r["text"] for r in unique.collect()}
    for r in masked.collect():
        assert r["text"] == secret_lexing.redact(before[r["doc_id"]])
        assert r["n_chars"] == len(r["text"])
    mixed = f["mixing"](spark, masked, SF)
    assert mixed.columns == documents.columns
    taken = mixing.mix(mixing.sized(masked)).groupBy("source").agg(F.sum("taken").alias("t"), F.max("size").alias("m")).collect()
    got = {r["source"]: r["t"] for r in mixed.withColumn("w", mixing.words()).groupBy("source").agg(F.sum("w").alias("t")).collect()}
    for r in taken:
        assert abs(got.get(r["source"], 0) - r["t"]) <= r["m"]
    whole = Tokenizer.from_file(bpe.vocabulary_path())
    whole.no_truncation()
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    last = f["bpe"](spark, mixed, SF).collect()
    assert len(last) == mixed.count()
    for r in last:
        assert r["token_ids"] == whole.encode(texts[r["doc_id"]], add_special_tokens=False).ids


def test_stages_on_odd_and_empty_rows(spark, odd, empty):
    for df in (odd, empty):
        docs = df
        for _, stage in pipeline.STAGES:
            docs = stage(spark, docs, SF)
            if stage is not pipeline.STAGES[-1][1]:
                assert docs.columns == df.columns
        docs.collect()


def test_whole_run_leaves_what_it_reads(spark, documents):
    """The run equals its stages one by one; what stages wrote on their way goes."""
    import os

    from parlquery.llm import common

    before = set(os.listdir(common.shared_dir(spark)))
    rows = pipeline.run(spark, SF)
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(common.shared_dir(spark))) - before}
    assert left == {"pipeline-mixing"}
    found = sorted((r["doc_id"], r["n_tokens"]) for r in rows.collect())
    docs = documents
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert found == sorted((r["doc_id"], r["n_tokens"]) for r in docs.collect()) and len(found) > 100
