"""The pipeline's stages follow each other and their decisions take effect; queries with SQL equal it."""

import pytest
from check_oracle import connection, difference

import corpus_pipeline
from aircapture.llm.common import table
from aircapture.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert difference(QUERIES[name], ORACLES[name], spark, connection(sf_dir), sf_dir) is None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_covers_its_table(spark, sf_dir, name):
    source = "pages" if "html" in name else "embeddings" if "embedding" in name else "documents"
    rows = QUERIES[name](spark, sf_dir)
    if name.startswith("op8_"):
        assert rows.select("conv_id").distinct().count() == table(spark, sf_dir, "conversations").select("conv_id").distinct().count()
    else:
        assert rows.count() == table(spark, sf_dir, source).count()


def test_stages_chain(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    before, texts = docs, {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, sf_dir).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert after.columns == docs.columns
        if k < 2:
            assert after.count() < before.count() and after.exceptAll(before).count() == 0
        if k == 2:
            assert after.count() == before.count()
            assert any(r["text"] != texts[r["doc_id"]] for r in after.collect())
        if k == 4:
            assert after.count() == before.count() and after.where("not round_trip").count() == 0
        before = after
    assert corpus_pipeline.run(spark, sf_dir).count() == before.count()
