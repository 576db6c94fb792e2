import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logweave.llm import quality, secrets, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into and comes out of every stage."""
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialise(stage(spark, docs, SF), "test")
        seen.append((name, docs, out))
        docs = out
    return {name: (before, after) for name, before, after in seen}


def test_stages_keep_the_columns_and_work_on_what_is_left(stages):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "language", "near_duplicates", "secrets", "packing"]
    for name in names[:-1]:
        before, after = stages[name]
        assert [(f.name, f.dataType) for f in after.schema] == [(f.name, f.dataType) for f in before.schema]
        assert 0 < after.count() <= before.count()


def test_quality_stage_drops_junk_and_keeps_clean(spark, stages):
    before, after = stages["quality"]
    kept = {r.doc_id for r in after.collect()}
    assert kept == {r.doc_id for r in quality.assess(before).collect() if r.kept}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    failed = {r.doc_id for r in quality.assess(before).collect() if r.base_failed}
    clean = [r.doc_id for r in labels if r.quality == 1 and r.doc_id not in failed]
    junk = [r.doc_id for r in labels if r.quality == 0]
    assert sum(i in kept for i in clean) / len(clean) >= 0.98
    assert sum(i in kept for i in junk) / max(1, len(junk)) <= 0.1


def test_language_stage_keeps_nearly_all(stages):
    before, after = stages["language"]
    assert after.count() >= 0.97 * before.count()


def test_one_of_each_group_stays(stages):
    before, after = stages["near_duplicates"]
    groups = {r.component_id for r in simhash.near_duplicates(before).collect()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(groups)


def test_secrets_are_gone_and_other_text_is_left(stages):
    before, after = stages["secrets"]
    old, new = ({r.doc_id: r for r in df.collect()} for df in (before, after))
    assert old.keys() == new.keys()
    assert all(r.n_assign + r.n_access + r.n_hex == 0 for r in secrets.report(after).collect())
    for i, r in old.items():
        spans = secrets.scanner().spans(r.text.encode())
        assert spans or new[i].text == r.text
        assert new[i].n_chars == len(new[i].text)


def test_run_packs_every_kept_document(spark, stages):
    before, after = stages["packing"]
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in pieces) == \
        sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in after.collect())
    assert {r.doc_id for r in pieces} == {r.doc_id for r in before.collect()}
    filled = {}
    for r in pieces:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert max(filled.values()) <= 2048
    assert all(zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in pieces)


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), "test")
    assert docs.collect() == []


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    """Hard rows pass every stage; columns named like those the stages make stay as they are."""
    read = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    first = read.where("text is not null").first()
    long_ = " ".join(f"{w} of the number {i} in the row." for i, w in enumerate(first.text.split() * 200))
    hard = [first.asDict() | {"doc_id": i, "text": t} for i, t in
            ((None, first.text), (900001, None), (900002, ""), (900003, "  "), (900004, long_), (900004, long_))]
    docs = read.unionByName(spark.createDataFrame([tuple(h[c] for c in read.columns) for h in hard], read.schema))
    for name in ("component_id", "q_row", "kept", "found", "ids", "spread", "deal", "lang_pred"):
        docs = docs.withColumn(name, F.lit(name))
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialise(stage(spark, docs, SF), "test")
        assert name == "packing" or out.columns == docs.columns
        docs = out
    # Null, empty and blank texts go at the first stage, the repeated long text once at the third.
    rows = [r for r in docs.select("doc_id", "piece", "length").collect() if r.doc_id is not None and r.doc_id > 900000]
    assert {r.doc_id for r in rows} == {900004} and len({r.piece for r in rows}) == len(rows) > 1
