import hashlib

import numpy as np

import corpus_pipeline as C
from tilewright.llm import bpe
from tilewright.llm.common import materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, columns = spark.read.parquet(f"{SF}/documents.parquet"), None
    columns, texts = docs.columns, {}
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    for k, (name, stage) in enumerate(C.STAGES):
        before = docs
        docs = materialize(stage(spark, docs, SF), f"test-{k}")
        if k < len(C.STAGES) - 1:
            assert docs.columns == columns, name
        if k == 0:
            kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
            assert 0.6 * before.count() < len(kept) < before.count()
            assert len(kept & toxic) < len(toxic)
        if k == 1:
            assert docs.count() == before.count()
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        if k == 2:
            assert docs.exceptAll(before).count() == 0 and docs.count() <= before.count()
        if k == 3:
            assert {r["doc_id"] for r in docs.collect()} <= {r["doc_id"] for r in before.collect()}
            texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    decoder = bpe.Decoder(bpe.read_ranks(bpe.default_path()))
    for r in docs.collect():
        ids = np.frombuffer(r["ids"], "<u4").astype(int)
        assert len(ids) == r["n_tokens"] and decoder.decode(ids).tobytes().decode() == texts[r["doc_id"]]


def test_cases(spark, tmp_path):
    """Nulls, empty texts, repeated rows, clashing names and empty tables, stage by stage and in one run."""
    words = "the quick brown fox jumps over the lazy dog and runs away from the barking hounds of the old mill".split()
    good = [" ".join(words[k:] + words[:k]) + f" and number {k} stays here" for k in range(12)]
    rows = [(k, t, "en", "a", len(t), "x", "y") for k, t in enumerate(good)]
    rows += [rows[3], (20, None, "en", None, 0, "x", "y"), (21, "", None, "b", 0, "x", "y"), (None, good[5], "en", None, 9, "x", "y"), (22, good[7], "en", "b", 9, "x", "y"), (23, "w" * 30_000, "en", "b", 30_000, "x", "y")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, __lines string"
    for name, kept in (("some", rows), ("none", [])):
        spark.createDataFrame(kept, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(0, 1, 0)] if kept else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/some/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(C.STAGES):
        docs = materialize(stage(spark, docs, f"{tmp_path}/some"), f"cases-{k}")
        if k < 4:
            assert docs.columns == columns, name
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        if k == 0:  # one grade says nothing: all that have words stay
            assert sorted(ids, key=str) == sorted([r[0] for r in rows if r[1]], key=str)
        if k == 1:
            assert len(ids) == 16
        if k == 2:
            assert ids.count(3) == 1 and ids.count(None) == 1 and 22 in ids
    assert C.run(spark, f"{tmp_path}/some").count() == docs.count()
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in docs.collect())
    assert C.run(spark, f"{tmp_path}/none").count() == 0


def test_texts_come_back(spark):
    out = C.bpe_stage(spark, spark.createDataFrame([(1, "a b \u00e9", "en", "s"), (2, None, None, None)], "doc_id long, text string, lang string, source string"), "")
    want = {1: hashlib.sha256("a b \u00e9".encode()).hexdigest(), 2: hashlib.sha256(b"").hexdigest()}
    assert {r["doc_id"]: r["decoded_sha256"] for r in out.collect()} == want
