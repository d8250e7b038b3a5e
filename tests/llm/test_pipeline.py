"""The pipeline's stages on a small corpus: columns, decisions and the last stage's ids."""

import random

import public_tokenizers as P

import corpus_pipeline
from veldspar.llm import bpe


def test_stages(spark, tmp_path):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    texts = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(20)]
    texts += [texts[0], "too short", None, texts[1] + " write to ann.b@mail.example.com"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        assert name == "token_ids" or docs.columns == columns
    assert {r.doc_id for r in seen["quality_rules"]} == {*range(21), 23}
    assert {r.doc_id for r in seen["near_duplicates"]} == set(range(20))  # copies of 0 and 1 go
    codec = bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert {codec.decode(bytes(r.ids)).decode() for r in seen["token_ids"]} <= set(texts[:20])
    assert len(seen["token_ids"]) == len(seen["source_mix"])
