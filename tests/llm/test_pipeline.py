"""The pipeline's stages one after the other on a small table."""

import corpus_pipeline
from tests.llm.test_text_ops import brute_components, corpus, frame, sets_of


def test_stages(spark, tmp_path):
    rows = [(i, t) for i, t in corpus(n=24)]
    path = str(tmp_path / "documents.parquet")
    docs = frame(spark, rows)
    docs.write.parquet(path)
    docs = spark.read.parquet(path)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "ngram_jaccard_join", "pii_surrogates", "packing"]
    left = docs
    for n, f in corpus_pipeline.STAGES:
        before = left
        left = f(spark, left, str(tmp_path))
        out = str(tmp_path / n)
        left.write.parquet(out)
        left = spark.read.parquet(out)
        if n != "packing":
            assert left.columns == docs.columns
        if n == "language_id":
            letters = {i for i, t in rows if t and any(c.isalpha() for c in t)}
            assert {r["doc_id"] for r in left.select("doc_id").collect()} == letters
        if n == "ngram_jaccard_join":
            kept = {r["doc_id"]: r["text"] for r in before.collect()}
            assert {r["doc_id"] for r in left.collect()} == set(brute_components(sets_of(kept.items())).values())
    assert {"sequence_id", "offset", "ids_crc32"} <= set(left.columns)
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert again.count() == left.count()
