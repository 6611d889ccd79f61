import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from paperloom.llm import pii
from test_jaccard import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    said = [s for s, _ in corpus_pipeline.STAGES]
    assert said == ["language", "near_duplicates", "personal_data", "packing"]
    steps = dict(corpus_pipeline.STAGES)
    a = steps["language"](spark, docs, SF).cache()
    assert a.columns == docs.columns and a.count() >= 0.98 * docs.count()
    b = steps["near_duplicates"](spark, a, SF).cache()
    first = {d for d, _, c in brute([(r.doc_id, r.text) for r in a.collect()]) if d == c}
    assert b.columns == docs.columns and {r.doc_id for r in b.collect()} == first and b.count() == len(first) < a.count()
    c = steps["personal_data"](spark, b, SF).cache()
    assert c.columns == docs.columns and c.dtypes == docs.dtypes
    source = {r.doc_id: r.text for r in b.collect()}
    for r in c.collect():
        spans = pii.find(source[r.doc_id])
        assert r.text == pii.redact(source[r.doc_id], spans) and r.n_chars == len(r.text) and not pii.find(r.text)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    d = steps["packing"](spark, c, SF).collect()
    size = {}
    for r in d:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.length
    assert size == {r.doc_id: len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in c.collect()}


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0
