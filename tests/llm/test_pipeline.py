"""The pipeline against its operators run one by one, and a brute-force reading of its last stages."""

import hashlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import tiktoken

from presswarp.llm import byte_bpe, language, mixing, near_dup, quality, queries

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], SF).write.parquet(f"{tmp_path}/{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}"))
    assert all(x.columns == docs.columns for x in seen[1:-1])
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in seen]
    assert ids[1] == {r.doc_id for r in quality.quality_report(docs, labels).filter("predicted = 1").collect()}
    assert ids[2] == {r.doc_id for r in language.language_report(seen[1]).join(seen[1].select("doc_id", "text"), "doc_id").filter(f"lang_pred <> 'und' and value >= {language.LEAST_VALUE} * evidence").collect()}
    assert ids[3] == {r.doc_id for r in near_dup.near_duplicates(seen[2]).filter("kept").collect()}
    assert ids[4] == {r.doc_id for r in mixing.mix(seen[3]).filter("taken > 0").collect()}
    coder = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(queries.BYTE_VOCABULARY), special_tokens={})
    want = Counter()
    for r in seen[4].collect():
        tokens = np.array(coder.encode_ordinary(r.text), "<u4")
        want[(r.doc_id, r.source, len(tokens), hashlib.sha256(r.text.encode()).hexdigest(), tokens.tobytes())] += 1
    assert Counter((r.doc_id, r.source, r.n_tokens, r.decoded_sha256, bytes(r.ids)) for r in seen[5].collect()) == want
    assert corpus_pipeline.run(spark, SF).count() == seen[5].count()
