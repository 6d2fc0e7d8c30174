"""The pipeline, stage by stage, against plain versions of what each stage keeps."""

from collections import Counter

import brute
import numpy as np
import public_tokenizers
from compare import connect, differences
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from planlens.llm import queries, robust_outliers, rule_ensemble, source_mix

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, documents):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    good = corpus_pipeline.classify(spark, documents, SMALL).cache()
    scores = {r.doc_id: r.score for r in rule_ensemble.classify(documents, labels, 3, 1).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, s in scores.items() if s >= 0.5}
    kept = corpus_pipeline.apply_rules(spark, good, SMALL).cache()
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in robust_outliers.verdicts(good).where("kept").collect()}
    rows = kept.orderBy("doc_id").collect()
    assert not any(brute.base_counts(r.text)["base_failed"] for r in rows)
    prints = np.array([brute.simhash(r.text) for r in rows], dtype=np.uint64)
    first = set(brute.classes(len(rows), lambda i: np.bitwise_count(prints ^ prints[i]) <= 4))
    single = corpus_pipeline.drop_near_duplicates(spark, kept, SMALL).cache()
    assert sorted(map(tuple, single.collect())) == sorted(tuple(rows[i]) for i in first)
    mixed = corpus_pipeline.mix_sources(spark, single, SMALL).cache()
    copies, taken = Counter(r.doc_id for r in mixed.collect()), {r.doc_id: r for r in source_mix.mix(single).collect()}
    for i, r in taken.items():  # whole passes through a source count as many copies; a cut one by its half
        assert abs(copies[i] - r.taken / r.size) <= 0.5 and (r.taken % r.size or copies[i] == r.taken // r.size)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in single.collect()}
    for r in corpus_pipeline.encode(spark, mixed, SMALL).collect():
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False)


def test_mix_against_sql(spark):
    got = queries.op10_source_mix(spark, SMALL).withColumn("target", F.round("target", 6)).toArrow()
    sql = f"SELECT * REPLACE (round(target, 6) AS target) FROM ({queries.ORACLE_SQL['op10_source_mix']})"
    assert differences(got, connect(SMALL).sql(sql).to_arrow_table()) == []
