"""The stages one after another, each held against a plain version on its own input."""

import re

import public_tokenizers
from pyspark.sql import functions as F
from test_nearcopies import roots
from tokenizers import Tokenizer

import corpus_pipeline
from arcspan.llm import pii
from arcspan.llm.common import table, written


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, sf), name)
        seen[name] = (before.collect(), docs.collect())
        if name != "packing":
            assert docs.columns == columns
    given, left = seen["toxicity"]
    assert {r.doc_id for r in left} < {r.doc_id for r in given} and set(left) <= set(given)
    given, left = seen["near_duplicates"]
    given = sorted(given, key=lambda r: r.doc_id)  # five-word shingles, similarity 0.8, every pair compared
    assert sorted(r.doc_id for r in left) == sorted(given[k].doc_id for k in set(roots([r.text for r in given])))
    given, left = seen["personal_data"]
    want = {r.doc_id: pii.rewrite(r.text)[0] for r in given}
    assert {r.doc_id: r.text for r in left} == want and all(r.n_chars == len(r.text) for r in left)
    given, left = seen["mixing"]
    texts = {r.doc_id: r.text for r in given}
    assert all(texts[r.doc_id].startswith(r.text) for r in left)
    words = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows)
    assert words(left) == words(given) * 8 // 10
    given, left = seen["packing"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sum(r.length for r in left) == sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in given)


def test_run_equals_its_stages(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.where(F.col("offset") + F.col("length") > 4096).count() == 0 and rows.count() > 0


def test_odd_documents(spark, tmp_path, odd_rows):
    docs = spark.createDataFrame([(k, t, a, b, len(t) if t is not None else None) for k, t, a, b, *_ in odd_rows], "doc_id long, text string, lang string, source string, n_chars long")
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    left = corpus_pipeline.drop_near_copies(spark, docs, d).collect()
    assert sorted((r.doc_id for r in left), key=str) == sorted([1, 3, 6, 7, 8, None, 9, 10], key=str)  # null, empty and blank are one class
    clear = corpus_pipeline.replace_private(spark, docs, d).collect()
    assert len(clear) == len(odd_rows) and sum(r.text is None for r in clear) == 1
    mixed = corpus_pipeline.mix_sources(spark, docs, d).collect()
    words = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows)
    assert words(mixed) == words(docs.collect()) * 8 // 10 and not {3, 4, 5} & {r.doc_id for r in mixed}
    packed = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in packed} <= {r[0] for r in odd_rows} and 7 in {r.doc_id for r in packed} and all(r.offset + r.length <= 4096 for r in packed)
    docs.limit(0).write.mode("overwrite").parquet(f"{d}/documents.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
