"""The corpus pipeline: toxicity, near-duplicates, personal data, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and gives the next one's documents;
what it gives is written as Parquet and read again. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcspan.llm import mixing, nearcopies, packing, pii, toxicity
from arcspan.llm.common import table, written
from arcspan.llm.queries import EPOCHS, SEED, SHARE, TOKENIZER, TREE, WEIGHTS, with_tree

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the models reject go; a document is judged row by row, so repeated rows share their fate."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_score(docs, model).where(F.col("toxic_score") < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest id stays; of its repeated rows, one.

    SimHash's index gives candidates, MinHash bands those it misses; the shingles of each pair decide.
    """
    return nearcopies.survivors(docs)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data get surrogates; ``n_chars`` follows the text."""
    out = pii.pseudonymised(docs, counts=False)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once for each epoch that takes of them; the one in which a leaf's budget ends is cut after its last token.

    Rows that share an id or have none are told apart by their texts.
    """
    rows = with_tree(docs.withColumns({"own_lang": F.col("lang"), "own_source": F.col("source")})).withColumn("text_hash", F.xxhash64("text"))
    order = (*mixing.ORDER, "text_hash")
    narrow = written(rows.select(*TREE, *order), "tokens")
    mixed = mixing.taken(rows, mixing.prefixes(narrow, TREE, WEIGHTS, SHARE, EPOCHS, SEED, order), TREE, SEED, order)
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(words, F.lit(1), F.col("taken").cast("int")), "")
    mixed = mixed.withColumn("text", F.when(F.col("taken") < F.col("n_tokens"), cut).otherwise(F.col("text")))
    mixed = mixed.withColumns({"lang": F.col("own_lang"), "source": F.col("own_source"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)})
    return mixed.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, TOKENIZER)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_copies), ("personal_data", replace_private), ("mixing", mix_sources), ("packing", pack)]

#: SQL has no Kneser-Ney models, SimHash, ciphers or byte-pair encoding; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
