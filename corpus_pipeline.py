"""A corpus pipeline of five operators: quality classifier, quality rules, near duplicates, substring dedup, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of ``documents``. A null key can't be told apart in the stages that join by it: such rows are kept by the classifier and
the rules and treated as one key by the others.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwright.llm import jaccard_join, line_crf, ngram_quality, packing, substring_dedup
from blockwright.llm import repeats as rp
from blockwright.session import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least classifier score of a kept document.
MIN_QUALITY = 0.5

#: SQL can express neither a trained classifier nor a trained tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the line field takes for bad. It learns from the labelled documents of the input."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    field = line_crf.train(docs, labels)
    return line_crf.keep(docs.select(*COLUMNS), field, MIN_QUALITY)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or whose n-grams are unlike those of the labelled good documents."""
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return ngram_quality.keep(docs.select(*COLUMNS), good)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each component of similar documents; of repeated rows one."""
    docs = docs.select(*COLUMNS)
    comp = jaccard_join.near_duplicates(docs)
    leaders = comp.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.coalesce("doc_id", F.lit(rp.NO_KEY)).alias("_key")).distinct()
    keyed = docs.withColumn("_key", F.coalesce("doc_id", F.lit(rp.NO_KEY))).withColumn("_same", F.xxhash64("text"))
    # rows with the same doc_id and text are exact copies of one another
    return keyed.join(leaders.hint("shuffle_hash"), "_key", "left_semi").dropDuplicates(["_key", "_same"]).select(*COLUMNS)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that an earlier document holds; the text becomes the kept words joined by one space."""
    return substring_dedup.rewrite(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens; the rows hold the tokens themselves."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup_stage),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared checkpoint folder and read again."""
    base = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{i}-{name}")
            docs = spark.read.parquet(f"{base}/{i}-{name}")
    return docs
