"""A corpus from documents to packed sequences: language, near copies, benchmark passages, packing.

Each stage reads all that the stage before kept, as a table in the shared folder, and what it decides takes effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import decontam, langid, packing, similar, simhash
from spanloom.llm.shared import ship, stage, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognised; those that are null, have no letter or fit no language go."""
    ship(spark)
    return langid.accept(docs, langid.train(langid.learning_rows(docs)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group that is linked by texts whose five-word shingles have a Jaccard similarity of 0.8 or more: SimHash links, verified, then an exact pass for what SimHash misses."""
    ship(spark)
    return simhash.keep_first(docs, similar.near_copies(docs))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of the benchmark out of the texts; documents that consist of them for the larger part go."""
    kept = decontam.clean(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    same = F.length("text").cast(dict(docs.dtypes)["n_chars"]) if "n_chars" in docs.columns else None
    return kept if same is None else kept.withColumn("n_chars", same)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens: one row a piece."""
    ship(spark)
    return packing.pack_documents(docs, with_ids=False, spare=True)


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("benchmark_passages", benchmark_passages),
    ("packed", packed),
]

#: Hashing, learning, automata and packing are beyond SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"stage-{name}")
    return docs
