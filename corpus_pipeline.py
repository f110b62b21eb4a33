"""From raw documents to packed training sequences: quality, near-duplicates, mixture, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``, whatever further columns came in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xmlframe.llm import copies, mixing, packing, quality
from xmlframe.llm.common import written
from xmlframe.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents stay whose rating is more likely than not the best one (well written, not toxic).

    A null text is rated as an empty one. With no rated document among ``docs`` all stay.
    """
    docs = docs.select(*COLUMNS)
    model = quality.train(docs, quality.graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.score(docs, model).where("kept").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup at a five-word shingle similarity of 0.8 or more: of each group of linked documents the one with the smallest id stays.

    Of repeated rows with this id in the group one stays. Rows without an id stay only where no linked document has one.
    """
    docs = docs.select(*COLUMNS)
    groups = written(copies.near_copies(docs, width=5), "pipeline-groups")
    first = groups.where("doc_id <=> component_id").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "root").distinct()
    kept = docs.join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key")))
    named = kept.where("doc_id is not null").dropDuplicates(["doc_id", "root"])
    return named.unionByName(kept.where("doc_id is null")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pfair mixing: all documents once, in the order of the mixture; a source of n has a target weight of n to the power 1/2.

    Files in the order of their names, and rows in the order of a file, follow the schedule.
    """
    docs = docs.select(*COLUMNS)
    mixed = mixing.mix(docs, ties=("n_chars", "lang", "text"))
    return mixed.repartitionByRange("mix_position").sortWithinPartitions("mix_position").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the pieces of all documents and their places in sequences of at most 4096 tokens, which follow the mixture.

    Each run of 4,096 documents of the mixture is packed by itself and before the next, sequences of a run by their earliest piece.
    """
    pieces = packing.pack_documents(docs, vocabulary(), cache_words=CACHE_WORDS, in_order=True)
    return pieces.select(F.col("row_id").alias("doc_id"), "start", "length", F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", "offset")


#: The workers and heaps that the packing meets are grown by the stages before: it keeps fewer words than alone.
CACHE_WORDS = 100_000
STAGES = [("quality", keep_good), ("near_duplicates", drop_copies), ("mixture", mix_sources), ("packing", pack_sequences)]

#: A trained model, fingerprint components and a tokenizer: SQL expresses none of these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
