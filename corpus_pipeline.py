"""The training-data pipeline: documents in, packed sequences out.

Each stage works on all that its predecessor kept. Filters return the columns of documents; a
document goes when it is toxic, a near copy of one that stays, or holds benchmark passages. Found
secrets are masked. Columns beyond those of documents pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkwise.llm import secrets
from hunkwise.llm.keyed import fresh, only, without
from hunkwise.llm.minhash import near_duplicates
from hunkwise.llm.packing import lean_tokens, pack
from hunkwise.llm.queries import table, tokenizer_file
from hunkwise.llm.shelf import Shelf, scope
from hunkwise.llm.toxicity import toxicity
from hunkwise.llm.winnowing import contamination

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5 stay; null and empty texts score as the classifier's bias says."""
    return docs.where(toxicity(docs, table(spark, sf_dir, "labels")) < 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id, one row of it.

    Rows that share a doc_id but hold different texts, and rows without a doc_id, are documents of
    their own, named by a hash of both. Null and wordless texts are no copies of one another.
    """
    shelf = Shelf(spark)
    (key,) = fresh(docs, "key")
    of_text = F.xxhash64("text")
    torn = docs.groupBy("doc_id").agg(F.min(of_text).alias("lo"), F.max(of_text).alias("hi")).where("lo != hi").select("doc_id")
    torn = shelf.put(torn.where("doc_id is not null"))
    named = F.col("doc_id").cast("long")
    hashed = F.xxhash64("doc_id", "text")
    if torn.isEmpty():
        keyed = docs.withColumn(key, F.coalesce(named, hashed))
    else:
        keyed = without(docs, torn, "doc_id").withColumn(key, F.coalesce(named, hashed)).unionByName(only(docs, torn, "doc_id").withColumn(key, hashed))
    found = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), shelf=shelf)
    found = shelf.put(found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("component_id").alias("component_id")).withColumnRenamed("doc_id", key))
    out = without(keyed, found.where(F.col(key) != F.col("component_id")).select(key), key)
    repeated = found.where((F.col(key) == F.col("component_id")) & (F.col("n") > 1)).select(key)
    if not repeated.isEmpty():
        out = without(out, repeated, key).unionByName(only(keyed, repeated, key).dropDuplicates([key]))
    return out.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item stay; null and wordless texts have none."""
    shelf = Shelf(spark)
    (key,) = fresh(docs, "key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    judged = contamination(keyed.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"), shelf=shelf)
    bad = shelf.put(judged.where("n_hit > 0").select(F.col("doc_id").alias(key)).distinct())
    return without(keyed, bad, key).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with its secrets masked and its number of characters counted anew; null texts stay null."""
    clean = docs.withColumn("text", secrets.redacted(docs, path="source" if "source" in docs.columns else None))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their places in sequences; a null text is the end token alone."""
    return pack(docs, tokenizer_file(), tokens=lean_tokens)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: Learned scores and a tokenizer are not SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again. What a stage keeps for itself goes when it is done."""
    shelf = Shelf(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scope(spark):
            docs = shelf.put(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
