"""A training corpus from ``documents``: five stages, each a function (spark, docs, sf_dir) -> DataFrame.

1. language: documents whose language is not recognised go (see ``tidemark.llm.language_id``).
2. lines: multi-line chunks that an earlier document has are cut out; documents left without any text go.
3. near_duplicates: one document, that with the least doc_id, stays of each group linked by a similarity
   of 0.75 on five-word shingles; of rows equal in doc_id and text, one.
4. benchmark: documents that hold a benchmark item go.
5. packing: the remaining documents as pieces in sequences of 2048 tokens.

All but the last return the columns of ``docs``, whatever these are. A document without a doc_id takes part in all
stages under a key from its text's hash, which comes before every doc_id. Null and empty texts, having no language,
go in the first stage; where no row has a language, all stay there. Very long texts are read whole in every stage.
Of rows equal in doc_id and text one is left after stage 3; ties there go to the least doc_id. Empty tables give
empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import documents, release, shared_dir
from tidemark.llm.decontamination import contaminated
from tidemark.llm.language_id import keep_identified
from tidemark.llm.line_dedup import remove_repeated_chunks, row_key
from tidemark.llm.ngram_join import ngram_join
from tidemark.llm.packing import best_fit_packing


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated chunks of lines; n_chars follows. Those left with white space alone go."""
    clean = remove_repeated_chunks(docs)
    cut = F.col("_removed") > 0
    clean = clean.filter(~cut | F.col("_clean").rlike(r"\S")).withColumn("text", F.col("_clean"))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(cut, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least key of every linked group, once."""
    keyed = docs.select(row_key().alias("key"), F.struct("*").alias("row"))
    linked = ngram_join(keyed.select("key", "row.text"), doc_id="key")
    stay = linked.filter("doc_id = component_id").select(F.col("doc_id").alias("key")).distinct()
    return keyed.join(stay, "key", "left_semi").withColumn("text", F.col("row.text")).dropDuplicates(["key", "text"]).select("row.*")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    keyed = docs.select(row_key().alias("key"), F.struct("*").alias("row"))
    found = contaminated(keyed.select("key", "row.text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id="key")
    return keyed.join(found.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed."""
    return best_fit_packing(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("packing", packing)]

#: The stages are not expressible in SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = documents(spark, sf_dir), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        release(spark)
    return docs
