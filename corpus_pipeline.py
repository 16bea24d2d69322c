"""Training-corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

1. language_id: documents whose language the model rejects go.
2. near_duplicates: of documents linked by shingle Jaccard of 0.8 or more, that with the smallest id stays.
3. repeated_passages: byte strings of 200 that repeat anywhere are cut out; documents left without text go.
4. decontaminate: documents that leak a benchmark item go.
5. packing: what is left is cut into sequences of 2048 tokens.

All columns of documents are carried through the first four stages, extra ones too. Rows with a null id are documents
like others: in the stages that decide by id, a number made from the text, above all ids, stands for the null. Rows that share an id stay
or go together; of rows that share id and text, near_duplicates keeps one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.llm.common import staged
from catalogspark.llm.decontaminate import leaks
from catalogspark.llm.jaccard_join import jaccard_components
from catalogspark.llm.language_id import keep_identified
from catalogspark.llm.packing import pack_documents
from catalogspark.llm.queries import tokenizer_path
from catalogspark.llm.repeats import remove_repeats

_ID = "__pipeline_id"


def _named(docs: DataFrame) -> DataFrame:
    """`docs` with an id that is never null."""
    made = F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(1 << 62)
    return docs.withColumn(_ID, F.coalesce(F.col("doc_id").cast("long"), made))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is identified. Null text, and text without a letter, is rejected; without a labelled row to
    learn from all are; an empty table stays empty."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, that with the smallest id (a null id only where all are). Texts
    without words link with nothing and stay; equal rows are one document."""
    own = _named(docs)
    gone = jaccard_components(own, _ID).where("component_id <> id").select(F.col("id").alias(_ID)).distinct()
    kept = own.join(gone, _ID, "left_anti").withColumn("__text_hash", F.xxhash64("text"))
    return kept.dropDuplicates([_ID, "__text_hash"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with every repeated string of 200 bytes cut out of `text` (and n_chars counted anew); rows that are blank
    after that, or had a null or blank text, go."""
    kept = remove_repeats(docs, as_text=True).where(F.trim("kept_text") != "")
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return kept.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that leak no item of the benchmark table; all rows where that is empty."""
    own = _named(docs)
    gone = leaks(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), _ID).select(F.col("id").alias(_ID)).distinct()
    return own.join(gone, _ID, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row, under its doc_id (null ids too); no pieces of an empty table."""
    return pack_documents(docs, tokenizer_path()).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: The language model and the tokeniser can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
