"""From documents to a tokenised, mixed training corpus in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last keep the columns of ``documents``. A stage writes as many
files as it has tasks: Spark packs scans and shuffles by bytes, and packs small files together when it reads them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.llm import bpe, jaccard, lines, mixing, rules
from flowsieve.llm.queries import tokenizer_file
from flowsieve.llm.workspace import Workspace, documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIX_SHARDS = 16


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go."""
    learned = rules.learn_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rules.keep_good(docs.select(*COLUMNS), learned).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from every document; n_chars follows the text."""
    clean = lines.dedup_lines(docs.select(*COLUMNS), min_docs=10, min_chars=1)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the lowest id."""
    return jaccard.drop_near_duplicates(docs.select(*COLUMNS), percent=80, width=5).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks, in the order of the mix."""
    return mixing.mix(docs.select(*COLUMNS), mixing.mix_plan(docs, shards=MIX_SHARDS), shards=MIX_SHARDS).select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document; ``exact`` says that they decode to its text again."""
    hashed = docs.select("doc_id", "lang", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    back = bpe.bpe_encode(hashed, tokenizer_file(), decoded="decoded").withColumn("exact", F.xxhash64("decoded") == F.col("text_hash"))
    return back.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "exact")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("tokenise", tokenise),
]

#: Learned rules, components and BPE have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result is that of the last."""
    space, docs = Workspace(spark, "pipeline"), documents(spark, sf_dir)
    for n, (name, stage) in enumerate(STAGES):
        docs = space.write(stage(spark, docs, sf_dir), name)
        if n:
            space.drop(STAGES[n - 1][0])
    return docs
