"""The corpus pipeline: documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the
columns of docs. Null ids, null texts, repeated rows and extra columns are handled as the
operators' own texts say; here, rows with a null id are never near duplicates and lose no bytes.
"""

from __future__ import annotations

import functools
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamloom.llm import byte_bpe, jaccard_join, quality_rules, source_mixing, suffix_dedup
from beamloom.llm.queries import vocabulary
from beamloom.llm.shared import collected, compact, dropped, recorded, released, spent, table, written

#: By thread and sf_dir, the tables that its last stages have written on their way.
_LEFT: dict[tuple[int, str], list[str]] = {}


def _stage(f):
    """The stage, before which tables of the stage before go that docs does not read, and executors give free memory back; docs is that
    stage's result, written. So a thread writes a stage's result before it calls another stage for the same sf_dir; runs in other
    threads have lists of their own."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _LEFT.setdefault((threading.get_ident(), sf_dir), [])
        released(spark, left, docs)
        collected(spark)
        with recorded() as tables:
            out = f(spark, docs, sf_dir)
        left += [p for p in tables if p not in left]
        return out

    return run


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their host's verdict reject go."""
    return quality_rules.quality_rules(docs).filter("kept").select(*docs.columns)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 or more, the smallest id stays."""
    found = jaccard_join.jaccard_components(docs, n=5, percent=80)
    gone = written(compact(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()), "near-duplicates")
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that a smaller id has are cut out of the texts; a cut inside a character drops what is left of it."""
    cut = suffix_dedup.suffix_dedup(docs, texts=True).filter("n_removed > 0")
    cut = cut.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("kept").alias("__kept"))
    cut = written(cut, "cut")
    spent(spark, cut)  # the join below shuffles all texts: batches and records of the operator are not on disk beside them
    cut = cut.dropDuplicates(["__id", "__hash"])
    text = F.when(F.col("__kept").isNotNull(), F.col("__kept").cast("string")).otherwise(F.col("text"))
    joined = docs.join(cut, (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left").withColumn("text", text)
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col("__kept").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return joined.select(*docs.columns)


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target weights of source, language and topic."""
    return source_mixing.mix(docs).filter("kept").select(*docs.columns)


@_stage
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and whether decoding gives the text's bytes again."""
    import public_tokenizers

    encoded = byte_bpe.encode_documents(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, check=True)
    return encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", token_ids),
]

#: Prefix tables of byte-pair merges are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")  # one table a stage, kept until the next one is there
        dropped(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
