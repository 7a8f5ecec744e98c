"""The corpus pipeline: five filtering stages over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm import decontam, line_dedup, line_rules, mixing, oracles, superminhash
from treeloom.llm.queries import PARAMETERS
from treeloom.storage import discard, fresh_path, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects, without the lines above the limits; ``n_chars``
    follows the text."""
    kept = line_rules.kept_documents(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated lines; ``n_chars`` follows the text."""
    now = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return line_dedup.dedup_lines(docs).select(*[now.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate group."""
    return superminhash.kept_documents(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix_sources),
]
ORACLE_SQL = f"""WITH RECURSIVE {oracles.quality_rules('documents', 'a_', *PARAMETERS['rules'])},
s1 AS (SELECT d.doc_id, a.clean AS text, d.lang, d.source, length(a.clean)::BIGINT AS n_chars FROM documents d JOIN a_text a USING (doc_id)), {oracles.line_dedup('s1', 'b_')},
s2 AS (SELECT d.doc_id, b.kept AS text, d.lang, d.source, length(b.kept)::BIGINT AS n_chars FROM s1 d JOIN b_out b USING (doc_id)), {oracles.near_duplicates('s2', 'c_')},
s3 AS (SELECT d.* FROM s2 d JOIN c_out c USING (doc_id) WHERE c.kept), {oracles.contaminated('s3', 'd_', *PARAMETERS['leaks'])},
s4 AS (SELECT * FROM s3 WHERE doc_id NOT IN (SELECT doc_id FROM d_out)), {oracles.mixing('s4', 'e_', *PARAMETERS['mix'])}
SELECT d.* FROM s4 d JOIN (SELECT doc_id, unnest(range(copies)) AS copy FROM e_out) c USING (doc_id)"""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again. What a
    stage leaves behind, and the table before it, go as soon as it is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = fresh_path(spark, name.replace(" ", "_"))
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
