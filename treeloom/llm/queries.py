"""The queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bwt_dedup, decontam, filter_audit, lang_id, line_dedup, line_rules, mixing, oracles, quality_pu, spelling, superminhash, token_hist, trie_join, warc_zip


#: Where the rank file of op8 lies.
VOCABULARY = os.environ.get("TREELOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = lang_id.held_out(F.col("doc_id"))
    trained = lang_id.train(docs, fold=F.coalesce(~fold, F.lit(False)))
    found = lang_id.predict(docs, trained)
    return found.select("doc_id", F.coalesce(lang_id.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents").select("doc_id", "text"), quality_pu.held_out(F.col("doc_id"))
    trained = quality_pu.train(docs, table(spark, sf_dir, "labels"), fold=F.coalesce(~fold, F.lit(False)))
    found = quality_pu.score(docs, trained)
    return found.select("doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return d.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc_zip.package_and_read(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_hist.length_histogram(token_hist.token_lengths(table(spark, sf_dir, "documents").select("text"), VOCABULARY))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), carry=("doc_id",))
    return d.select("doc.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), with_bytes=False)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return filter_audit.audit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_join.jaccard_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_decontaminate, op3_line_dedup, op4_quality_classifier, op5_quality_rules, op6_near_duplicates, op7_warc_archives, op8_token_counts, op9_mix_sources, op10_repeated_bytes, op11_filter_audit, op12_jaccard_join, op13_spelling_variants)
}

PARAMETERS = {
    "rules": (line_rules.MAX_DOCS_PER_HOST, line_rules.MIN_WORDS, line_rules.MIN_LEFT_PERCENT, line_rules.MAX_REPEAT_PERCENT),
    "leaks": (decontam.WINDOW, decontam.MISSES, decontam.MIN_SUBSTITUTED),
    "mix": (mixing.WEIGHTS, mixing.CAP, mixing.CHUNKS, mixing.SEED),
}
#: Not here: op1, op4 (learnt models), op8 (a tokenizer), op10 (byte strings).
ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": f"WITH {oracles.contaminated('documents', 'q_', *PARAMETERS['leaks'])} SELECT * FROM q_out",
    "op3_line_dedup": f"WITH {oracles.line_dedup('documents', 'q_')} SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM q_out",
    "op5_quality_rules": f"WITH {oracles.quality_rules('documents', 'q_', *PARAMETERS['rules'])} SELECT * FROM q_out",
    "op6_near_duplicates": f"WITH RECURSIVE {oracles.near_duplicates('documents', 'q_')} SELECT * FROM q_out",
    "op7_warc_archives": oracles.archives(),
    "op9_mix_sources": f"WITH {oracles.mixing('documents', 'q_', *PARAMETERS['mix'])} SELECT doc_id, size, source_size, target, copies*size AS taken FROM q_out",
    "op11_filter_audit": oracles.filter_audit(filter_audit.MIN_WORDS, filter_audit.MIN_DISTINCT_PERCENT, filter_audit.MAX_UPPER_PERCENT),
    "op12_jaccard_join": f"WITH RECURSIVE {oracles.near_duplicates('documents', 'q_', trie_join.WIDTH, trie_join.PERCENT)} SELECT doc_id, n_shingles, component_id FROM q_out",
    "op13_spelling_variants": oracles.spelling(spelling.MIN_LENGTH, spelling.MIN_COUNT, spelling.RATIO, spelling.DAMAGED),
}
