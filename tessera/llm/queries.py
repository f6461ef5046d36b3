"""The registered queries of this subpackage, and SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard_join, license_scan, packing, pseudonyms, quality_model, quality_rules, runs, sentence_spans, spellings, substrings, tokens, topk
from tessera.llm.common import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_store(spark, table(spark, sf_dir, "documents"), word_bpe()).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = jaccard_join.jaccard_components(spark, docs, n=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    measured = quality_rules.apply_rules(docs, first=quality_rules.BASE_RULES, measures=quality_rules.BASE_MEASURES)
    return measured.select("doc_id", *quality_rules.BASE_MEASURES, "base_failed", "kept")


#: For tests and checks only; a deployment passes a key of its own.
PUBLIC_KEY = b"not a secret: for tests and checks only"


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pseudonyms.pseudonymize(docs, PUBLIC_KEY)
    return found.select("doc_id", "text", *[F.coalesce(F.try_element_at("pii", F.lit(k.name)), F.lit(0)).cast("long").alias(f"n_{k.name}") for k in pseudonyms.KINDS])


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.train(docs, table(spark, sf_dir, "labels"))
    return quality_model.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"), word_bpe())


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.dedup_substrings(spark, docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "text")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentence_spans.dedup_spans(spark, docs).select("doc_id", "n_sentences", "n_removed", "text")


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.every_hundredth(spark, table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), pattern=True)
    return found.withColumn("best", runs.strongest()).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000L * best.length div best.period").alias("exponent_milli"),
        F.sha2(runs.listed(), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spellings.count_words(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spellings.group_spellings(spark, words).select("word", "form", "root", "n", "n_near", "form_n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_store": op1_token_store,
        "op2_jaccard_join": op2_jaccard_join,
        "op3_license_scan": op3_license_scan,
        "op4_quality_rules": op4_quality_rules,
        "op5_pseudonyms": op5_pseudonyms,
        "op6_quality_model": op6_quality_model,
        "op7_packing": op7_packing,
        "op8_substrings": op8_substrings,
        "op9_decontaminate": op9_decontaminate,
        "op10_sentence_spans": op10_sentence_spans,
        "op11_topk_search": op11_topk_search,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_spelling_groups": op13_spelling_groups,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_license_scan": license_scan.scan_sql(),
        "op4_quality_rules": quality_rules.rules_sql(),
        "op11_topk_search": topk.search_sql(),
    }
