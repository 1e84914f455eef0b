"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import bpe, decontaminate, langid, packing, phrases, quality, rules, runs, secrets, setsketch, suffixes, warc, whitening
from stowage.llm.common import read
from stowage.llm.oracles import ORACLES
from stowage.storage import scratch_path


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file; the package that holds it is installed on every worker."""
    import public_tokenizers

    return public_tokenizers.path(name)


__all__ = ["ORACLES", "REGISTRY"]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(read(spark, sf_dir, "pages"), path)
    records = warc.read_archives(spark, path)
    # A response's figures come from the payload read back, a revisit's from its headers.
    return records.select(
        "page_id", F.coalesce(F.octet_length("payload").cast("bigint"), "payload_bytes").alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), "payload_digest").alias("payload_digest"), "record_type", "refers_to",
    )


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *secrets.counts("base"), F.sha2(secrets.joined("base").cast("binary"), 256).alias("base_sha256"),
        secrets.joined("found").alias("spans"), "n_layers",
    )


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(read(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op6_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = phrases.remove_repeated_phrases(read(spark, sf_dir, "documents"))
    return cleaned.select(
        "doc_id", "n_words", phrases.n_removed().alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(read(spark, sf_dir, "documents"), vocabulary(), with_decoded=True)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(read(spark, sf_dir, "documents"))


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffixes.remove_repeated_bytes(read(spark, sf_dir, "documents"))
    return cleaned.select(
        "doc_id", "n_bytes", suffixes.n_removed().alias("n_removed"), F.size("starts").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(read(spark, sf_dir, "documents"), plant=True)
    return found.select(
        "doc_id", F.size("starts").cast("bigint").alias("n_runs"), runs.strongest().alias("best"),
        F.sha2(runs.listed().cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    ).select("doc_id", "n_runs", "best.*", "runs_sha256", "collapsed_sha256")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(whitening.whiten(read(spark, sf_dir, "embeddings")))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary())


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_secrets": op2_secrets,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_language_id": op5_language_id,
    "op6_phrase_automata": op6_phrase_automata,
    "op7_decontamination": op7_decontamination,
    "op8_bpe": op8_bpe,
    "op9_quality_rules": op9_quality_rules,
    "op10_suffix_array": op10_suffix_array,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_best_fit_packing": op13_best_fit_packing,
}
