"""From raw documents to token ids: five stages, each one operator over all rows that the stage before it kept.

``run`` writes every stage's rows to shared storage as Parquet and reads them
back for the next. All stages but the last return the columns of ``documents``;
columns beyond those the operators read (doc_id, text, lang) pass through. An
empty table gives an empty table at every stage. A doc_id is taken to name one
document: a decision about an id holds for all its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import bpe, decontaminate, langid, secrets, setsketch
from stowage.llm.common import prepare, read, settle
from stowage.llm.queries import vocabulary


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not in ``gone``; null ids stay."""
    ids = gone.select(F.col("doc_id").cast("long").alias("_gone")).filter("_gone IS NOT NULL").distinct()
    return docs.join(ids, docs["doc_id"].cast("long") == ids["_gone"], "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that language identification rejects: no letters, or text unlike any learned language."""
    prepare(spark)
    return _without(docs, langid.identify(docs).filter("NOT accepted"))


#: Percent of the union of two documents' shingles from which the near-duplicate stage takes them for copies.
NEAR = 80


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group, the one of the smallest id, and one of repeated rows."""
    prepare(spark)
    kept = _without(docs, setsketch.near_duplicates(docs, shared=NEAR).filter("NOT kept"))
    repeated = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, "doc_id", "left_anti").unionByName(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a test item of ``benchmark``, also in an edited copy."""
    prepare(spark)
    return _without(docs, decontaminate.contaminated(docs, read(spark, sf_dir, "benchmark")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask every secret, also below layers of encoding; no document goes."""
    prepare(spark)
    return secrets.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian 32-bit), decoded_sha256 of the text decoded from them."""
    prepare(spark)
    coded = bpe.encode(docs, vocabulary(), with_decoded=True)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("BPE encoding and decoding", tokens),
]

#: SQL cannot express the learned and the similarity stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the table ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = settle(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
