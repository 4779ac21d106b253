"""A corpus pipeline: five of the operators, each working on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldroll.llm import bpe, decontamination, langid, secrets, simhash
from fieldroll.llm.common import id_crc, new_path, ship, written
from fieldroll.llm.queries import BYTE_VOCABULARY, vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found, with that language as lang: the first of the set that the mixture gives.

    Rejected are null and empty texts and such without a letter. Ties of languages go to the first by name; repeated rows
    have repeated results; an empty table gives an empty one; other columns, of any name, are kept.
    """
    model = langid.fit(docs.where(id_crc("doc_id") % 4 != 2))
    return langid.accepted(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, a similarity of 0.8 or more.

    The smallest doc_id of a group stays, one row of it. Null and empty texts are copies of each other; an empty table
    gives an empty one; other columns are kept.
    """
    return simhash.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, decided row by row.

    Null and empty texts and items match nothing; an empty table on either side changes nothing; repeated rows and other
    columns are kept.
    """
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked, n_chars with them.

    Null and empty texts stay as they are; repeated rows are masked alike; other columns, also such named blob, spans or
    row, are kept.
    """
    rows = secrets.scanned(docs.select("text", F.struct(*docs.columns).alias("row")), secrets.Ledger(spark, new_path(spark, "ledger")))
    found = F.size("spans") > 0
    text = F.when(found, secrets.redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    changed = {"text": text, "n_chars": F.when(found, F.length(text).cast("long")).otherwise(F.col("row.n_chars"))}
    return rows.select(*((changed[c] if c in changed else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids and lang of every document; null and empty texts have no ids."""
    return bpe.round_trip(docs, vocabulary(BYTE_VOCABULARY), with_ids=True, keep=("lang",))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("bpe_tokens", bpe_tokens),
]

#: Inferring languages, fingerprints and merges have no form in SQL: the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
