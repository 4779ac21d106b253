"""Content-addressed assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .keyed import KeyedTable


def assets(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per content: sha256, size_bytes, copies. files: content (binary) and whatever else."""
    own = files.select(F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("long").alias("size_bytes"))
    return own.groupBy("sha256").agg(F.max("size_bytes").alias("size_bytes"), F.count("*").alias("copies"))


class AssetStore:
    """Contents under their digests, each once and never changed, and an index of their owners."""

    def __init__(self, spark: SparkSession, path: str):
        self._contents = KeyedTable(spark, f"{path}/contents", "sha256 string, size_bytes long, content binary", ["sha256"])
        self._index = KeyedTable(spark, f"{path}/index", "sha256 string, owner string", ["sha256", "owner"])

    def add(self, files: DataFrame, owner: str, content: str = "content") -> None:
        """Contents that the store lacks are written; null ones are no assets. files is read twice, so that no copy of its contents is made for the index."""
        own = files.where(F.col(content).isNotNull()).select(F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("long").alias("size_bytes"), F.col(content).alias("content"), F.col(owner).cast("string").alias("owner"))
        self._contents.insert_absent(own.drop("owner"), ["size_bytes"])
        self._index.insert_absent(own.select("sha256", "owner"), [])

    def contents(self) -> DataFrame:
        return self._contents.read()

    def index(self) -> DataFrame:
        return self._index.read()


def is_pdf(content: Column) -> Column:
    return F.substring(content, 1, 5) == F.lit(b"%PDF-")
