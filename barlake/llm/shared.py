"""Helpers that several operators of this folder use."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.session import BATCH_BYTES, checkpoint_dir, ship, small_batches  # noqa: F401

# The white space that separates words in every contract of this folder (fixed values).
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which every executor sees."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends here,
    and a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Array of the words (maximal runs without the six space characters); null text has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


class Generations(dict):
    """A bounded worker cache: ``compute(key)`` on a miss.

    Two generations of at most ``limit`` entries each. When the young one is full it
    becomes the old one, so frequent keys survive and memory stays bounded.
    """

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def put_all(self, keys: list, values: list) -> None:
        """Many entries at once: the young generation takes them whole, and is full by at most so many."""
        if len(self) + len(keys) > self.limit:
            self.old = dict(self)
            self.clear()
        self.update(zip(keys, values))
