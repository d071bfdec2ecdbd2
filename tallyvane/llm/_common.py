"""Helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvane.session import cut, shared_folder

__all__ = ["cut", "ensure_checkpoint_dir", "fold", "without"]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in spark.checkpoint.dir."""
    shared_folder(spark)


def fold(id_col: str, modulus: int, remainder: int) -> Column:
    """True for held-out rows: crc32 of the id as text has that remainder. A null id counts as not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))


def without(docs: DataFrame, dropped: DataFrame, on: str | Column, bound: int = 200_000) -> DataFrame:
    """The rows of docs that have no partner in dropped, a table of keys, with their columns as they are.

    Up to `bound` dropped rows are broadcast, so that no text moves; beyond it, docs and keys are shuffled and joined.
    """
    dropped = cut(dropped)
    few = dropped.limit(bound + 1).count() <= bound
    return docs.join(F.broadcast(dropped) if few else dropped, on, "left_anti").select(*docs.columns)
