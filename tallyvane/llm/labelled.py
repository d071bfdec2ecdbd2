"""Joining labels to documents for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvane.llm._common import cut


def labelled_rows(docs: DataFrame, labels: DataFrame, keep: Column, label_cols: list[str], id_col: str = "doc_id", text_col: str = "text",
                  bound: int = 100_000, distinct: bool = False) -> DataFrame:
    """(doc_id, text, labels) of documents with a label for which keep holds; keep is a condition on labels' id.

    At most `bound` labelled ids are used, those with the smallest hash; this documented bound is why they may be
    broadcast, so that no text is shuffled. Rows without an id are left out; of repeated labels the largest value counts. distinct keeps one
    document (the smallest id) of each text, so that copies do not count as evidence again.
    """
    picked = labels.where(keep & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(*(F.max(c).alias(c) for c in label_cols))
    picked = cut(picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "doc_id")
    if not distinct:
        return rows
    firsts = cut(rows.groupBy(F.xxhash64("text")).agg(F.min("doc_id").alias("doc_id")).select("doc_id"))
    return rows.join(F.broadcast(firsts), "doc_id", "left_semi")
