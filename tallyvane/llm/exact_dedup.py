"""Exact duplicates with a heavy-hitter split (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyvane.llm._common import cut, without


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 1e-3) -> DataFrame:
    """Group documents whose texts are identical, and mark the one with the largest id.

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256; other input columns are left out, so
    their names cannot clash. Null text counts as empty. Rows that share the largest id are all marked kept (they are
    the same document); a group whose ids are all null has keep_id null and its rows are kept. An empty table gives an
    empty result.

    The Misra-Gries counters (DataFrame.stat.freqItems, 1/support of them) find every digest that has more than that
    share of the rows. Their exact counts are then verified, and the winners, at most 1/support rows, are broadcast, so
    that their rows never enter a shuffle. All other digests are grouped by an ordinary shuffle, in which no group can
    exceed the support share.
    """
    rows = cut(
        docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256"))
        .withColumn("k", F.xxhash64("text_sha256"))
    )
    frequent = rows.stat.freqItems(["k"], support).select(F.explode("k_freqItems").alias("k"))
    winners = cut(
        rows.join(F.broadcast(frequent), "k", "left_semi")
        .groupBy("text_sha256")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
    )
    hot = rows.join(F.broadcast(winners), "text_sha256").select("doc_id", "keep_id", "group_size", "text_sha256")
    group = Window.partitionBy("text_sha256")
    cold = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti").select(
        "doc_id", F.max("doc_id").over(group).alias("keep_id"), F.count("*").over(group).alias("group_size"), "text_sha256"
    )
    return hot.union(cold).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 1e-3) -> DataFrame:
    """The rows of docs that exact_groups keeps, with all their columns.

    Only ids of dropped documents are joined back. Where one id occurs with several texts, each (id, text) is judged alone.
    """
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    dropped = (
        exact_groups(docs, id_col, text_col, support)
        .where("not kept")
        .select(F.col("doc_id").alias("__drop_id"), F.col("text_sha256").alias("__drop_sha"))
        .distinct()
    )
    return without(docs, dropped, docs[id_col].eqNullSafe(F.col("__drop_id")) & (digest == F.col("__drop_sha")))
