"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, mixing, packing.

Each stage takes all documents that its predecessor kept, decides on whole texts, and returns the rows that stay, with the
columns of documents; the last returns the placed pieces. Stage outputs are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvane.llm import langid, mixing, packing, simhash
from tallyvane.llm._common import cut, fold, without
from tallyvane.llm.exact_dedup import exact_dedup
from tallyvane.llm.labelled import labelled_rows
from tallyvane.llm.queries import labelled_domain
from tallyvane.session import scratch

#: Clean good text sets the budget and keeps nearly all its tokens; the other domains are thinned to these shares.
WEIGHTS = {"q1t0": 0.93, "q1t1": 0.01, "q0t0": 0.05, "q0t1": 0.01}


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without any language: null, empty and letterless texts. Repeated rows stay or go together; whole texts
    count, however long; other columns play no part and stay; an empty table stays empty."""
    profiles = langid.learn_profiles(docs.where(~fold("doc_id", 5, 0)))
    return docs.where(langid.language(F.col("text"), profiles)["lang"] != "und")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the largest id of each group of identical texts; null counts as empty text, a null id as the
    smallest. Rows that repeat id and text stay or go together; other columns stay; an empty table stays empty."""
    return exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each component of texts that share four fifths of their five-word shingles.

    Of texts with that id, ties go to the smaller hash. Rows without an id, and texts without words, which are alike to
    none, stay. Rows that repeat id and text stay or go together; other columns stay; an empty table stays empty.
    """
    linked = cut(simhash.similar_components(docs).where("doc_id is not null").distinct())
    first = linked.groupBy("component_id").agg(F.min(F.struct("doc_id", "node")).alias("first"))
    dropped = linked.join(first, "component_id").where(F.struct("doc_id", "node") != F.col("first"))
    dropped = dropped.select(F.col("doc_id").alias("__drop_id"), F.col("node").alias("__drop_node"))
    node = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return without(docs, dropped, (docs["doc_id"] == F.col("__drop_id")) & (node == F.col("__drop_node")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep each document with the probability that is its rate (0 to 1), drawn from a hash of its id.

    Null and wordless texts have no tokens and the rate that their figures give; rows that repeat id and text stay or go
    together; other columns play no part and stay; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    known = labelled_rows(docs, labels, F.lit(True), ["quality", "toxic"], bound=20_000).select("text", labelled_domain().alias("domain"))
    key = F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"))
    rates = mixing.mix(docs.select(key.alias("key"), "text"), known, WEIGHTS, id_col="key", max_rate=1.0)
    draw = F.pmod(F.xxhash64("doc_id.doc_id", F.lit("mix")), F.lit(1 << 30)) / (1 << 30)
    dropped = rates.where(draw >= F.col("rate")).select(F.col("doc_id.doc_id").alias("__drop_id"), F.col("doc_id.node").alias("__drop_node")).distinct()
    node = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return without(docs, dropped, docs["doc_id"].eqNullSafe(F.col("__drop_id")) & (node == F.col("__drop_node")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every document's tokens in sequences of 1024. A null text is an empty one, a single piece of the end id; long
    texts are cut into pieces; repeated rows are packed as often as they occur; an empty table gives no rows."""
    return packing.best_fit_pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: Language profiles, fingerprints and token ids are not expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Stage outputs go to the cluster's shared folder; each is deleted once the next is written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark, "pipeline"))
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder, name)
        stage(spark, docs, sf_dir).write.parquet(path.toString())
        docs = spark.read.parquet(path.toString())
        if before is not None:
            files.delete(before, True)
        before = path
    return docs
