"""Resampling of documents towards a target distribution, by importance weights of hashed n-gram features."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvane.llm._common import cut
from tallyvane.llm._words import flat, portions
from tallyvane.operators.ranks import running_number


def crc_table(polynomial: int = 0xEDB88320) -> np.ndarray:
    """The remainders of all single bytes under the reflected polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(polynomial), table >> 1)
    return table


CRC = crc_table()


def crc_all(features: list[bytes]) -> np.ndarray:
    """The unsigned crc32 of each byte string.

    Strings of equal length stand below each other in one matrix of bytes; a step takes a column of it and moves the
    checksums of all its rows, which at the end go back to where the strings came from.
    """
    out = np.zeros(len(features), np.uint32)
    lengths = np.fromiter(map(len, features), np.int64, len(features))
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.diff(lengths[order], prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(order)]):
        at, length = order[a:b], int(lengths[order[a]])
        matrix = np.frombuffer(b"".join([features[k] for k in at]), np.uint8).reshape(len(at), length)
        state = np.full(len(at), 0xFFFFFFFF, np.uint32)
        for column in np.ascontiguousarray(matrix.T):
            state = CRC[(state ^ column) & 0xFF] ^ state >> 8
        out[at] = ~state
    return out


def features(texts: Iterable[str | None], most: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each feature, features per text): all runs of 1 to `most` consecutive words, text by text.

    Distinct features of the portion are hashed once. Runs of several words are told apart by the ids of their beginning
    and last word, and are joined by one space.
    """
    known, which, sizes = flat(texts)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    left = ends[owner] - np.arange(len(which)) if len(which) else which
    names, ids, found, owners = known, which, [], []
    for n in range(1, most + 1):
        if n > 1:
            at = np.flatnonzero(left >= n)
            pair = ids[at] * len(known) + which[at + n - 1]
            first, back = np.unique(pair, return_index=True, return_inverse=True)[1:]
            names = [names[ids[at[f]]] + b" " + known[which[at[f] + n - 1]] for f in first]
            ids = np.full(len(which), -1, np.int64)
            ids[at] = back
        else:
            at = np.arange(len(which))
        found.append((crc_all(names) % np.uint32(buckets)).astype(np.int64)[ids[at]])
        owners.append(owner[at])
    bucket, owner = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owner, kind="stable") if most > 1 else slice(None)
    return bucket[order], np.bincount(owner, minlength=len(sizes))


def bucket_counts(rows: DataFrame, most: int = 1, buckets: int = 10_000, text_col: str = "text") -> np.ndarray:
    """How many features all texts together have in each bucket; every task returns one sum of fixed size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            texts = batch["text"].tolist()
            for part in portions(texts):
                total += np.bincount(features(texts[part], most, buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": used, "n": total[used]})

    out = np.zeros(buckets, np.int64)
    sums = rows.select(F.col(text_col).alias("text")).mapInPandas(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for row in sums.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandfold log-ratio of each bucket's smoothed share in the target to that in the source, rounded down."""
    n = len(source)
    ratio = (target + 1.0) * (source.sum() + float(n)) / ((source + 1.0) * (target.sum() + float(n)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, most: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight): weight is the mean gain of a text's features, rounded down, 0 without any."""
    buckets = len(gain)

    def run(texts: pd.Series) -> pd.DataFrame:
        texts, out = texts.tolist(), []
        for part in portions(texts):
            bucket, sizes = features(texts[part], most, buckets)
            total = np.concatenate([[0], np.cumsum(gain[bucket])])
            ends = np.cumsum(sizes)
            out.append(np.stack([sizes, (total[ends] - total[ends - sizes]) // np.maximum(sizes, 1)]))
        n, weight = np.concatenate([np.empty((2, 0), np.int64), *out], axis=1)
        return pd.DataFrame({"n_features": n, "weight": weight})

    weighed = F.pandas_udf(run, "n_features long, weight long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), weighed(F.col(text_col)).alias("w"))
    return rows.select("doc_id", "w.n_features", "w.weight")


def luck(id_col: Column, seed: int) -> Column:
    """Thousandfold Gumbel noise of an id, rounded down, from the hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_col.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def importance_resample(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = 10_000, percent: int = 10, least: int = 20,
                        seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null unless it is drawn.

    Features are runs of 1 to `most` words, hashed into buckets. A document's score is its weight and Gumbel noise of its
    id, so that taking the highest scores draws without replacement in proportion to the weights. Of the N documents with
    `least` words or more, the `percent` N / 100 with the highest scores are drawn, ties to the smaller id.

    Counts cover all texts; tables that reach the driver and tasks have one number per bucket. Null and wordless texts have
    no features and weight 0. A row without an id has no score and is not drawn, nor does it count for N; rows that repeat
    an id are drawn one by one, tied ones in any order. Other columns are left out; an empty table gives an empty result.
    """
    gain = gains(bucket_counts(docs, most, buckets, text_col), bucket_counts(target, most, buckets, target_col))
    scored = cut(weigh(docs, gain, most, id_col, text_col).withColumn("score", F.col("weight") + luck(F.col("doc_id"), seed)))
    # A text of n words has n features of one word, n - 1 of two, and so on.
    enough = sum(max(least - k, 0) for k in range(most))
    eligible = (F.col("n_features") >= enough) & F.col("doc_id").isNotNull()
    drawn = percent * scored.where(eligible).count() // 100
    ranked = running_number(scored.where(eligible), [], [F.desc("score"), F.asc("doc_id")], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.where(~eligible).withColumn("rank", F.lit(None).cast("long")))
