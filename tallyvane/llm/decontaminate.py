"""Benchmark decontamination: a prefix-filtered join of item windows with documents, verified word by word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyvane.llm._common import cut
from tallyvane.llm._words import Hashed, portions, word_counts, words

#: Binary logarithm of the bits of the table that says which shingles may be wanted: 8 MB, whatever the number of windows.
TABLE_BITS = 26


def _marks(ids: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << TABLE_BITS - 3, np.uint8)
    spot = (ids >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
    np.bitwise_or.at(table, spot >> 3, (1 << (spot & 7)).astype(np.uint8))
    return table


def _marked(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    spot = (ids >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
    return (table[spot >> 3] >> (spot & 7).astype(np.uint8) & 1).astype(bool)


def mark_table(rows: DataFrame, column: str) -> np.ndarray:
    """A bit table of fixed size over 64-bit ids (signed longs); tables of tasks are joined byte by byte."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(1 << TABLE_BITS - 3, np.uint8)
        for batch in batches:
            table |= _marks(batch["id"].to_numpy().view(np.uint64))
        used = np.flatnonzero(table)
        yield pd.DataFrame({"spot": used, "bits": table[used].astype(np.int32)})

    table = np.zeros(1 << TABLE_BITS - 3, np.uint8)
    merged = rows.select(F.col(column).alias("id")).mapInPandas(run, "spot int, bits int").groupBy("spot").agg(F.bit_or("bits").alias("bits")).toPandas()
    table[merged["spot"].to_numpy()] = merged["bits"].to_numpy().astype(np.uint8)
    return table


def item_windows(items: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, words binary, n): each window of `size` consecutive words of each item; a shorter item is one window."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for item, text in zip(batch["item"], batch["text"]):
                own = words(text)
                spans = [own] if 0 < len(own) < size else [own[k : k + size] for k in range(len(own) - size + 1)]
                out += {(item, b" ".join(w), len(w)) for w in spans}
            yield pd.DataFrame(out, columns=["item", "words", "n"])

    return items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).mapInPandas(run, "item string, words binary, n int")


def window_shingles(windows: DataFrame, width: int) -> DataFrame:
    """(words, n, id, place): the shingles of each window, `width` words wide; a window of fewer words is one shingle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for wide in range(1, width + 1):
                some = batch[np.minimum(batch["n"], width) == wide]
                hashed = Hashed(some["words"])
                first, ids = hashed.shingles(wide)
                row = hashed.owner[first]
                place = first - (np.cumsum(hashed.sizes) - hashed.sizes)[row]
                yield pd.DataFrame({"words": some["words"].to_numpy()[row], "n": some["n"].to_numpy()[row], "id": ids.view(np.int64), "place": place})

    return windows.mapInPandas(run, "words binary, n int, id long, place int")


def document_frequencies(texts: DataFrame, wanted: np.ndarray, widths: list[int]) -> DataFrame:
    """(id, df): in how many texts each shingle occurs, of those that the bit table marks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for part in portions(texts):
                hashed, found = Hashed(texts[part]), [np.empty(0, np.uint64)]
                for width in widths:
                    first, ids = hashed.shingles(width)
                    at = np.flatnonzero(_marked(wanted, ids))
                    pair = pd.DataFrame({"o": hashed.owner[first[at]], "h": ids[at]}).drop_duplicates()
                    found.append(pair["h"].to_numpy())
                own, times = np.unique(np.concatenate(found), return_counts=True)
                yield pd.DataFrame({"id": own.view(np.int64), "n": times})

    return texts.mapInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("df"))


def probes(texts: DataFrame, wanted: np.ndarray, widths: list[int], reach: int) -> DataFrame:
    """(one, two, id, at, before, after, context): where the texts (one, two, text) hold marked shingles.

    at is the shingle's first word; context has `before` words before it and `after` from it on, up to `reach` words away.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, one, two = batch["text"].tolist(), batch["one"].to_numpy(), batch["two"].to_numpy()
            for part in portions(texts):
                hashed = Hashed(texts[part])
                ends = np.cumsum(hashed.sizes)
                for width in widths:
                    first, ids = hashed.shingles(width)
                    at = np.flatnonzero(_marked(wanted, ids))
                    for few in np.array_split(at, max(1, len(at) // 50_000)):
                        word = first[few]
                        row = hashed.owner[word]
                        begin, end = np.maximum(ends[row] - hashed.sizes[row], word - reach), np.minimum(ends[row], word + reach + 1)
                        context = [hashed.text(a, b) for a, b in zip(begin.tolist(), end.tolist())]
                        spot = row + part.start
                        yield pd.DataFrame({"one": one[spot], "two": two[spot], "id": ids[few].view(np.int64), "at": word - (ends - hashed.sizes)[row], "before": word - begin, "after": end - word, "context": context})

    return texts.mapInPandas(run, "one long, two long, id long, at int, before int, after int, context binary")


def window_hits(texts: DataFrame, items: DataFrame, size: int = 10, width: int = 3, id_col: str = "item_id", text_col: str = "text", bound: int = 200_000) -> DataFrame:
    """(one, two, start, n, item): each place where a text (one, two, text) holds a window of an item, word for word.

    The shingles of a window, `width` words wide, are ordered by the number of texts that hold them. As all of them must be
    there, the rarest alone is the prefix that a text has to share. Texts are probed for the prefixes of all windows through
    a bit table of fixed size; what it lets through is joined with the windows by shingle. A window must then fit between
    the ends of the text where the shingle puts it, and is compared with the words found there.

    Up to `bound` windows are broadcast, more are shuffled, with the texts' side salted, as one shingle may be most of it.
    """
    pieces = cut(item_windows(items, size, id_col, text_col))
    windows = pieces.select("words", "n").distinct()
    shingles = cut(window_shingles(windows, width))
    widths = sorted(r["w"] for r in shingles.select(F.least("n", F.lit(width)).alias("w")).distinct().collect())
    if not widths:
        return texts.sparkSession.createDataFrame([], "one long, two long, start int, n int, item string")
    counts = document_frequencies(texts.select("text"), mark_table(shingles, "id"), widths)
    rarity = F.struct(F.coalesce("df", F.lit(0).cast("long")).alias("df"), "id", "place")
    prefixes = cut(shingles.join(counts, "id", "left").groupBy("words", "n").agg(F.min(rarity).alias("p")).where("p.df > 0").select("words", "n", "p.id", "p.place"))
    found = probes(texts, mark_table(prefixes, "id"), widths, size - 1)
    if prefixes.limit(bound + 1).count() <= bound:
        joined = found.join(F.broadcast(prefixes), "id")
    else:
        salt = F.pmod(F.xxhash64("one", "at"), F.lit(16)).cast("int")
        joined = found.withColumn("salt", salt).join(prefixes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15)))), ["id", "salt"])
    fits = joined.where("before >= place and after >= n - place")
    there = F.array_join(F.slice(F.split(F.col("context").cast("string"), " "), F.col("before") - F.col("place") + 1, F.col("n")), " ")
    exact = fits.where(there == F.col("words").cast("string")).select("one", "two", (F.col("at") - F.col("place")).alias("start"), "words", "n").distinct()
    return exact.join(F.broadcast(pieces) if pieces.limit(bound + 1).count() <= bound else pieces, ["words", "n"]).select("one", "two", "start", "n", "item")


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, width: int = 3, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", bound: int = 200_000) -> DataFrame:
    """(doc_id, n_words, n_hit, items) of every document: its words, those inside a window of some item, and the items.

    A window is `size` consecutive words of an item, or all of a shorter one. items are the ids, as text, in order. Texts
    are told apart by 128 bits of their hashes, so copies share their result. Null and wordless texts have no words and no
    hits, and such items, or those without an id, no windows; rows that repeat are kept; other columns are left out; empty
    tables give no rows, or no hits. Up to `bound` texts with hits are broadcast to the documents, more are shuffled.
    """
    count = F.pandas_udf(lambda texts: pd.Series(np.concatenate([np.empty(0, np.int64), *(word_counts(texts.iloc[p]) for p in portions(texts))])), "long")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = (F.xxhash64(text).alias("one"), F.xxhash64(text, F.lit(1)).alias("two"))
    hits = cut(window_hits(docs.select(*keys, text.alias("text")), items, size, width, item_col, item_text, bound))
    spans = hits.select("one", "two", "start", (F.col("start") + F.col("n")).alias("end")).distinct()
    before = Window.partitionBy("one", "two").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))), F.lit(0))
    covered = spans.select("one", "two", fresh.cast("long").alias("n")).groupBy("one", "two").agg(F.sum("n").alias("n_hit"))
    named = hits.groupBy("one", "two").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = cut(covered.join(named, ["one", "two"]))
    rows = docs.select(F.col(doc_col).cast("long").alias("doc_id"), count(text).alias("n_words"), *keys)
    joined = rows.join(F.broadcast(found) if found.limit(bound + 1).count() <= bound else found, ["one", "two"], "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
