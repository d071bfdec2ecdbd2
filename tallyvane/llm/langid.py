"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE, SHIFT = 32, 21


@cache
def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter or combining mark of a word, else a space."""
    return np.array([c if chr(c).isalpha() else SPACE for c in range(0x110000)], dtype=np.uint32)


def letters(text: str | None) -> np.ndarray:
    """The lower-cased letters of a whole text, with one space before, between and after words; empty if it has none."""
    codes = _letters()[np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    codes = np.concatenate([[SPACE], codes, [SPACE]]).astype(np.uint64)
    codes = codes[np.concatenate([[True], (codes[1:] != SPACE) | (codes[:-1] != SPACE)])]
    return codes if len(codes) > 1 else codes[:0]


def gram_counts(codes: np.ndarray, longest: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of 1 to `longest` characters, as packed integers, and their counts. None has a space inside."""
    parts, packed, inner = [codes[codes != SPACE]], codes, np.zeros(len(codes), bool)
    for n in range(2, longest + 1):
        if len(codes) < n:
            break
        inner = inner[:-1] | ((codes[n - 2 : -1] == SPACE) if n > 2 else False)
        packed = packed[:-1] << np.uint64(SHIFT) | codes[n - 1 :]
        parts.append(packed[~inner])
    return np.unique(np.concatenate(parts), return_counts=True)


def ranked(codes: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first; ties go by the n-gram's number."""
    grams, counts = gram_counts(codes)
    return grams[np.lexsort((grams, -counts))[:size]]


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = 300) -> dict[str, list[int]]:
    """{language: its `size` most frequent n-grams} from all rows with a non-null language.

    Counts are summed per partition, then by (language, n-gram); only the profiles (languages x size numbers) reach the
    driver.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, dict[int, int]] = {}
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                own = total.setdefault(lang, {})
                texts = [t for t in texts if t]
                for k in range(0, len(texts), 200):
                    for gram, n in zip(*(x.tolist() for x in gram_counts(letters("\n".join(texts[k : k + 200]))))):
                        own[gram] = own.get(gram, 0) + n
                if len(own) > 200_000:
                    yield pd.DataFrame({"lang": lang, "gram": [*own], "n": [*own.values()]})
                    own.clear()
        for lang, own in total.items():
            yield pd.DataFrame({"lang": lang, "gram": [*own], "n": [*own.values()]})

    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    sums = rows.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = sums.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= size)
    profiles: dict[str, list[int]] = {}
    for row in sorted(top.collect(), key=lambda x: (x["lang"], x["r"])):
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


def language(text: Column, profiles: dict[str, list[int]], size: int = 300) -> Column:
    """struct<lang, score>: the language whose profile is nearest by out-of-place distance, for each whole text.

    The distance adds, for each of the document's `size` most frequent n-grams, how far its rank is from the profile's,
    or `size` where the profile lacks it. Score is 1 less the distance's share of its maximum. Null text, text without
    letters, and any text when no language was learned: `und`, 0. Ties go to the first language by name.
    """
    names = sorted(profiles)
    known = np.unique(np.concatenate([np.array(profiles[n], np.uint64) for n in names] or [np.empty(0, np.uint64)]))
    places = np.full((len(names), len(known) + 1), -1, np.int64)
    for k, name in enumerate(names):
        places[k, np.searchsorted(known, np.array(profiles[name], np.uint64))] = np.arange(len(profiles[name]))

    def one(text: str | None) -> tuple[str, float]:
        codes = letters(text)
        if not len(codes) or not names:
            return "und", 0.0
        grams = ranked(codes, size)
        at = np.searchsorted(known, grams)
        at = np.where((at < len(known)) & (known[np.minimum(at, len(known) - 1)] == grams), at, len(known))
        found = places[:, at]
        distance = np.where(found < 0, size, np.abs(found - np.arange(len(grams)))).sum(1)
        best = int(distance.argmin())
        return names[best], 1 - float(distance[best]) / (size * len(grams))

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts.array], columns=["lang", "score"])

    return F.pandas_udf(run, "lang string, score double")(text)


def identify_languages(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text", size: int = 300) -> DataFrame:
    """(doc_id, lang_pred, score) of every row; other columns are left out. Repeated rows give repeated results."""
    return docs.select(F.col(id_col).alias("doc_id"), language(F.col(text_col), profiles, size).alias("p")).select(
        "doc_id", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score")
    )
