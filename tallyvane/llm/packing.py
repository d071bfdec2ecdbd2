"""Best-fit packing of tokenised documents into fixed-length sequences by minimum bin slack."""

from __future__ import annotations

import base64
import zlib
from functools import cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyvane.llm._common import cut

#: The added token of byte_bpe_50k.json, which the rank file does not hold.
SPECIAL = {"<|endoftext|>": 50256}


@cache
def _encoder(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=SPECIAL)


def tokenizer_paths() -> tuple[str, str]:
    """(rank file, split pattern) of the public byte-level BPE: the vocabulary of byte_bpe_50k.json as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2,
                 tokenizer: tuple[str, str] | None = None, special: bool = True) -> DataFrame:
    """Tokenise each whole text, append end_id, and cut documents of more than capacity ids into pieces.

    The remainder is the first piece, all later ones are full. Null text is an empty one: a single piece [end_id].
    The rank file gives the same ids as the JSON file of that vocabulary, several times faster (a test compares them).
    The added token of the JSON file gets its own id wherever texts hold it, as tokenizers does with that file; without
    `special`, text that looks like it is ordinary text. Rows without an id keep a null one; other columns are left out.
    """
    ranks_path, pattern = tokenizer or tokenizer_paths()

    def cut_up(texts: pd.Series) -> pd.DataFrame:
        encoder = _encoder(ranks_path, pattern)
        encode = partial(encoder.encode, allowed_special=set(SPECIAL)) if special else encoder.encode_ordinary
        firsts, checks = [], []
        for text in texts.array:
            ids = np.array([*encode(text or ""), end_id], dtype="<u4")
            firsts.append(len(ids) % capacity or capacity)
            edges = [0, *range(firsts[-1], len(ids) + 1, capacity)]
            checks.append([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(edges, edges[1:])])
        return pd.DataFrame({"first": firsts, "checks": checks})

    # Only texts go through Python, so ids, null or of any size, stay as they are.
    cuts = F.pandas_udf(cut_up, "first long, checks array<long>")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), cuts(F.col(text_col)).alias("c")).select("doc_id", "c.first", F.posexplode("c.checks").alias("piece", "ids_crc32"))
    begin = F.when(F.col("piece") == 0, F.lit(0).cast("long")).otherwise(F.col("first") + (F.col("piece") - 1) * F.lit(capacity).cast("long"))
    length = F.when(F.col("piece") == 0, F.col("first")).otherwise(F.lit(capacity).cast("long"))
    return rows.select("doc_id", "piece", begin.alias("start"), length.alias("length"), "ids_crc32")


def fullest(counts: np.ndarray, room: int) -> list[tuple[int, int]]:
    """The combination of available lengths with the largest sum up to room, as (length, copies), longest first.

    counts[n] is how many pieces of length n are available. Bit s of the set is 1 if s is a reachable sum; each length
    enters in copies that double, so that k copies cost log k shifts.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        left, take = min(int(counts[length]), room // length), 1
        while left > 0:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, take = left - take, take * 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            used[length] = used.get(length, 0) + take
    return sorted(used.items(), reverse=True)


def plan_bins(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Minimum bin slack over a histogram of lengths: (number of equal bins, their (length, copies)) in order.

    Each bin opens with the longest piece left, and the subset-sum table fills the rest as far as possible. The same
    combination is the answer again while all its lengths last, so it is taken for as many bins at once: the work depends
    on the number of distinct lengths, not on the number of pieces.
    """
    left, plan = counts.astype(np.int64).copy(), []
    left[0] = 0
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        left[longest] -= 1
        inside = dict(fullest(left, capacity - longest))
        left[longest] += 1
        inside[longest] = inside.get(longest, 0) + 1
        bins = min(int(left[n]) // k for n, k in inside.items())
        for n, k in inside.items():
            left[n] -= bins * k
        plan.append((bins, sorted(inside.items(), reverse=True)))
    return plan


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Place pieces (doc_id, piece, start, length, ids_crc32) in as few sequences as minimum bin slack finds.

    Adds sequence_id and offset. Only the histogram of lengths, at most capacity numbers, reaches the driver. Pieces of a
    length are numbered in parallel by salted groups, and each number names its place in the plan. Ties (equal lengths)
    go by hash, doc_id and piece. An empty table gives an empty result.
    """
    pieces = cut(pieces)
    lengths = cut(pieces.groupBy("length").agg(F.count("*").alias("n")))
    counts = np.zeros(capacity + 1, np.int64)
    for row in lengths.collect():
        counts[row["length"]] = row["n"]
    groups = lengths.select("length", F.ceil(F.col("n") / F.greatest(F.lit(500.0), F.sqrt("n"))).alias("groups"))
    salted = pieces.join(F.broadcast(groups), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "groups")).drop("groups")
    cells = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("r", F.row_number().over(within)).join(starts, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("r") - 1)

    # For each length, the ranks at which a run of equal bins begins, with what places its pieces.
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    taken, sequence = np.zeros(capacity + 1, np.int64), 0
    for bins, inside in plan_bins(counts, capacity):
        offset = 0
        for length, copies in inside:
            runs.setdefault(length, []).append((int(taken[length]), copies, sequence, offset))
            taken[length] += bins * copies
            offset += length * copies
        sequence += bins
    tables = {length: np.array(rows, np.int64).T for length, rows in runs.items()}

    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        lengths, ranks = lengths.to_numpy(), ranks.to_numpy()
        sequence_id, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for length in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == length)
            begin, copies, first, shift = tables[length]
            run = np.searchsorted(begin, ranks[at], "right") - 1
            nth = ranks[at] - begin[run]
            sequence_id[at] = first[run] + nth // copies[run]
            offset[at] = shift[run] + nth % copies[run] * length
        return pd.DataFrame({"sequence_id": sequence_id, "offset": offset})

    places = F.pandas_udf(place, "sequence_id long, offset long")
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", places("length", "rank").alias("p")).select("doc_id", "piece", "start", "length", "ids_crc32", "p.*")


def best_fit_pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: tuple[str, str] | None = None,
                  id_col: str = "doc_id", text_col: str = "text", special: bool = True) -> DataFrame:
    """Tokenise, cut and pack whole documents; see token_pieces and pack.

    Null texts are empty ones, texts of any length are cut into pieces, repeated rows are packed as often as they occur,
    ties go by hash, extra columns, whatever their names, are left out, and an empty table gives an empty result.
    """
    return pack(token_pieces(docs, id_col, text_col, capacity, end_id, tokenizer, special), capacity)
