"""Packing documents into fixed-length sequences by cutting-stock column generation.

Whole sequences are cut off the front of long documents; what remains of each document is one piece
shorter than a sequence. The histogram of those lengths is all the linear program sees: its
columns are patterns (how many pieces of each length share a sequence), priced by a knapsack over the
dual values. Patterns are used a whole number of times, the few pieces left by rounding down
fill further patterns largest first, and the documents of a length take the places in their rank order.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lineguard.llm.common import small_table, stage
from lineguard.llm.token_counts import UNUSUAL, byte_letters

SEQUENCE = 2048
END_ID = 1
#: Tokens per unit of the linear program; a piece is planned as if rounded up to it.
UNIT = 4
#: The program stops when it is within this share of its lower bound.
GAP = 1e-3
#: A limit on the rounds of the program, which it does not meet in practice; what is left then is packed all the same.
MOST_KNAPSACKS = 300
#: Rows that are ranked by one window task of a length.
RANKED_ROWS = 2_000

# Fixed value: the words that the byte-level tokenizer cuts a text into.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids of a byte-level tokenizer file as little-endian 32-bit bytes.

    Where each id is the place of its merge, as in the usual files, a faster implementation of the same
    merges encodes the texts (the tests hold it against the tokenizer library). Texts with unusual
    characters, for which the two may carry other Unicode tables, and other files go to the library.
    """

    def __init__(self, path: str):
        self.path = path
        self.quick = self._quick(path)

    @cached_property
    def library(self):
        """The tokenizer library, loaded when a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _quick(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        joined = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges]
        ids = [vocab[t] for t in joined]
        plain = spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        strict = not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        if not plain or not strict or spec["normalizer"] or ids != sorted(set(ids)):
            return None
        byte = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
        return tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if self.quick and (text.isascii() or not UNUSUAL.search(text)):
            return self.quick.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut(text: Column, path: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> Column:
    """The pieces of each document (its ids, then *end_id*): an array of ``start, length, ids_crc32, doc_tokens``.

    All but the last are *sequence* ids long. Null counts as the empty text, which is one piece of one id.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    @pandas_udf("array<struct<start: long, length: long, ids_crc32: long, doc_tokens: long>>")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(path)
        for batch in batches:
            out = []
            for text in batch:
                ids = own.encode(text) + end
                n, view = len(ids) // 4, memoryview(ids)
                out.append(
                    [
                        (a, min(sequence, n - a), zlib.crc32(view[4 * a : 4 * (a + sequence)]), n)
                        for a in range(0, n, sequence)
                    ]
                )
            yield pd.Series(out, dtype=object)

    return pieces.asNondeterministic()(text)  # or the filter that Spark infers from an explode would encode each text again


def knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room up to *capacity* the greatest worth of a multiset of *sizes* (ascending), and its last member (or -1)."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fit = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(int(sizes[0]), capacity + 1):
        options = worth[: fit[c]] + best[c - sizes[: fit[c]]]
        j = int(options.argmax())
        if options[j] > best[c - 1]:
            best[c], pick[c] = options[j], j
        else:
            best[c] = best[c - 1]
    return best, pick


def _members(pick: np.ndarray, sizes: np.ndarray, room: int, first: int) -> np.ndarray:
    """The pattern of the knapsack that holds *first* and fills the rest of *room* best."""
    taken = np.zeros(len(sizes))
    taken[first] += 1
    room -= int(sizes[first])
    while room > 0:
        if pick[room] < 0:
            room -= 1
        else:
            taken[pick[room]] += 1
            room -= int(sizes[pick[room]])
    return taken


def _largest_first(sizes: np.ndarray, need: np.ndarray, capacity: int) -> np.ndarray:
    """A feasible basis: patterns filled from the largest size down, each used until one of its sizes runs out.

    A column holds the size that runs out with it and none that ran out before, so the matrix is triangular up to order.
    """
    apart = 1 + 1e-6 * (np.arange(1, len(sizes) + 1) * 0.6180339887498949 % 1)  # so that no two run out together
    left, columns = need * apart, np.zeros((len(sizes), len(sizes)))
    for k in range(len(sizes)):
        room, use = capacity, np.zeros(len(sizes))
        for j in np.flatnonzero(left > 0)[::-1]:
            use[j] = room // sizes[j]
            room -= int(use[j]) * int(sizes[j])
        held = np.flatnonzero(use)
        rounds = left[held] / use[held]
        out = held[rounds.argmin()]
        left[held] = np.maximum(left[held] - rounds.min() * use[held], 1e-12)
        left[out] = 0.0
        columns[:, k] = use
    return columns


def patterns(demand: dict[int, int], capacity: int, gap: float = GAP) -> list[tuple[dict[int, int], int]]:
    """Patterns ``({size: pieces}, times)`` that hold *demand* (pieces by size) exactly.

    Revised simplex with column generation. Each knapsack prices the best pattern with each size in it; those
    that still pay after the pivots before them enter. Prices are drawn toward each size's share of the
    capacity, which damps their swings. It stops within *gap* of the bound that volume or the dual values
    give. Its cost depends on *capacity* only, not on the number of pieces.
    """
    sizes = np.array(sorted(s for s, n in demand.items() if n), dtype=np.int64)
    if not len(sizes):
        return []
    if sizes[0] < 1 or sizes[-1] > capacity:
        raise ValueError("sizes must lie between 1 and the capacity")
    need = np.array([demand[int(s)] for s in sizes], dtype=np.float64)
    columns = _largest_first(sizes, need, capacity)
    inverse = np.linalg.inv(columns)
    times = np.maximum(inverse @ need, 0.0)
    volume = sizes / capacity
    bound, pull, pivots = float(need @ volume), 0.9, 0
    for _ in range(MOST_KNAPSACKS):
        worth = np.ones(len(sizes)) @ inverse
        if times.sum() <= (1 + gap) * bound:
            break
        price = pull * volume + (1 - pull) * np.maximum(worth, 0.0)
        best, pick = knapsack(sizes, price, capacity)
        bound = max(bound, float(need @ price) / best[capacity])
        entered = 0
        for j in np.argsort(-(price + best[capacity - sizes])):
            column = _members(pick, sizes, capacity, int(j))
            paid = worth @ column
            if paid <= 1 + 1e-7:
                continue
            way = inverse @ column
            usable = way > 1e-7
            if not usable.any():
                continue
            ratio = np.full(len(sizes), np.inf)
            ratio[usable] = times[usable] / way[usable]
            out = int(ratio.argmin())
            amount = ratio[out]
            times = np.maximum(times - amount * way, 0.0)
            times[out] = amount
            pivot = inverse[out] / way[out]
            inverse -= np.outer(way, pivot)
            inverse[out] = pivot
            columns[:, out] = column
            worth = worth + (1 - paid) * pivot
            entered += 1
            pivots += 1
            if pivots % 200 == 0:  # rounding errors do not pile up
                inverse = np.linalg.inv(columns)
                times = np.maximum(inverse @ need, 0.0)
                worth = np.ones(len(sizes)) @ inverse
        if not entered:
            if pull == 0.0:
                break
            pull = pull / 2 if pull > 0.1 else 0.0
    left, plan = need.astype(np.int64), []
    for k in np.argsort(-times):
        use = columns[:, k].astype(np.int64)
        most = min(int(times[k] + 1e-9), int((left[use > 0] // use[use > 0]).min())) if use.any() else 0
        if most > 0:
            plan.append(({int(s): int(a) for s, a in zip(sizes, use) if a}, most))
            left -= most * use
    while left.any():
        room, use = capacity, {}
        for j in np.flatnonzero(left)[::-1]:
            a = int(min(left[j], room // sizes[j]))
            if a:
                use[int(sizes[j])] = a
                left[j] -= a
                room -= a * int(sizes[j])
        plan.append((use, 1))
    return plan


def places(spark: SparkSession, plan: list[tuple[dict[int, int], int]]) -> DataFrame:
    """One row per size and pattern: its ranks ``[low, high)``, pieces per sequence, first sequence, place in the pattern."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for use, times in plan:
        for slot, (size, a) in enumerate(sorted(use.items(), reverse=True)):
            low = used.get(size, 0)
            used[size] = low + a * times
            rows.append((size, low, used[size], a, sequence, slot))
        sequence += times
    kinds = {"size": pa.int32(), "low": pa.int64(), "high": pa.int64(), "per_sequence": pa.int32(), "first_sequence": pa.int64(), "slot": pa.int32()}
    return small_table(spark, **{name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds.items())})


def ranked(pieces: DataFrame, n: int) -> DataFrame:
    """*pieces* with ``rank``, from 0 within each ``size``, in ``pid`` order of hashed slices.

    A size may hold most rows, so it is numbered in slices of about ``RANKED_ROWS`` rows; the slice
    totals, a small table, give the offsets.
    """
    slices = max(1, -(-n // RANKED_ROWS))
    sliced = pieces.withColumn("slice", F.pmod(F.xxhash64("pid"), F.lit(slices)))
    totals = sliced.groupBy("size", "slice").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows")
    nth = F.row_number().over(Window.partitionBy("size", "slice").orderBy("pid"))
    numbered = sliced.withColumn("nth", nth)
    return numbered.join(offsets, ["size", "slice"]).withColumn("rank", F.col("before") + F.col("nth") - 1)


def pack(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID
) -> DataFrame:
    """The pieces of all documents and where they lie: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Ids are those of the tokenizer file *path* followed by *end_id*. Null and empty texts are one piece
    of one id; repeated rows are packed each; a null id stays null; an empty table gives an empty result.
    Tokenized once: pieces are staged without their ids, the rest works on that narrow table.
    """
    spark = docs.sparkSession
    found = docs.select(F.col(id_col).alias("doc_id"), cut(F.col(text_col), path, sequence, end_id).alias("pieces"))
    pieces = stage(found.select("doc_id", F.inline("pieces")).withColumn("pid", F.monotonically_increasing_id()), "pieces")
    whole = pieces.where(F.col("length") == sequence).withColumns({"sequence_id": 2 * F.col("pid"), "offset": F.lit(0).cast("long")})
    part = pieces.where(F.col("length") < sequence).withColumn("size", F.ceil(F.col("length") / UNIT).cast("int"))
    demand = {r["size"]: r["count"] for r in part.groupBy("size").count().collect()}  # at most sequence / UNIT rows
    plan = places(spark, patterns(demand, sequence // UNIT))
    at = ranked(part, sum(demand.values())).withColumnRenamed("size", "own_size")
    taken = at.join(F.broadcast(plan), (at["own_size"] == plan["size"]) & (at["rank"] >= plan["low"]) & (at["rank"] < plan["high"]))
    bin_id = F.col("first_sequence") + F.floor((F.col("rank") - F.col("low")) / F.col("per_sequence"))
    taken = taken.withColumn("sequence_id", 2 * bin_id + 1)
    before = Window.partitionBy("sequence_id").orderBy("slot", "rank").rowsBetween(Window.unboundedPreceding, -1)
    taken = taken.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return whole.select(columns).unionByName(taken.select(columns)).withColumnRenamed("doc_id", id_col)
