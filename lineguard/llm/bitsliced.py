"""Ranked lexical search over bit-sliced Bloom signatures.

Each document is a column of bits, each bit position a row over a block of documents. A document sets bits for each of
its terms, and again for terms it holds at least 2, 3, 4, 6, 8, 12 ... times. ANDing a term's rows gives the documents that may
hold it so often, never too few of them. Summing rows by term weight, level by level, bounds the score of each document
of a block from above. The best bounds give documents whose exact scores set a threshold per item, and each
document whose bound reaches it is scored exactly from its text.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lineguard.llm.common import fresh, stage

MOST_FOUND = 10
#: Times of a term in a document that have bits of their own: powers of two and the middles between them. Above the last
#: one the bound counts every term of the document.
LEVELS = np.array(sorted({1, 2} | {k << s for k in (3, 4) for s in range(14)}))
#: Bits of a signature per term and level, at least, and bits that each of them sets.
BITS, ROWS = 12, 6
#: Documents and bits of a block, at most (eight documents at least).
BLOCK_DOCS, BLOCK_BITS = 1024, 1 << 23
#: Items and distinct terms that one pass over the index answers; more items take more passes.
ITEMS, TERMS = 256, 1 << 16
#: Documents per item whose exact scores set its threshold.
SEEDS = 16

# Fixed values of the score.
_SATURATION, _LENGTH_SHARE, _TIMES, _UNIT = 8, 75, 1000, 1_000_000_000

_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c > 0x7F or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 32 for c in range(256)
)


def terms(text: str | None) -> list[bytes]:
    """Runs of characters that are not ASCII marks, spaces or controls; only A to Z are lower-cased."""
    return (text or "").encode().translate(_TABLE).split()


def spread(hashes: np.ndarray, level: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and step of the bit rows of a term at a level."""
    with np.errstate(over="ignore"):
        h = hashes ^ (np.asarray(level, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)


def bit_rows(hashes: np.ndarray, level: int | np.ndarray, width: int) -> np.ndarray:
    """``(ROWS, terms)``: the rows of a signature of *width* bits (a power of two)."""
    start, step = spread(hashes, level)
    return ((start + np.arange(ROWS, dtype=np.uint64)[:, None] * step) & np.uint64(width - 1)).astype(np.int64)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))


def _signature(text: str | None) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Terms with repeats, width, and hash and level of each key that the text sets."""
    counts = Counter(terms(text))
    h = _hashes(list(counts))
    times = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
    held = times[None, :] >= LEVELS[:, None]
    level, at = np.nonzero(held)
    width = 1 << max(6, math.ceil(math.log2(max(1, BITS * len(at)))))
    return int(times.sum()), width, h[at], level


def _block(width: int, docs: list[tuple]) -> tuple:
    columns = -(-len(docs) // 8) * 8
    bits = np.zeros((width, columns), dtype=np.uint8)
    for j, (_, _, h, level) in enumerate(docs):
        bits[bit_rows(h, level, width), j] = 1
    return width, [d[0] for d in docs], [d[1] for d in docs], np.packbits(bits, axis=1).tobytes()


def index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``width, keys, lengths, slices``: blocks of documents of similar size, bit-sliced, written once.

    Blocks are filled from the rows of a task, so nothing is shuffled. Documents without a term are not in it.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple]] = defaultdict(list)
        full = lambda w: max(8, min(BLOCK_DOCS, BLOCK_BITS // w))

        def out(width: int) -> pa.RecordBatch:
            w, keys, lengths, slices = _block(width, waiting.pop(width))
            columns = [pa.array([w]), pa.array([keys], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([slices], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["width", "keys", "lengths", "slices"])

        for batch in batches:
            for k, t in zip(batch.column("k").to_numpy(), batch.column("t")):
                n, width, h, level = _signature(t.as_py())
                if n:
                    waiting[width].append((int(k), n, h, level))
                    if len(waiting[width]) >= full(width):
                        yield out(width)
        for width in list(waiting):
            yield out(width)

    given = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return stage(given.mapInArrow(blocks, "width long, keys array<long>, lengths array<long>, slices binary"), "bit-slices")


class Queries:
    """Items of one pass: their distinct terms, how often each item holds them, and the terms' weights."""

    def __init__(self, texts: list[str | None]):
        counted = [Counter(terms(t)) for t in texts]
        self.words = sorted(set().union(*counted)) if counted else []
        at = {w: i for i, w in enumerate(self.words)}
        self.items = [sorted((at[w], q) for w, q in c.items()) for c in counted]
        self.weights = np.zeros(len(self.words), dtype=np.int64)
        self.docs = self.tokens = 0

    def weigh(self, docs: int, tokens: int, frequency: dict[int, int]) -> None:
        """Sets the weights from corpus counts; terms that no document holds are left without one."""
        self.docs, self.tokens = docs, tokens
        for i, df in frequency.items():
            self.weights[i] = math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))

    def lengthening(self, n: int) -> int:
        """The part of a score's divisor that grows with the document's length *n*."""
        return 100 - _LENGTH_SHARE + (_LENGTH_SHARE * n * self.docs) // self.tokens

    def score(self, item: int, counts: Counter, m: int) -> int:
        total = 0
        for i, q in self.items[item]:
            tf = counts.get(self.words[i], 0)
            if tf:
                total += q * int(self.weights[i]) * ((_UNIT * tf) // (_TIMES * tf + _SATURATION * m))
        return total


def _corpus_counts(docs: DataFrame, blocks: DataFrame, text: str, queries: Queries) -> None:
    """Documents, tokens, and the documents that hold each term of the queries, over the whole corpus."""
    totals = blocks.select(F.size("keys").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("t"))
    row = totals.agg(F.sum("n").alias("n"), F.sum("t").alias("t")).first()
    wanted = {w: i for i, w in enumerate(queries.words)}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for t in batch.column("t"):
                found.update(wanted.keys() & set(terms(t.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array([wanted[w] for w in found], pa.int64()), pa.array(list(found.values()), pa.int64())], ["term", "n"])

    counts = docs.select(F.col(text).alias("t")).mapInArrow(held, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    queries.weigh(int(row["n"] or 0), int(row["t"] or 0), {r["term"]: r["n"] for r in counts.collect()})


class Bounds:
    """Upper bounds of the scores of a block's documents."""

    def __init__(self, queries: Queries):
        self.queries = queries
        known = np.flatnonzero(queries.weights > 0)
        place = {int(t): i for i, t in enumerate(known)}
        self.hashes = _hashes([queries.words[i] for i in known])
        self.share = np.zeros((len(queries.items), len(known)))
        for k, item in enumerate(queries.items):
            for t, q in item:
                if t in place:
                    self.share[k, place[t]] = q * int(queries.weights[t])
        self.rows: dict[int, np.ndarray] = {}

    def of(self, width: int, lengths: np.ndarray, slices: bytes) -> np.ndarray:
        """``(items, documents)``: at least the score of each item in each document of the block."""
        columns = -(-len(lengths) // 8)
        table = np.frombuffer(slices, dtype=np.uint8).reshape(width, columns)
        m = np.array([self.queries.lengthening(int(n)) for n in lengths], dtype=np.int64)
        total = np.zeros((len(self.share), len(lengths)), dtype=np.int64)
        before = np.zeros(len(lengths), dtype=np.int64)
        maybe, terms_left = None, np.arange(len(self.hashes))
        for level in range(len(LEVELS)):
            rows = bit_rows(self.hashes[terms_left], level, width)
            here = np.bitwise_and.reduce(table[rows], axis=0)
            maybe = here if maybe is None else maybe & here
            some = maybe.any(axis=1)
            maybe, terms_left = maybe[some], terms_left[some]
            if not len(terms_left):
                break
            most = LEVELS[level + 1] - 1 if level + 1 < len(LEVELS) else np.maximum(lengths, LEVELS[level])
            reach = (_UNIT * most) // (_TIMES * most + _SATURATION * m)
            bits = np.unpackbits(maybe, axis=1, count=len(lengths)).astype(np.float64)
            total += np.rint(self.share[:, terms_left] @ bits).astype(np.int64) * (reach - before)
            before = reach
        return total


def _bounded(blocks: DataFrame, queries: Queries, least: np.ndarray | None) -> DataFrame:
    """``item, k, bound``: the documents whose bound reaches *least* of the item, or each task's best ``SEEDS`` per item."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, names = Bounds(queries), ["item", "k", "bound"]
        out = lambda item, k, bound: pa.RecordBatch.from_arrays([pa.array(item.astype(np.int64)), pa.array(k), pa.array(bound)], names)
        best_k = best = np.zeros((len(queries.items), 0), dtype=np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                keys = batch.column("keys")[i].values.to_numpy()
                upper = bounds.of(batch.column("width")[i].as_py(), batch.column("lengths")[i].values.to_numpy(), batch.column("slices")[i].as_py())
                if least is not None:
                    item, doc = np.nonzero(upper >= least[:, None])
                    yield out(item, keys[doc], upper[item, doc])
                    continue
                best, best_k = np.hstack([best, upper]), np.hstack([best_k, np.broadcast_to(keys, upper.shape)])
                if best.shape[1] > SEEDS:
                    top = np.argpartition(-best, SEEDS, axis=1)[:, :SEEDS]
                    best, best_k = np.take_along_axis(best, top, 1), np.take_along_axis(best_k, top, 1)
        if least is None:
            item, j = np.nonzero(best > 0)
            yield out(item, best_k[item, j], best[item, j])

    return blocks.select("width", "keys", "lengths", "slices").mapInArrow(found, "item long, k long, bound long")


def _scores(text: Column, items: Column, queries: Queries) -> Column:
    """Exact scores of a text for each of *items*."""

    @pandas_udf("array<struct<item: long, score: long>>")
    def scored(texts: pd.Series, wanted: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(texts, wanted):
            counts = Counter(terms(t))
            m = queries.lengthening(sum(counts.values()))
            out.append([(int(i), queries.score(int(i), counts, m)) for i in own])
        return pd.Series(out, dtype=object)

    return scored(text, items)


def _rescored(docs: DataFrame, found: DataFrame, queries: Queries) -> DataFrame:
    """``item, score, doc, k``: exact scores above 0 of the documents named by ``(item, k)``, one row per document row."""
    wanted = found.groupBy("k").agg(F.collect_set("item").alias("items"))
    scored = docs.join(wanted, "k").select("k", "doc", _scores(F.col("t"), F.col("items"), queries).alias("s"))
    return scored.select("k", "doc", F.inline("s")).where("score > 0")


def _best(scored: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc"), "k")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _passes(items: DataFrame, id_col: str, text_col: str) -> Iterator[list]:
    """Items in groups of bounded number and terms; one item with more terms than that is a group of its own."""
    group, words = [], set()
    for row in items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        own = set(terms(row["t"]))
        if group and (len(group) >= ITEMS or len(words | own) > TERMS):
            yield group
            group, words = [], set()
        group.append(row)
        words |= own
    if group:
        yield group


def search(docs: DataFrame, items: DataFrame, found: int = MOST_FOUND, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``<item_id>, rank, <doc_id>, score, candidates``: the best *found* documents for each item, whole texts on both sides.

    Only scores above 0 count, so an item without a known term has no rows, and there are fewer rows than *found*
    where fewer documents hold one. Equal scores go by ascending id, null ids first. Null texts hold no terms. Repeated
    document rows are found each, repeated items have their own rows, other columns play no part, and empty tables
    give an empty result. ``candidates`` is the number of documents that were scored exactly for the item.
    """
    k = fresh(docs, "k")
    own = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("t"), F.xxhash64(doc_id, text).alias("k"))
    blocks = index(docs.withColumn(k, F.xxhash64(doc_id, text)), k, text)
    spark, kind = docs.sparkSession, items.schema[item_id].dataType
    out = None
    for group in _passes(items, item_id, text):
        queries = Queries([r["t"] for r in group])
        _corpus_counts(own, blocks, "t", queries)
        if not queries.docs:
            continue
        order = Window.partitionBy("item").orderBy(F.desc("bound"), "k")
        seeds = _bounded(blocks, queries, None).withColumn("r", F.row_number().over(order)).where(F.col("r") <= SEEDS)
        lowest = _best(_rescored(own, seeds.select("item", "k"), queries), found).where(F.col("rank") == found)
        least = np.ones(len(group), dtype=np.int64)
        for r in lowest.select("item", "score").collect():
            least[r["item"]] = r["score"]
        reached = stage(_bounded(blocks, queries, least).select("item", "k"), "candidates")
        ranked = _best(_rescored(own, reached, queries), found)
        names = spark.createDataFrame([(i, r["i"]) for i, r in enumerate(group)], "item long, name " + kind.simpleString())
        looked = reached.groupBy("item").agg(F.count("*").alias("candidates"))
        part = ranked.join(F.broadcast(names), "item").join(looked, "item")
        part = part.select(F.col("name").alias(item_id), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(doc_id), "score", "candidates")
        out = part if out is None else out.unionByName(part)
    if out is None:
        none = items.select(F.col(item_id)).limit(0).crossJoin(docs.select(F.col(doc_id)).limit(0))
        out = none.select(item_id, F.lit(0).alias("rank"), doc_id, F.lit(0).cast("long").alias("score"), F.lit(0).cast("long").alias("candidates"))
    return out


def sql(docs: str = "documents", items: str = "benchmark", found: int = MOST_FOUND) -> str:
    """The same ranking as DuckDB SQL."""
    term = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (
    SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({lower}, {term}) AS words FROM {docs}
), size AS (
    SELECT r, doc_id, len(words)::BIGINT AS n FROM d WHERE len(words) > 0
), total AS (
    SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS tokens FROM size
), held AS (
    SELECT r, word, count(*)::BIGINT AS tf FROM (SELECT r, unnest(words) AS word FROM d) GROUP BY r, word
), asked AS (
    SELECT item_id, word, count(*)::BIGINT AS q
    FROM (SELECT item_id, unnest(regexp_extract_all({lower}, {term})) AS word FROM {items}) GROUP BY item_id, word
), weight AS (
    SELECT word, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
    FROM held, total WHERE word IN (SELECT word FROM asked) GROUP BY word
), scored AS (
    SELECT item_id, r, any_value(doc_id) AS doc_id,
        sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // tokens))))::BIGINT AS score
    FROM asked JOIN weight USING (word) JOIN held USING (word) JOIN size USING (r), total GROUP BY item_id, r
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= {found}
"""
