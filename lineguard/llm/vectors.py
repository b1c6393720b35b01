"""Near-duplicate embeddings by hierarchical navigable small-world graphs, one per shard.

Vectors of a label are dealt to shards of bounded size. Each shard's graph is built and audited once and written; every
distinct vector of the label is then searched for in each of the label's shards. The audit compares searches with brute force on rows
of the shard, half of them from its densest places, and widens the beam until it finds nearly all of their links. A query whose beam is full of
candidates doubles it for itself. Candidates are verified by cosine in double precision; links become components by union
over all shards.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineguard.llm.common import stage
from lineguard.llm.components import components

COSINE = 0.98
#: Bytes of a shard's vectors on average (65,536 vectors of 64 dimensions), and queries of one task; both are dealt by hash.
SHARD_BYTES, QUERIES = 1 << 25, 16_384
#: Neighbours that a node keeps per layer (twice as many on the lowest), and the beam while a graph is built.
DEGREE, BUILD_BEAM = 8, 48
BEAM = 32
#: Places where a search enters the lowest layer.
ENTRIES = 8
#: Vectors of a shard that its audit searches for, and the share of their links that must be found.
AUDITED, RECALL = 128, 0.995
#: Queries that move through a graph together.
_TOGETHER = 512
#: Nodes that enter a graph together; they are compared with each other directly.
_BATCH = 256


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows over their length, in double precision; the largest component is taken out first, so that squares neither overflow nor vanish."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


class Graph:
    """A navigable small-world graph on unit vectors, which are numbered by row.

    A vector that would link to a node of the graph becomes a follower of it instead of a node, so a crowd of near
    copies is a few nodes and cannot wall off the rest. Angles obey the triangle inequality: what links to
    a query is a node within twice the linking angle or a follower of one.
    """

    def __init__(self, vectors: np.ndarray, least: float, seed: int = 7):
        n = len(vectors)
        self.exact, self.near, self.least = vectors, vectors.astype(np.float32), least
        levels = np.floor(-np.log(np.random.default_rng(seed).uniform(1e-12, 1, n)) / np.log(DEGREE)).astype(int)
        order = np.argsort(-levels, kind="stable")  # high nodes first, so that upper layers steer the building of lower ones
        self.entry, top = int(order[0]), int(levels.max())
        widths = [2 * DEGREE if k == 0 else DEGREE for k in range(top + 1)]
        self.layers = [np.full((n, w), -1, dtype=np.int64) for w in widths]  # neighbours by node, -1 where there are fewer
        self.likes = [np.full((n, w), -2.0, dtype=np.float32) for w in widths]
        self.leader = np.arange(n)
        lo = 1
        while lo < n:
            batch = order[lo : lo + min(_BATCH, max(8, lo))]
            self._insert(batch, levels)
            lo += len(batch)
        self._join_parts()
        self.members = np.argsort(self.leader, kind="stable")
        self.first = np.searchsorted(self.leader[self.members], np.arange(n + 1))
        self.beam = BEAM

    def dump(self) -> bytes:
        """All that a search needs."""
        out = io.BytesIO()
        layers = {f"layer{k}": layer.astype(np.int32) for k, layer in enumerate(self.layers)}
        numbers = np.array([self.entry, self.beam, len(self.layers)])
        np.savez(out, exact=self.exact, members=self.members, first=self.first, numbers=numbers, least=self.least, **layers)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Graph:
        self, z = cls.__new__(cls), np.load(io.BytesIO(data))
        self.exact, self.members, self.first, self.least = z["exact"], z["members"], z["first"], float(z["least"])
        self.near = self.exact.astype(np.float32)
        self.entry, self.beam, n = (int(x) for x in z["numbers"])
        self.layers = [z[f"layer{k}"] for k in range(n)]
        return self

    def _join_parts(self) -> None:
        """More links on the lowest layer, which displace no others: back from the nearest neighbour of each node, where that one has nearer
        ones only, and between nodes that cannot be reached and the nearest that can."""
        nodes = np.flatnonzero(self.leader == np.arange(len(self.leader)))
        best = self.likes[0][nodes].argmax(axis=1)
        nearest = self.layers[0][nodes, best]
        one_way = (nearest >= 0) & ~(self.layers[0][nearest] == nodes[:, None]).any(axis=1)
        self._extend(nearest[one_way], nodes[one_way], 2 * DEGREE)
        reached = np.zeros(len(self.leader), dtype=bool)
        more: list[tuple[int, int]] = []

        def spread(front: np.ndarray) -> None:
            reached[front] = True
            while len(front):
                to = np.unique(self.layers[0][front])
                front = to[(to >= 0) & ~reached[to]]
                reached[front] = True

        spread(np.array([self.entry]))
        for u in nodes:
            if not reached[u]:
                inside = np.flatnonzero(reached)
                v = int(inside[(self.near[inside] @ self.near[u]).argmax()])
                more += [(v, int(u)), (int(u), v)]
                spread(np.array([u]))
        if more:
            self._extend(*np.array(more).T, len(more))

    def _extend(self, at: np.ndarray, to: np.ndarray, most: int) -> None:
        """Adds links from *at* to *to* in columns of their own, up to *most* for a node."""
        order = np.argsort(at, kind="stable")
        at, to = at[order], to[order]
        _, first, n = np.unique(at, return_index=True, return_counts=True)
        place = np.arange(len(at)) - np.repeat(first, n)
        fit = place < most
        extra = np.full((len(self.leader), int(place[fit].max(initial=-1)) + 1), -1, dtype=np.int64)
        extra[at[fit], place[fit]] = to[fit]
        self.layers[0] = np.hstack([self.layers[0], extra])

    def _insert(self, batch: np.ndarray, levels: np.ndarray) -> None:
        start = np.full(len(batch), self.entry)
        found = {}
        for k in range(len(self.layers) - 1, -1, -1):
            start, *found[k] = self._beam(self.near[batch], start, k, BUILD_BEAM if k == 0 or (levels[batch] >= k).any() else 1)
        among = self.near[batch] @ self.near[batch].T
        close = found[0][1][:, 0] >= self.least
        self.leader[batch[close]] = found[0][0][close, 0]
        new: list[int] = []
        for i in np.flatnonzero(~close):
            mate = new[int(among[i, new].argmax())] if new else -1
            if mate >= 0 and among[i, mate] >= self.least:
                self.leader[batch[i]] = batch[mate]
            else:
                new.append(int(i))
        among = np.where(np.tril(np.ones_like(among, dtype=bool), -1), among, -2.0)
        for k, (ids, sims) in found.items():
            here = np.array([i for i in new if levels[batch[i]] >= k], dtype=int)
            if not len(here):
                continue
            mates = among[np.ix_(here, here)]
            take = np.argsort(-mates, axis=1)[:, : 2 * DEGREE]
            both = np.concatenate((ids[here], batch[here][take]), axis=1)
            like = np.concatenate((sims[here], np.take_along_axis(mates, take, axis=1)), axis=1)
            sort = np.argsort(-like, axis=1, kind="stable")
            self._connect(batch[here], np.take_along_axis(both, sort, axis=1), np.take_along_axis(like, sort, axis=1), k)

    def _connect(self, nodes: np.ndarray, ids: np.ndarray, like: np.ndarray, k: int) -> None:
        """Links each node to candidates (nearest first) that are not nearer to one it links to already, then to the nearest left; and back."""
        width = self.layers[k].shape[1]
        ids, like = ids[:, : 3 * width], like[:, : 3 * width]
        good = like > -1.5
        own = self.near[np.where(good, ids, 0)]
        between = own @ own.transpose(0, 2, 1)
        kept = np.zeros_like(good)
        for j in range(ids.shape[1]):
            crowded = np.where(kept, between[:, j], -2.0).max(axis=1) >= like[:, j]
            kept[:, j] = good[:, j] & ~crowded & (kept.sum(axis=1) < width)
        rank = np.where(kept, 0, np.where(good, 1, 2))
        pick = np.argsort(rank, axis=1, kind="stable")[:, :width]
        chosen = np.where(np.take_along_axis(good, pick, axis=1), np.take_along_axis(ids, pick, axis=1), -1)
        score = np.where(chosen >= 0, np.take_along_axis(like, pick, axis=1), -2.0)
        self.layers[k][nodes, : chosen.shape[1]], self.likes[k][nodes, : chosen.shape[1]] = chosen, score
        at, new, sims = chosen.ravel(), np.repeat(nodes, chosen.shape[1]), score.ravel()
        at, new, sims = at[at >= 0], new[at >= 0], sims[at >= 0]
        sort = np.lexsort((-sims, at))
        at, new, sims = at[sort], new[sort], sims[sort]
        targets, first, n = np.unique(at, return_index=True, return_counts=True)
        place = np.arange(len(at)) - np.repeat(first, n)
        more = np.full((len(targets), width), -1, dtype=np.int64)
        more_like = np.full((len(targets), width), -2.0, dtype=np.float32)
        fit = place < width
        row = np.repeat(np.arange(len(targets)), n)[fit]
        more[row, place[fit]], more_like[row, place[fit]] = new[fit], sims[fit]
        all_ids = np.concatenate((self.layers[k][targets], more), axis=1)
        all_like = np.concatenate((self.likes[k][targets], more_like), axis=1)
        best = np.argsort(-all_like, axis=1, kind="stable")[:, :width]
        self.layers[k][targets] = np.take_along_axis(all_ids, best, axis=1)
        self.likes[k][targets] = np.take_along_axis(all_like, best, axis=1)

    def _beam(self, queries: np.ndarray, start: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest node, and the *beam* nearest with their likeness (-2 where fewer), per query, on layer *k*; all queries step together.

        *start* has one node per query or several (-1 where fewer, no node twice).
        """
        q, layer = len(queries), self.layers[k]
        start = np.reshape(start, (q, -1))[:, :beam]
        rows, m = np.arange(q), start.shape[1]
        ids = np.full((q, beam), -1, dtype=np.int64)
        sims = np.full((q, beam), -2.0, dtype=np.float32)
        done = np.ones((q, beam), dtype=bool)
        given = start >= 0
        ids[:, :m], done[:, :m] = start, ~given
        sims[:, :m] = np.where(given, np.einsum("ij,ikj->ik", queries, self.near[start]), -2.0)
        seen = np.zeros((q, len(self.near)), dtype=bool)
        seen[rows[:, None], np.where(given, start, start[:, :1])] = True
        active = rows
        while len(active):
            best = np.where(done[active], -3.0, sims[active]).argmax(axis=1)
            at = ids[active, best]
            done[active, best] = True
            near = layer[at]
            fresh = (near >= 0) & ~seen[active[:, None], near]
            seen[active[:, None], np.where(fresh, near, at[:, None])] = True
            like = np.einsum("ij,ikj->ik", queries[active], self.near[near])
            all_ids = np.concatenate((ids[active], np.where(fresh, near, -1)), axis=1)
            all_sims = np.concatenate((sims[active], np.where(fresh, like, -2.0)), axis=1)
            all_done = np.concatenate((done[active], ~fresh), axis=1)
            part = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[active] = np.take_along_axis(all_ids, part, axis=1)
            sims[active] = np.take_along_axis(all_sims, part, axis=1)
            done[active] = np.take_along_axis(all_done, part, axis=1)
            active = active[(~done[active]).any(axis=1)]
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        return ids[:, 0], ids, sims

    def _reached(self, low: np.ndarray, beam: int, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Queries (by place) with their nodes within *reach*; beams that are full of such nodes are doubled until they aren't."""
        start = np.full((len(low), 1), self.entry)
        for k in range(len(self.layers) - 1, 0, -1):
            start = self._beam(low, start, k, ENTRIES)[1]
        open_rows, beam = np.arange(len(low)), min(beam, len(self.near))
        while len(open_rows):
            _, ids, sims = self._beam(low[open_rows], start[open_rows], 0, beam)
            full = (sims[:, -1] >= reach) & (beam < len(self.near))
            who, col = np.nonzero((sims >= reach) & (ids >= 0) & ~full[:, None])
            yield open_rows[who], ids[who, col]
            open_rows, beam = open_rows[full], min(2 * beam, len(self.near))

    def search(self, queries: np.ndarray, beam: int | None = None) -> Iterator[np.ndarray]:
        """For each query the rows that link to it, as far as their leaders are found."""
        reach = np.float32(np.cos(2 * np.arccos(self.least)) - 1e-4)
        for lo in range(0, len(queries), _TOGETHER):
            part = queries[lo : lo + _TOGETHER]
            out: list[list[np.ndarray]] = [[] for _ in part]
            for who, led in self._reached(part.astype(np.float32), beam or self.beam, reach):
                by_leader = np.argsort(led, kind="stable")
                who, led = who[by_leader], led[by_leader]
                for leader, a in zip(*np.unique(led, return_index=True)):
                    askers = who[a : np.searchsorted(led, leader, side="right")]
                    rows = self.members[self.first[leader] : self.first[leader + 1]]
                    linked = part[askers] @ self.exact[rows].T >= self.least
                    for i, hit in zip(askers, linked):
                        out[i].append(rows[hit])
            yield from (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)

    def audit(self) -> float:
        """Doubles the beam until ``RECALL`` of the links of the audited rows are found; returns the share that is."""
        n = len(self.near)
        crowded = np.argsort(-np.where(self.layers[0] >= 0, self.likes[0][:, :1], -2.0).max(axis=1), kind="stable")
        some = np.linspace(0, n - 1, min(AUDITED // 2, n)).astype(int)
        picks = np.unique(np.concatenate([some, crowded[some // 4]]))
        want = [np.flatnonzero(row >= self.least) for row in self.exact[picks] @ self.exact.T]
        while True:
            missed = sum(len(np.setdiff1d(w, g)) for w, g in zip(want, self.search(self.exact[picks])))
            found = 1 - missed / max(1, sum(map(len, want)))
            if found >= RECALL or self.beam >= n:
                return found
            self.beam *= 2


class Union:
    """Sets of numbers, merged many at a time; a set is named by its smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, rows: np.ndarray) -> np.ndarray:
        up = self.parent[rows]
        while True:
            above = self.parent[up]
            if (above == up).all():
                self.parent[rows] = up
                return up
            up = above

    def merge(self, rows: np.ndarray) -> None:
        tops = self.roots(rows)
        self.parent[tops] = tops.min()


def _vectors(t: pd.DataFrame) -> np.ndarray:
    return unit(np.array(t["vector"].tolist(), dtype=np.float64))


def _links_in(shard: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """Per query its links into a shard (copies counted) and one vector that it is connected with; and shard rows that queries connect."""
    graph = Graph.load(shard["graph"].iloc[0])
    own, copies = np.frombuffer(shard["reps"].iloc[0], dtype=np.int64), np.frombuffer(shard["copies"].iloc[0], dtype=np.int64)
    reps, sets = asked["rep"].to_numpy(), Union(len(own))
    n, first = np.zeros(len(reps), dtype=np.int64), np.full(len(reps), -1)
    for i, hits in enumerate(graph.search(_vectors(asked))):
        hits = hits[own[hits] != reps[i]]
        if len(hits):
            n[i], first[i] = copies[hits].sum(), hits[0]
            sets.merge(hits)
    top = sets.roots(np.arange(len(own)))
    linked, moved = first >= 0, top != np.arange(len(own))
    return pd.DataFrame(
        {
            "rep": np.concatenate([reps[linked], own[moved]]),
            "n": np.concatenate([n[linked], np.zeros(moved.sum(), dtype=np.int64)]),
            "to": np.concatenate([own[top[first[linked]]], own[top[moved]]]),
        }
    )


#: A shard's graph with the vectors' names and copies, and the share of audited links that is found.
_GRAPH = "kind string, shard int, blocks int, graph binary, reps binary, copies binary, recall double"


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = COSINE, shard_bytes: int = SHARD_BYTES, queries: int = QUERIES
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of *vectors*.

    Only vectors of equal label that is not null are compared. Vectors that are null or empty, have length zero or hold
    a null or non-finite component link with nothing, and neither do vectors of other dimensions. Equal vectors are
    one node: their number counts as links and no pairs are made of them. Repeated rows are vectors each; an
    empty table gives an empty result. A row without an id links like others; if no id is in reach, component_id is null.
    Graph search may miss links; the audits hold its recall (README has measured figures), and no link below *least* is made.
    """
    v = F.col("vector")
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label"))
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)) & F.col("label").isNotNull())
    key = F.sha2(F.to_json(F.struct("label", "vector")), 256)
    rows = stage(rows.withColumn("key", F.when(F.col("sound"), key)).drop("sound"), "vectors")
    nodes = rows.where("key IS NOT NULL").groupBy("key").agg(
        F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("first")
    )
    nodes = nodes.withColumn("kind", F.concat_ws(" ", F.col("label").cast("string"), F.size("vector").cast("string")))
    nodes = stage(nodes.withColumn("rep", F.xxhash64("key")), "nodes")
    shards = F.ceil(F.col("rows") * F.col("dims") * 8 / shard_bytes).cast("int")
    sizes = nodes.groupBy("kind").agg(F.count("*").alias("rows"), F.first(F.size("vector")).alias("dims"))
    sizes = sizes.select("kind", shards.alias("shards"), F.ceil(F.col("rows") / queries).cast("int").alias("blocks"))
    share = lambda salt, parts: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(parts)).cast("int")
    dealt = nodes.join(sizes, "kind").withColumns({"shard": share(1, "shards"), "block": share(2, "blocks")})

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep")
        graph = Graph(_vectors(rows), least)
        found = graph.audit()
        reps, copies = (rows[c].to_numpy(dtype=np.int64).tobytes() for c in ("rep", "copies"))
        return pd.DataFrame([[*key, int(rows["blocks"].iloc[0]), graph.dump(), reps, copies, found]], columns=_GRAPH.replace(",", "").split()[::2])

    graphs = dealt.select("kind", "shard", "blocks", "rep", "copies", "vector").groupBy("kind", "shard").applyInPandas(build, _GRAPH)
    graphs = stage(graphs, "graphs").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = dealt.select("kind", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "block", "rep", "vector")
    asked = asked.toDF(*[f"asked_{c}" for c in asked.columns]).toDF(*asked.columns)  # columns of its own, as both come from one table

    def links(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if len(a) and len(b):
            return _links_in(a, b.sort_values("rep"))
        return pd.DataFrame({"rep": [], "n": [], "to": []}).astype("int64")

    pairs = graphs.groupBy("kind", "shard", "block").cogroup(asked.groupBy("kind", "shard", "block"))
    found = stage(pairs.applyInPandas(links, "rep long, n long, to long"), "vector-links")
    degree = found.groupBy("rep").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("rep").alias("u"), F.col("to").alias("v")))
    grouped = nodes.select("key", "rep", "copies", "first").join(degree, "rep", "left").join(roots, F.col("rep") == roots["node"], "left")
    grouped = grouped.withColumn("root", F.coalesce("root", "rep"))
    lowest = grouped.groupBy("root").agg(F.min("first").alias("component"))
    known = grouped.join(lowest, "root").select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component")
    out = rows.select("vec_id", "key").join(known, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select(
        F.col("vec_id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
