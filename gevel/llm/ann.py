"""Approximate nearest neighbours with balanced posting lists.

A bounded sample is halved again and again at medians, so all lists are about equally long; the means of the parts are the lists' centroids. A vector goes to its nearest centroid's list, and, near a border, to some more. Centroids are found by walking a graph of them that every task holds. A query reads all lists whose centroids are not much farther than the nearest one: the first ones whole, and of the others what is not farther than the neighbours found so far. Vectors that are equal count once, with as many of their ids as an answer can need.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gevel.llm.stages import written

#: Vectors that the centroids are fitted on, about: this many, or four for each list where that is more.
SAMPLE = 20_000
#: Vectors for each list, until there are so many lists that they and the lists' lengths grow alike, as the root of the table; vectors of a list that one task compares at once.
LIST_SIZE, LISTS, BLOCK = 256, 4096, 8192
#: Lists that hold one vector, and how much farther than the nearest their centroids may be.
COPIES, COPY_RATIO = 4, 1.2
#: Lists that a query reads first, how much farther than the nearest the centroids of all that it reads may be, and the least number of vectors in them.
PROBES, PROBE_RATIO, ENOUGH = 48, 1.6, 512
#: Neighbours of a centroid in the graph, and the best ones kept on a walk.
NEAR, KEPT = 16, 64


def halved(points: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """Means of `parts` (a power of two) groups of equal size: each split is at the median between two means."""
    random = np.random.default_rng(seed)
    groups = [points]
    while len(groups) < parts:
        split = []
        for g in groups:
            two = g[random.choice(len(g), 2, replace=len(g) < 2)]
            for _ in range(6):
                side = ((g - two[0]) ** 2).sum(1) > ((g - two[1]) ** 2).sum(1)
                if side.all() or not side.any():
                    break
                two = np.stack([g[~side].mean(0), g[side].mean(0)])
            way = two[1] - two[0]
            order = np.argsort(g @ (way if way.any() else random.normal(size=g.shape[1])), kind="stable")
            split += [g[order[: (len(g) + 1) // 2]], g[order[len(g) // 2 :]]]
        groups = split
    return np.stack([g.mean(0) for g in groups])


@dataclass
class Graph:
    """Centroids with their near neighbours, some far links, and places to start from."""

    centroids: np.ndarray
    links: np.ndarray
    starts: np.ndarray

    @staticmethod
    def of(centroids: np.ndarray, seed: int = 11) -> Graph:
        n = len(centroids)
        random = np.random.default_rng(seed)
        near = min(NEAR, n - 1)
        norms = (centroids**2).sum(1)
        links = np.zeros((n, near + 4), np.int64)
        for a in range(0, n, 512):
            d = norms[a : a + 512, None] - 2 * centroids[a : a + 512] @ centroids.T + norms
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
            links[a : a + 512, :near] = np.argsort(d, 1)[:, :near]
        links[:, near:] = random.integers(0, n, (n, 4))
        return Graph(centroids, links, np.unique(np.linspace(0, n - 1, min(n, KEPT)).astype(np.int64)))

    def walk(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids found of each query, nearest first: (places, distances); where fewer than KEPT are known, -1 and infinity."""
        n = len(queries)
        kept = min(KEPT, len(self.centroids))
        place = np.full((n, kept), -1, np.int64)
        far = np.full((n, kept), np.inf)
        place[:, : len(self.starts)] = self.starts[:kept]
        far[:, : len(self.starts)] = ((queries[:, None] - self.centroids[self.starts[:kept]][None]) ** 2).sum(2)
        seen = np.zeros((n, kept), bool)
        rows = np.arange(n)
        while len(rows):
            d = np.where(seen[rows] | (place[rows] < 0), np.inf, far[rows])
            best = d.argmin(1)
            open_ = np.isfinite(d[np.arange(len(rows)), best])
            # A walk ends when the better half of what it keeps has been looked at.
            open_ &= (seen[rows] & (far[rows] <= d[np.arange(len(rows)), best][:, None])).sum(1) < max(8, kept // 2)
            rows, best = rows[open_], best[open_]
            if not len(rows):
                break
            seen[rows, best] = True
            new = self.links[place[rows, best]]
            dist = ((queries[rows][:, None] - self.centroids[new]) ** 2).sum(2)
            known = (new[:, :, None] == place[rows][:, None, :]).any(2)
            order = np.sort(new, 1)
            dist[known] = np.inf
            # The same centroid twice among the new ones counts once.
            if (order[:, 1:] == order[:, :-1]).any():
                for j in range(1, new.shape[1]):
                    dist[(new[:, :j] == new[:, j : j + 1]).any(1), j] = np.inf
            all_far = np.concatenate([far[rows], dist], 1)
            top = np.argsort(all_far, 1, kind="stable")[:, :kept]
            take = lambda a, b: np.take_along_axis(np.concatenate([a, b], 1), top, 1)
            place[rows] = np.where(np.isfinite(take(far[rows], dist)), take(place[rows], new), -1)
            seen[rows] = take(seen[rows], np.zeros_like(known))
            far[rows] = np.take_along_axis(all_far, top, 1)
        order = np.argsort(far, 1, kind="stable")
        return np.take_along_axis(place, order, 1), np.sqrt(np.take_along_axis(far, order, 1))

    def copies(self, points: np.ndarray) -> list[np.ndarray]:
        """The lists that each point belongs to: the nearest, and farther ones within COPY_RATIO that no chosen list covers."""
        places, far = self.walk(points)
        out = []
        for p, d in zip(places, far, strict=True):
            chosen = [p[0]]
            for c, x in zip(p[1 : 4 * COPIES], d[1 : 4 * COPIES], strict=True):
                if c < 0 or x > COPY_RATIO * d[0] or len(chosen) == COPIES:
                    break
                if all(((self.centroids[c] - self.centroids[o]) ** 2).sum() > x * x for o in chosen):
                    chosen.append(c)
            out.append(np.array(chosen))
        return out

    def around(self, query: np.ndarray, known: np.ndarray, far: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """From what a walk knows, the centroids within ratio times the nearest's distance, and those beside them, nearest first: the graph is followed from each of them until none that is so near is new."""
        seen = np.zeros(len(self.centroids), bool)
        seen[known] = True
        places, distances, front = [known], [far], known
        best = far.min()
        while len(front):
            new = np.unique(self.links[front])
            new = new[~seen[new]]
            seen[new] = True
            d = np.sqrt(((self.centroids[new] - query) ** 2).sum(1))
            best = min(best, d.min(initial=np.inf))
            places.append(new)
            distances.append(d)
            front = new[d <= ratio * best]
        p, d = np.concatenate(places), np.concatenate(distances)
        order = np.lexsort((p, d))
        return p[order], d[order]

    def probes(self, queries: np.ndarray, sizes: np.ndarray, later: bool = False) -> list[np.ndarray]:
        """The lists that each query reads first, or those that it reads later: together all within PROBE_RATIO that the graph leads to, and as many as hold ENOUGH vectors."""
        out = []
        walked = self.walk(queries)
        for query, known, far in zip(queries, *walked, strict=True):
            p, d = self.around(query, known[known >= 0], far[known >= 0], PROBE_RATIO)
            if sizes[p].sum() < ENOUGH:
                every = np.sqrt(((self.centroids - query) ** 2).sum(1))
                p = np.argsort(every, kind="stable")
                d = every[p]
            before = np.concatenate([[0], np.cumsum(sizes[p])[:-1]])
            near, first = d <= PROBE_RATIO * d[0], np.arange(len(p)) < PROBES
            out.append(p[near & ~first & (before >= ENOUGH)] if later else p[near & first | (before < ENOUGH)])
        return out


def lists_for(count: int) -> int:
    """How many lists count vectors are put in: a power of two."""
    parts = 1
    while parts * max(LIST_SIZE, LIST_SIZE * parts // LISTS) < count:
        parts *= 2
    return parts


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors that are not null, hold only finite numbers and are not zero."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))


def nearest(df: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank int, vec_id, score): for each vector whose id is divisible by `every`, the k nearest found among all other vectors, by Euclidean distance in double precision, ties to the smaller id.

    Ids must be distinct. Vectors that are null, zero, or hold null or non-finite numbers take no part, nor do those that have not the most frequent length. With fewer than k other vectors, all are returned; an empty table gives an empty one. The centroids are fitted on a sample of SAMPLE vectors or four for each list, which goes to the driver (a billion vectors: 131,072 lists, 524,288 vectors); every vector is in a list.
    """
    found = written(usable(df, id_col, vector_col), "vectors")
    lengths = found.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    spark = df.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    found = found.where(F.size("v") == lengths[0]["d"])
    # Of equal vectors, the k + 1 smallest ids can be in an answer.
    numbered = found.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("place") <= k + 1)
    points = written(numbered.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.element_at("ids", 1).alias("point"), "v", "ids"), "points")
    count = points.count()
    parts = lists_for(count)
    share = min(1.0, max(SAMPLE, 4 * parts) / count)
    sample = points.where(F.expr(f"(xxhash64(point) & {(1 << 53) - 1}) <= {share * (1 << 53)!r}")).select("v").limit(2 * max(SAMPLE, 4 * parts)).toArrow()["v"].combine_chunks()
    sample = _matrix(sample)
    graph = Graph.of(halved(sample, parts))
    shared = spark.sparkContext.broadcast(graph)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                lists = shared.value.copies(_matrix(part.column(1)))
                index = pa.array(np.repeat(np.arange(len(part)), [len(x) for x in lists]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists)), *(c.take(index) for c in part.columns)], ["list", "point", "v", "ids"])

    value = points.schema["v"].dataType.simpleString()
    posted = written(points.mapInArrow(assign, f"list long, point long, v {value}, ids array<long>"), "lists")
    sizes = np.zeros(parts, np.int64)
    for r in posted.groupBy("list").agg(F.count("*").alias("n")).collect():
        sizes[r["list"]] = r["n"]
    blocks = np.maximum(1, -(-sizes // BLOCK))

    asked = found.where(F.col("id") % every == 0)
    queries = written(asked.groupBy("v").agg(F.min("id").alias("q")), "queries")

    def probe(later: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                rows, lists, block = [], [], []
                for row, chosen in enumerate(shared.value.probes(_matrix(part.column(0)), sizes, later)):
                    for c in chosen:
                        n = int(blocks[c])
                        rows += [row] * n
                        lists += [int(c)] * n
                        block += range(n)
                index = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int64()), pa.array(block, pa.int64()), *(part.column(c).take(index) for c in (1, 0, 2))], ["list", "block", "q", "v", "bound"])

    number = F.element_at(F.lit(blocks.tolist()).cast("array<long>"), (F.col("list") + 1).cast("int"))
    spread = posted.withColumn("block", F.pmod(F.xxhash64("point"), number))

    def compare(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})
        vectors = np.stack(right["v"].to_numpy()).astype(np.float64)
        counts = right["ids"].map(len).to_numpy()
        ids = np.concatenate(right["ids"].to_numpy())
        owner = np.repeat(np.arange(len(right)), counts)
        found = []
        for v, bound in zip(left["v"], left["bound"], strict=True):
            d = np.sqrt(((vectors - np.asarray(v, np.float64)) ** 2).sum(1))[owner]
            cut = min(bound, np.partition(d, k)[k]) if len(d) > 4 * (k + 1) else bound
            some = np.flatnonzero(d <= cut)
            some = some[np.lexsort((ids[some], d[some]))[: k + 1]]
            found.append((ids[some], d[some]))
        return pd.DataFrame({"q": np.repeat(left["q"].to_numpy(), [len(x) for x, _ in found]), "id": np.concatenate([x for x, _ in found]), "score": np.concatenate([d for _, d in found])})

    def read(bounded: DataFrame, later: bool) -> DataFrame:
        probes = bounded.select("v", "q", "bound").mapInArrow(lambda batches: probe(later, batches), f"list long, block long, q long, v {value}, bound double")
        return probes.groupBy("list", "block").cogroup(spread.groupBy("list", "block")).applyInPandas(compare, "q long, id long, score double")

    def top(near: DataFrame) -> DataFrame:
        near = near.groupBy("q", "id").agg(F.min("score").alias("score"))
        best = near.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("score", "id"))).where(F.col("place") <= k + 1)
        return written(best.select("q", "id", "score"), "best")

    best = top(read(queries.withColumn("bound", F.lit(float("inf"))), False))
    if parts > PROBES:
        # Of the later lists, only what is not farther than the last of what is found can be in an answer.
        bounds = best.groupBy("q").agg(F.when(F.count("*") > k, F.max("score")).otherwise(float("inf")).alias("bound"))
        best = top(best.unionByName(read(queries.join(bounds, "q"), True)))
    named = asked.join(queries, "v").select(F.col("id").alias("query_id"), "q")
    pairs = named.join(best, "q").where("query_id != id")
    order = Window.partitionBy("query_id").orderBy("score", "id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
