"""Approximate nearest neighbours with balanced posting lists.

Centroids are fitted on a bounded sample by repeated balanced bisection and a few rounds of refinement. Every row goes to the list of its
nearest centroid, and boundary rows also to other lists within a distance ratio, unless a closer accepted centroid makes that list
redundant. Centroids are searched in memory, through a neighbourhood graph where few lists are wanted. A query opens the lists within
a distance ratio of the nearest, and as many further ones as its k neighbours need. How many, and the ratio, are calibrated: rows of the
sample ask for their neighbours in the sample, and nearly all of these have to stand in a list that is opened. Neighbours in the sample
are farther than those in the table, so the table's recall is not below. Lists are split into bounded shards by a hash of
the id, so a hot vector makes more shards, not a larger task; a shard hands on k entries for each query.

Bounds: `SAMPLE` rows for fitting, as expected, `CENTROIDS` centroids (sent to the workers in the task closure: 4096 x 64 doubles are 2 MB), `REPLICAS`
lists for a row. Every row is indexed in its nearest list.

Defined results: vectors that are null, zero, empty or hold null or non-finite components, vectors whose size differs from the most
usual one, and null ids take no part; ties go to the smaller id; of rows that share a query id the smallest vector is the query;
repeated rows count once.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuemill.llm.common import bounded_batches, cut_lineage, read_table, released
from cuemill.llm.topk import usable

SAMPLE, CENTROIDS, REPLICAS, SHARD = 20_000, 4096, 8, 2048
#: Rows to a list, ratio of distances for boundary rows; for a query's lists the least that calibration gives: ratio, lists opened by it.
LIST_ROWS, ROW_RATIO, QUERY_RATIO, QUERY_LISTS = 96, 1.15, 1.5, 48
#: Rows that calibrate, and the share of their neighbours that has to be in reach by number and by ratio.
PROBES, REACHED = 256, 0.985


def balanced_centroids(x: np.ndarray, n: int, seed: int = 6) -> np.ndarray:
    """n centroids: the largest part is bisected at the median along the axis between two of its means; then refinement."""
    rng = np.random.default_rng(seed)
    parts = [np.arange(len(x))]
    while len(parts) < n:
        parts.sort(key=len)
        part = parts.pop()
        if len(part) < 2:
            parts.append(part)
            break
        y = x[part]
        a, b = y[rng.choice(len(y), 2, replace=False)]
        for _ in range(4):
            near = ((y - a) ** 2).sum(1) < ((y - b) ** 2).sum(1)
            if near.all() or not near.any():
                break
            a, b = y[near].mean(0), y[~near].mean(0)
        order = np.argsort(y @ (b - a), kind="stable")
        parts += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
    c = np.stack([x[p].mean(0) for p in parts])
    for _ in range(3):
        near = np.concatenate([np.argmin(((c**2).sum(1)[None] - 2 * x[i : i + 1024] @ c.T), 1) for i in range(0, len(x), 1024)])
        size = np.bincount(near, minlength=len(c))
        for j in np.flatnonzero(size):
            c[j] = x[near == j].mean(0)
    return np.unique(c, axis=0)


def neighbour_graph(c: np.ndarray, degree: int = 16) -> np.ndarray:
    """Each centroid's nearest ones, thinned so that no kept neighbour hides behind a nearer one, and a few far links."""
    n = len(c)
    far = max(1, degree // 4)
    out = np.zeros((n, degree), np.int32)
    rng = np.random.default_rng(1)
    d = ((c[:, None] - c[None]) ** 2).sum(2) if n <= 512 else None
    for i in range(n):
        row = d[i] if d is not None else ((c - c[i]) ** 2).sum(1)
        near = np.argsort(row, kind="stable")[1 : 3 * degree + 1]
        kept: list[int] = []
        for j in near:
            if len(kept) == degree - far:
                break
            if all(((c[j] - c[m]) ** 2).sum() > row[j] for m in kept):
                kept.append(int(j))
        kept += [int(j) for j in near if j not in kept][: degree - far - len(kept)]
        kept += rng.integers(0, n, degree - len(kept)).tolist()
        out[i] = kept
    return out


class CentroidGraph:
    def __init__(self, c: np.ndarray):
        self.c, self.links = c, neighbour_graph(c)
        self.norm = (c**2).sum(1)
        self.entries = np.unique(np.linspace(0, len(c) - 1, min(len(c), 16)).astype(int))

    def nearest(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search for all rows of x at once: ids and distances of the `beam` nearest centroids met, nearest first."""
        n, beam = len(x), min(beam, len(self.c))
        ids, dist = np.zeros((n, beam), np.int64), np.zeros((n, beam))
        for at in range(0, n, 1024):
            ids[at : at + 1024], dist[at : at + 1024] = self._search(x[at : at + 1024], beam)
        return ids, np.sqrt(np.maximum(dist, 0))

    def ordered(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The same from all distances, for beams that are a large part of the centroids."""
        found = []
        for at in range(0, len(x), 1024):
            y = x[at : at + 1024]
            d = (y**2).sum(1)[:, None] + self.norm - 2 * y @ self.c.T
            ids = np.argsort(d, 1, kind="stable")[:, :beam]
            found.append((ids, np.sqrt(np.maximum(np.take_along_axis(d, ids, 1), 0))))
        return np.concatenate([i for i, _ in found]), np.concatenate([d for _, d in found])

    def calibrated(self, x: np.ndarray, k: int) -> tuple[float, int]:
        """The ratio and the number of lists by which queries like the rows of the sample x reach their k neighbours."""
        x = x[np.sort(np.unique(x, axis=0, return_index=True)[1])]  # copies would be near neighbours of their own
        probes = np.random.default_rng(7).choice(len(x), min(PROBES, len(x)), replace=False)
        k = min(k, len(x) - 1)
        if k < 1:
            return QUERY_RATIO, QUERY_LISTS
        d = (x**2).sum(1) - 2 * x[probes] @ x.T
        d[np.arange(len(probes)), probes] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        lists, dist = self.ordered(x[probes], len(self.c))
        rank = np.argsort(lists, 1)  # of each list, for each probe
        row, held, _ = self.lists_of_rows(x[near.ravel()], ROW_RATIO, REPLICAS)
        first = np.full(near.size, len(self.c))
        np.minimum.at(first, row, rank[row // k, held])
        ratio = dist[np.arange(near.size) // k, first] / np.maximum(dist[np.arange(near.size) // k, 0], 1e-12)
        return max(QUERY_RATIO, float(np.quantile(ratio, REACHED, method="higher"))), max(QUERY_LISTS, int(np.quantile(first, REACHED, method="higher")) + 1)

    def _search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n, size, each = len(x), len(self.c), np.arange(len(x))[:, None]
        xx = (x**2).sum(1)[:, None]
        seen = np.zeros((n, size), bool)
        seen[:, self.entries] = True
        pool = np.broadcast_to(self.entries, (n, len(self.entries))).copy()
        dist = xx + self.norm[self.entries] - 2 * x @ self.c[self.entries].T
        opened = np.zeros((n, size), bool)
        while True:
            order = np.argsort(dist, 1, kind="stable")[:, :beam]
            pool, dist = pool[each, order], dist[each, order]
            fresh = ~opened[each, pool] & np.isfinite(dist)
            rows = np.flatnonzero(fresh.any(1))
            if not len(rows):
                break
            pick = np.argsort(~fresh[rows], 1, kind="stable")[:, :4]  # the nearest few that are not opened yet
            nodes = pool[rows[:, None], pick]
            opened[rows[:, None], nodes] = True
            new = self.links[nodes].reshape(len(rows), -1).astype(np.int64)
            new.sort(1)
            old = seen[rows[:, None], new]
            old[:, 1:] |= new[:, 1:] == new[:, :-1]
            seen[rows[:, None], new] = True
            d = xx[rows] + self.norm[new] - 2 * np.einsum("nd,nmd->nm", x[rows], self.c[new])
            d[old] = np.inf
            more = np.full((n, new.shape[1]), np.inf)
            more[rows] = d
            named = np.zeros((n, new.shape[1]), np.int64)
            named[rows] = new
            pool, dist = np.concatenate([pool, named], 1), np.concatenate([dist, more], 1)
        if pool.shape[1] < beam:
            pool = np.concatenate([pool, np.zeros((n, beam - pool.shape[1]), np.int64)], 1)
            dist = np.concatenate([dist, np.full((n, beam - dist.shape[1]), np.inf)], 1)
        return pool, dist

    def lists_of_rows(self, x: np.ndarray, ratio: float, replicas: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, list and whether it is the row's nearest list."""
        ids, dist = self.nearest(x, 2 * replicas)
        take = np.zeros(ids.shape, bool)
        take[:, 0] = True
        for j in range(1, ids.shape[1]):
            ok = np.isfinite(dist[:, j]) & (dist[:, j] <= ratio * dist[:, 0]) & (take.sum(1) < replicas)
            for i in range(j):
                gap = np.sqrt(((self.c[ids[:, j]] - self.c[ids[:, i]]) ** 2).sum(1))
                ok &= ~take[:, i] | (gap > 0.5 * dist[:, j])
            take[:, j] = ok
        row, place = np.nonzero(take)
        return row, ids[row, place], place == 0

    def lists_of_queries(self, x: np.ndarray, sizes: np.ndarray, need: int, ratio: float, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Row and list: within the ratio, `most` of them, and further ones until their own rows make up `need`."""
        beam = min(len(self.c), 2 * most)
        ids, dist = self.nearest(x, beam) if 8 * beam < len(self.c) else self.ordered(x, beam)
        held = np.cumsum(np.where(np.isfinite(dist), sizes[ids], 0), 1)
        wanted = np.isfinite(dist) & ((dist <= ratio * dist[:, :1]) & (np.arange(ids.shape[1]) < most) | (held - sizes[ids] < need))
        short = np.flatnonzero(held[:, -1] < need)
        row, place = np.nonzero(wanted)
        extra = [(np.full(len(self.c), r), np.arange(len(self.c))) for r in short]  # too few rows on the way: open all lists
        keep = ~np.isin(row, short)
        return np.concatenate([row[keep], *(a for a, _ in extra)]), np.concatenate([ids[row, place][keep], *(b for _, b in extra)])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def fit(rows: DataFrame, n_rows: int, k: int, sample: int = SAMPLE) -> tuple[CentroidGraph, float, int]:
    """The centroids, and the calibrated ratio and number of lists of a query."""
    share = min(1.0, sample / max(1, n_rows))  # by a threshold of hashes: no task sorts or gathers more than the sample
    part = rows.filter(F.pmod(F.xxhash64("vec_id", "v", F.lit(6)), F.lit(1 << 53)) < F.lit(int(share * (1 << 53)) + (share == 1)))
    found = part.select("vec_id", "v").distinct().toArrow().sort_by("vec_id")
    x = found.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(found.num_rows, -1)
    graph = CentroidGraph(balanced_centroids(x, max(1, min(CENTROIDS, n_rows // LIST_ROWS, len(x) // 4))))
    return graph, *graph.calibrated(x, k)


def search(rows: DataFrame, queries: DataFrame, k: int, sample: int = SAMPLE, shard: int = SHARD, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of the k nearest found; rows (vec_id, v), queries (query_id, q): array<float>.

    exact: every query opens every list, so that no neighbour is missed.
    """
    schema = "query_id long, rank int, vec_id long, score double"
    bounded_batches(rows.sparkSession)
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return rows.sparkSession.createDataFrame([], schema)
    rows = rows.filter(F.size("v") == dims["d"])
    queries = queries.filter(F.size("q") == dims["d"]).groupBy("query_id").agg(F.min("q").alias("q"))
    fitted, ratio, most = fit(rows, dims["count"], k, sample)
    if exact:
        ratio, most = float("inf"), len(fitted.c)
    graph = rows.sparkSession.sparkContext.broadcast(fitted)

    def post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, lists, first = graph.value.lists_of_rows(_matrix(batch.column("v")), ROW_RATIO, REPLICAS)
                pick = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), pa.array(first), batch.column("vec_id").take(pick), batch.column("v").take(pick)], names=["list", "first", "vec_id", "v"])

    postings = cut_lineage(rows.select("vec_id", "v").mapInArrow(released(post), "list int, first boolean, vec_id long, v array<float>"))
    counts = postings.groupBy("list").agg(F.count("*").alias("n"), F.sum(F.col("first").cast("long")).alias("own")).collect()  # a row for each centroid
    own, shards = np.zeros(len(graph.value.c), np.int64), np.ones(len(graph.value.c), np.int64)
    for r in counts:
        own[r["list"]], shards[r["list"]] = r["own"], max(1, math.ceil(r["n"] / shard))

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, lists = graph.value.lists_of_queries(_matrix(batch.column("q")), own, 8 * (k + 1), ratio, most)
                pick = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), pa.array(shards[lists], pa.int32()), batch.column("query_id").take(pick), batch.column("q").take(pick)], names=["list", "shards", "query_id", "q"])

    opened = queries.mapInArrow(released(ask), "list int, shards int, query_id long, q array<float>").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    of = F.element_at(F.lit([int(s) for s in shards]), F.col("list") + 1)
    dealt = postings.withColumn("shard", F.pmod(F.xxhash64("vec_id"), of).cast("int"))

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list = [[], [], []]
        if left.num_rows and right.num_rows:
            order = np.argsort(left.column("vec_id").to_numpy(), kind="stable")
            ids, own_id = left.column("vec_id").to_numpy()[order], right.column("query_id").to_numpy()
            x, q = _matrix(left.column("v").combine_chunks())[order], _matrix(right.column("q").combine_chunks())
            cuts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            once = ids[cuts]
            at, place, score = [], [], []
            step = max(1, (1 << 22) // max(1, x.size))
            for s in range(0, len(q), step):
                d = np.sqrt(((q[s : s + step, None] - x[None]) ** 2).sum(2))
                d = np.minimum.reduceat(d, cuts, axis=1)  # rows of one id count once, before the cut to k
                d[once[None, :] == own_id[s : s + step, None]] = np.inf
                best = np.argsort(d, 1, kind="stable")[:, :k]  # rows stand by id, so ties keep the smaller one
                at.append(np.repeat(np.arange(s, s + len(d)), best.shape[1]))
                place.append(best.ravel())
                score.append(np.take_along_axis(d, best, 1).ravel())
            at, place, score = map(np.concatenate, (at, place, score))
            good = np.isfinite(score)
            found = [own_id[at[good]], once[place[good]], score[good]]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "vec_id", "score"), found, (pa.int64(), pa.int64(), pa.float64()))})

    near = dealt.select("list", "shard", "vec_id", "v").groupBy("list", "shard").cogroup(opened.select("list", "shard", "query_id", "q").groupBy("list", "shard")).applyInArrow(scan, "query_id long, vec_id long, score double")
    once = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    nonzero = F.exists("embedding", lambda v: v != 0)
    rows = read_table(spark, sf_dir, "embeddings").filter(usable("embedding") & nonzero & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").alias("v"))
    queries = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return search(rows, queries, 10)
