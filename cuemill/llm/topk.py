"""Exact top-k inner-product search by a three-phase uniform threshold.

The score of a vector is a sum over `lists` lists, one for each stretch of dimensions. Rows are packed where they lie into blocks of at
most `BLOCK` rows; a block holds, for each query, a local score list for each stretch.

1. Every block sorts its lists down to `DEPTH` entries, the heads, and adds up exactly the k best rows met there. The k-th best sum over
   all blocks is a safe cutoff of the query.
2. A score of at least the cutoff needs at least cutoff / lists, the uniform threshold, in some list. With the cutoff back at the blocks,
   the entries above that threshold are read from the kept heads, and a row's bound is what it is known for, plus the last head entry of
   each list that doesn't show it. Rows whose bound is below the cutoff are dropped. Heads that end above the threshold can lack entries;
   where the ends of a query's heads together reach the cutoff, a row outside of all could too, and the block makes its lists again.
3. Of the rows that remain, the missing list scores, and only these, are computed; the exact sums give the k best of the block.

Queries go to the blocks in rounds of at most `QUERIES` (checked), each sent once; rows are shuffled once at most, to meet their heads.
Integers are compared as integers, so results are exact for any 64-bit sums.

Defined results: vectors that are null, empty or hold null or non-finite components, and null ids, take no part; candidates have the
query's number of dimensions and another id; ties go to the smaller id; repeated candidate rows repeat; of rows that share a query
id the smallest vector is the query; columns other than id and vector are not read.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuemill.llm.common import bounded_batches, cut_lineage, read_table, released

#: Lists of a query, rows of a block, entries of a head, queries of a round, queries that a block works on at a time.
LISTS, BLOCK, DEPTH, QUERIES, STEP = 4, 2048, 128, 4096, 256


def usable(vector: str) -> Column:
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & ~bad


def quantised(vector: str, scale: float = 256.0) -> Column:
    return F.transform(vector, lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("long"))


def packed_blocks(rows: DataFrame, block: int) -> DataFrame:
    """name, d, ids and vectors of blocks of rows (vec_id, v) of equal dimension d, packed where the rows lie, in the order of ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, made, held = uuid.uuid4().hex, 0, {}

        def flush(d: int) -> pa.RecordBatch:
            nonlocal made
            parts = held.pop(d)
            ids, x = (np.concatenate([h[j] for h in parts]) for j in range(2))
            order = np.argsort(ids, kind="stable")
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([f"{home}.{made}"]), pa.array([d], pa.int32()), pa.array([ids[order].tobytes()], pa.binary()), pa.array([np.ascontiguousarray(x[order]).tobytes()], pa.binary())], names=["name", "d", "ids", "vectors"])

        for batch in batches:
            sizes, ids = batch.column("v").value_lengths().to_numpy(zero_copy_only=False), batch.column("vec_id").to_numpy(zero_copy_only=False)
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            at = np.cumsum(sizes) - sizes
            for d in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == d)
                for k in range(0, len(mine), block):
                    part = mine[k : k + block]
                    if sum(len(i) for i, _ in held.get(d, ())) + len(part) > block:
                        yield flush(d)
                    held.setdefault(d, []).append((ids[part].astype(np.int64), flat[at[part][:, None] + np.arange(d)]))
            while sum(len(i) for h in held.values() for i, _ in h) > 4 * block:
                yield flush(max(held, key=lambda d: sum(len(i) for i, _ in held[d])))
        for d in list(held):
            yield flush(d)

    return rows.mapInArrow(run, "name string, d int, ids binary, vectors binary")


def stretches(d: int, lists: int) -> list[slice]:
    return [slice(int(s[0]), int(s[-1]) + 1) for s in np.array_split(np.arange(d), min(lists, d))]


def score_lists(q: np.ndarray, x: np.ndarray, lists: int) -> list[np.ndarray]:
    """Exact list scores of all rows, as integers; by doubles while every sum stays within 53 bits."""
    if float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2**52:
        return [(q[:, s].astype(float) @ x[:, s].T.astype(float)).astype(np.int64) for s in stretches(q.shape[1], lists)]
    return [q[:, s] @ x[:, s].T for s in stretches(q.shape[1], lists)]


def heads_of(ids: np.ndarray, x: np.ndarray, own: np.ndarray, q: np.ndarray, k: int, lists: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phase 1: places and scores of the sorted heads (query, list, depth), and the k best sums of rows met there, padded with the least."""
    low = np.iinfo(np.int64).min
    h = min(max(depth, k + 1), len(ids))
    scored = score_lists(q, x, lists)
    place, score = (np.empty((len(q), len(scored), h), np.int64) for _ in range(2))
    met = np.zeros((len(q), len(ids)), bool)
    for j, p in enumerate(scored):
        top = np.argpartition(-p, h - 1, axis=1)[:, :h] if h < len(ids) else np.broadcast_to(np.arange(h), (len(q), h))
        value = np.take_along_axis(p, top, 1)
        order = np.argsort(-value, 1, kind="stable")
        place[:, j], score[:, j] = np.take_along_axis(top, order, 1), np.take_along_axis(value, order, 1)
        np.put_along_axis(met, place[:, j, : k + 1], True, axis=1)
    at, row = np.nonzero(met & (ids[None, :] != own[:, None]))
    best = np.full((len(q), k), low)
    total = sum(p[at, row] for p in scored)
    order = np.lexsort((-total, at))
    at, total = at[order], total[order]
    rank = np.arange(len(at)) - np.searchsorted(at, at)
    best[at[rank < k], rank[rank < k]] = total[rank < k]
    return place, score, best


def resolved(ids: np.ndarray, x: np.ndarray, own: np.ndarray, q: np.ndarray, place: np.ndarray, score: np.ndarray, cutoff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Phases 2 and 3: query (index), row and exact score of the k best of the block that reach the cutoff; and the list scores computed."""
    lists, h = place.shape[1:]
    threshold = cutoff // lists + (cutoff % lists > 0)
    unsure = (score[:, :, -1] >= threshold[:, None]).any(1) & (h < len(ids))  # entries above the threshold may be missing
    short = unsure & (score[:, :, -1].sum(1) >= cutoff)
    found: list[tuple[np.ndarray, ...]] = []
    work = 0
    if short.any():
        who = np.flatnonzero(short)
        scored = score_lists(q[who], x, lists)
        work += len(scored) * len(who) * len(ids)
        total = sum(scored)
        at, row = np.nonzero((total >= cutoff[who, None]) & (ids[None, :] != own[who, None]))
        found.append((who[at], row, total[at, row]))
    if not short.all():
        who = np.flatnonzero(~short)
        last = score[who][:, :, -1]
        bound = np.broadcast_to(last.sum(1)[:, None], (len(who), len(ids))).copy()
        each = np.arange(len(who))[:, None]
        for j in range(lists):
            bound[each, place[who, j]] += score[who, j] - last[:, j, None]
        at, row = np.nonzero((bound >= cutoff[who, None]) & (ids[None, :] != own[who, None]))
        total = np.zeros(len(at), np.int64)
        spot = np.full((len(who), len(ids)), -1, np.int16 if h < 1 << 15 else np.int32)
        for j, s in enumerate(stretches(q.shape[1], lists)):
            spot[:] = -1
            spot[each, place[who, j]] = np.arange(h)
            mine = spot[at, row]
            seen = mine >= 0
            total[seen] += score[who[at[seen]], j, mine[seen]]
            miss = np.flatnonzero(~seen)
            work += len(miss)
            for a in range(0, len(miss), 1 << 15):
                m = miss[a : a + (1 << 15)]
                total[m] += np.einsum("nd,nd->n", q[who[at[m]], s], x[row[m], s])
        good = total >= cutoff[who[at]]
        found.append((who[at[good]], row[good], total[good]))
    at, row, total = (np.concatenate([f[j] for f in found]) for j in range(3))
    order = np.lexsort((ids[row], -total, at))
    at, row, total = at[order], row[order], total[order]
    keep = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[keep], row[keep], total[keep], work


def _unpacked(ids: pa.Scalar, vectors: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids.as_buffer(), np.int64)
    return own, np.frombuffer(vectors.as_buffer(), np.int64).reshape(len(own), -1)


def _by_dimension(table: pa.Table, *more: str) -> dict[int, tuple[np.ndarray, ...]]:
    """Query ids, vectors and further columns of the queries of each dimension."""
    sizes = np.array([len(x) for x in table.column("q")])
    out = {}
    for d in np.unique(sizes).tolist():
        part = table.take(pa.array(np.flatnonzero(sizes == d)))
        flat = part.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        out[d] = (part.column("query_id").to_numpy(), flat.reshape(-1, d), *(part.column(c).to_numpy() for c in more))
    return out


def search(rows: DataFrame, queries: DataFrame, k: int, lists: int = LISTS, block: int = BLOCK, depth: int = DEPTH) -> DataFrame:
    """query_id, rank, vec_id, score of the k highest inner products of rows (vec_id, v) with queries (query_id, q); v, q: array<long>."""
    sc = rows.sparkSession.sparkContext
    bounded_batches(rows.sparkSession)
    queries = cut_lineage(queries.groupBy("query_id").agg(F.min("q").alias("q")))
    blocks = cut_lineage(packed_blocks(rows.select("vec_id", "v"), block))
    rounds = max(1, math.ceil(queries.count() / QUERIES))
    least = np.iinfo(np.int64).min
    out = None
    for r in range(rounds):
        mine = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == r).toArrow()  # some QUERIES rows
        sent = sc.broadcast(_by_dimension(mine))

        def heads(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, d, ids, vectors in zip(*(batch.column(c) for c in ("name", "d", "ids", "vectors"))):
                    if d.as_py() not in sent.value:
                        continue
                    own, q = sent.value[d.as_py()]
                    ids, x = _unpacked(ids, vectors)
                    found = [heads_of(ids, x, own[a : a + STEP], q[a : a + STEP], k, lists, depth) for a in range(0, len(q), STEP)]
                    place, score, best = (np.concatenate([f[j] for f in found]) for j in range(3))
                    small = np.abs(score).max() < 1 << 31
                    kept = pickle.dumps((place.astype(np.uint16 if len(ids) <= 1 << 16 else np.int64), score.astype(np.int32) if small else score))
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([kept], pa.binary()), pa.array([own.tobytes()], pa.binary()), pa.array([best.tobytes()], pa.binary())], names=["name", "heads", "own", "best"])

        def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for own, best in zip(batch.column("own"), batch.column("best")):
                    own = np.frombuffer(own.as_buffer(), np.int64)
                    best = np.frombuffer(best.as_buffer(), np.int64)
                    good = best > least
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, k)[good]), pa.array(best[good])], names=["query_id", "score"])

        lists_kept = cut_lineage(blocks.mapInArrow(released(heads), "name string, heads binary, own binary, best binary"))
        ranked = lists_kept.select("own", "best").mapInArrow(sums, "query_id long, score long").withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"))))
        cut = {x["query_id"]: x["score"] for x in ranked.filter(F.col("n") == k).select("query_id", "score").toLocalIterator()}  # one for each query of the round
        cutoffs = sc.broadcast(_by_dimension(mine.append_column("cutoff", pa.array([cut.get(i, least) for i in mine.column("query_id").to_pylist()], pa.int64())), "cutoff"))

        def resolve(batches: Iterable[pa.RecordBatch], cutoffs=cutoffs) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for d, ids, vectors, kept in zip(*(batch.column(c) for c in ("d", "ids", "vectors", "heads"))):
                    own, q, cutoff = cutoffs.value[d.as_py()]
                    ids, x = _unpacked(ids, vectors)
                    place, score = pickle.loads(kept.as_buffer())
                    for a in range(0, len(q), STEP):
                        b = slice(a, a + STEP)
                        at, row, total, _ = resolved(ids, x, own[b], q[b], place[b].astype(np.int64), score[b].astype(np.int64), cutoff[b], k)
                        yield pa.RecordBatch.from_arrays([pa.array(own[b][at]), pa.array(ids[row]), pa.array(total)], names=["query_id", "vec_id", "score"])

        found = blocks.join(lists_kept.select("name", "heads"), "name").select("d", "ids", "vectors", "heads").mapInArrow(released(resolve), "query_id long, vec_id long, score long")
        out = found if out is None else out.unionByName(found)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").filter(usable("embedding") & F.col("vec_id").isNotNull()).select("vec_id", quantised("embedding").alias("v"))
    queries = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return search(rows, queries, 5)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n, vec_id, score FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""
