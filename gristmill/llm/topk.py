"""Exact top-k by inner product: columnar branch and bound over blocks of dimensions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Dimensions added at a time, queries scored together, and components (candidates times dimensions) that one task holds.
DIMS, QUERIES, CELLS = 16, 128, 6_400_000
MOST = (1 << 63) - 1


def quantised(vector: Column, scale: int = 256) -> Column:
    """Floor of ``scale`` times each component as double; null if the vector or a component is null or not finite."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    d = vector.cast("array<double>")
    return F.when(F.forall(d, good), F.transform(d, lambda x: F.when(F.abs(x * scale) < 1e15, F.floor(x * scale).cast("double")).otherwise(x * scale)))


def exact(q: np.ndarray, rows: np.ndarray) -> list[int]:
    """Inner products in unbounded integers, held within 64 bits."""
    left = [int(x) for x in q]
    return [max(-MOST - 1, min(MOST, sum(a * int(b) for a, b in zip(left, r)))) for r in rows]


def search_block(ids: np.ndarray, columns: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int):
    """For each query its ``k`` best candidates of a block: ``(query, id, score)`` lists.

    ``columns`` is vertical, a row a dimension.  Partial sums grow by ``DIMS`` dimensions; the mass
    that remains (product of the norms of what is left of query and candidate) bounds a
    candidate's score on both sides, and candidates that cannot reach the k-th lower
    bound are dropped, the rest compacted.
    """
    out_q, out_id, out_s = [], [], []
    dims, n = columns.shape
    peak = float(np.abs(q).max(initial=0)) * float(np.abs(columns).max(initial=0)) * max(1, dims)
    if peak >= 2**53:  # sums would not be exact in doubles
        for i, own in enumerate(q_ids.tolist()):
            scores = exact(q[i], columns.T)
            best = sorted((-s, x) for s, x in zip(scores, ids.tolist()) if x != own)[:k]
            for s, x in best:
                out_q.append(own), out_id.append(x), out_s.append(-s)
        return out_q, out_id, out_s
    # blocks of much mass first: bounds shrink sooner
    order = np.argsort(-(columns.astype(float) ** 2).sum(1), kind="stable")
    columns, q = columns[order], q[:, order]
    cuts = list(range(0, dims, DIMS)) + [dims]
    rest = np.zeros((len(cuts), n))
    q_rest = np.zeros((len(cuts), len(q)))
    for j in range(len(cuts) - 2, -1, -1):
        rest[j] = rest[j + 1] + (columns[cuts[j] : cuts[j + 1]] ** 2).sum(0)
        q_rest[j] = q_rest[j + 1] + (q[:, cuts[j] : cuts[j + 1]] ** 2).sum(1)
    rest, q_rest = np.sqrt(rest), np.sqrt(q_rest)
    for lo in range(0, len(q), QUERIES):
        block = q[lo : lo + QUERIES]
        partial = block[:, : cuts[1]] @ columns[: cuts[1]]
        for i in range(len(block)):
            own, score = int(q_ids[lo + i]), partial[i]
            alive = np.flatnonzero(ids != own)
            score = score[alive]
            for j in range(1, len(cuts)):
                if j > 1:
                    score = score + block[i, cuts[j - 1] : cuts[j]] @ columns[cuts[j - 1] : cuts[j], alive]
                if len(alive) > k:
                    slack = q_rest[j, lo + i] * rest[j, alive] * (1 + 1e-9) + 1e-6 * (j < len(cuts) - 1)
                    least = np.partition(score - slack, len(alive) - k)[len(alive) - k]
                    keep = score + slack >= least
                    alive, score = alive[keep], score[keep]
            best = np.lexsort((ids[alive], -score))[:k]
            out_q += [own] * len(best)
            out_id += ids[alive[best]].tolist()
            out_s += [int(x) for x in score[best]]
    return out_q, out_id, out_s


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` highest integer inner products of each query, ties to smaller ids.

    Queries are the rows whose id ``every`` divides; candidates all rows of another id and the
    same number of dimensions.  Vectors that are null or hold a null or non-finite component, and
    rows without an id, take no part; rows that repeat id and vector count once, and of
    several vectors under one id each counts, the best first.  Scores beyond 64 bits are held
    at its ends.  Candidates are dealt into groups of about ``CELLS`` components at most, queries go to each
    group, and a task holds one group in vertical layout while queries stream past it; of each
    group ``k`` rows a query are shuffled to be ranked.
    """
    spark = vectors.sparkSession
    src = vectors.select(vectors[id_col].cast("long").alias("id"), quantised(vectors[vector_col]).alias("q")).where("id is not null and q is not null").distinct()
    src = cut(src.withColumn("dims", F.size("q")))
    total, cells = src.agg(F.count("*"), F.sum("dims")).first()
    groups = max(-(-(cells or 0) // CELLS), min(4 * spark.sparkContext.defaultParallelism, -(-total // 512)), 1)
    place = F.pmod(F.xxhash64(F.lit(1), "id", "q"), F.lit(groups)).cast("int")
    candidates = src.select("dims", place.alias("part"), F.lit(0).alias("kind"), "id", "q")
    queries = src.where(F.col("id") % every == 0).select("dims", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), F.lit(1).alias("kind"), "id", "q")

    def run(batches):
        key, ids, held, ready = None, [], [], None
        for b in batches:
            keys = np.stack([b.column(i).to_numpy() for i in range(3)], 1)
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)]):
                if lo == hi:
                    continue
                dims, part, kind = keys[lo].tolist()
                if (dims, part) != key:
                    key, ids, held, ready = (dims, part), [], [], None
                some = b.column(3).slice(lo, hi - lo).to_numpy()
                flat = b.column(4).slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, dims)
                if kind == 0:
                    ids.append(some)
                    held.append(flat)
                elif ids:
                    if ready is None:
                        ready = np.concatenate(ids), np.ascontiguousarray(np.concatenate(held).T)
                    a, c, s = search_block(*ready, some, flat, k)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.int64())], ["query_id", "vec_id", "score"])

    dealt = candidates.unionByName(queries).repartition("dims", "part").sortWithinPartitions("dims", "part", "kind")
    found = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    # a candidate with several vectors, or a query with several, counts by its best score
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(id_col), "score")
