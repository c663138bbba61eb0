"""Exact top-k inner products by block-at-a-time pruning.

Vectors become integers and are laid in blocks, each a range of ids with a forward
index (its ids and their components) and, for every component, the block's largest
and smallest value.  A block's bound for a query is the sum over components of the
best product those extremes allow.  Queries and blocks meet in cells of bounded
size; in a cell every query takes its blocks in the order of their bounds and scores
through the forward index until the next bound falls below its k-th score.  The
cells' best are then ranked together.

Defined results: vectors that are null, empty, or hold null or non-finite
components take no part, nor do rows without an id; of rows with one id the smallest
vector counts; vectors of different lengths are never compared; with fewer than k
candidates all are returned; ties go to the smaller id; no queries, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

BLOCK = 1024
CELL_BLOCKS = 32
CELL_QUERIES = 4096


def quantised(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """``vec_id, dim, v``: components as floor(scale * x), one row per usable id."""
    e = F.col("embedding").cast("array<double>")
    sound = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & sound)
    v = F.transform(e, lambda x: F.floor(x * F.lit(scale)).cast("long"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))
    return rows.select("vec_id", F.size("v").alias("dim"), "v")


def _packed(rows: DataFrame, most: int) -> DataFrame:
    """Rows in order of id, ``most`` together: ``dim, lo_id, ids, matrix`` as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, list, list] = (-1, [], [])

        def out():
            dim, ids, vs = held
            i, m = np.concatenate(ids), np.concatenate(vs)
            for at in range(0, len(i), most):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim], pa.int32()), pa.array([int(i[at])]), pa.array([i[at : at + most].tobytes()], pa.binary()), pa.array([m[at : at + most].tobytes()], pa.binary())],
                    names=["dim", "lo_id", "ids", "matrix"],
                )

        for batch in batches:
            ids, dims = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "dim"))
            offsets = batch.column("v").offsets.to_numpy() - batch.column("v").offsets[0].as_py()
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            for at in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(dims)) + 1):
                if not len(at):
                    continue
                dim = int(dims[at[0]])
                if held[0] != dim or sum(map(len, held[1])) >= most:
                    if held[1]:
                        yield from out()
                    held = (dim, [], [])
                held[1].append(ids[at].astype(np.int64))
                held[2].append(flat[offsets[at[0]] : offsets[at[-1] + 1]].reshape(-1, dim).astype(np.int64))
        if held[1]:
            yield from out()

    laid = rows.repartitionByRange("dim", "vec_id").sortWithinPartitions("dim", "vec_id")
    return laid.mapInArrow(run, "dim int, lo_id long, ids binary, matrix binary")


def _best(k: int):
    def cell(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        """Each query's k best among the cell's blocks."""
        dim = queries.column("dim")[0].as_py()
        qi = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in queries.column("ids")])
        q = np.concatenate([np.frombuffer(x.as_py(), np.int64).reshape(-1, dim) for x in queries.column("matrix")])
        ids = [np.frombuffer(x.as_py(), np.int64) for x in blocks.column("ids")]
        index = [np.frombuffer(x.as_py(), np.int64).reshape(-1, dim) for x in blocks.column("matrix")]
        top = max([int(np.abs(q).max(initial=0)), *(int(np.abs(m).max(initial=0)) for m in index)])
        exact = np.float64 if dim * top * top < 2**52 else np.int64  # whole numbers either way
        q = q.astype(exact)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        bounds = np.stack([up @ m.max(axis=0).astype(exact) + down @ m.min(axis=0).astype(exact) for m in index], axis=1)
        order = np.argsort(-bounds, axis=1, kind="stable")
        low = -(1 << 62)  # below any score, and its negative is a long too
        score, who = np.full((len(qi), k), low), np.full((len(qi), k), np.iinfo(np.int64).max)
        index = [m.astype(exact) for m in index]
        for turn in range(len(index)):
            nth = order[:, turn]
            live = np.flatnonzero((bounds[np.arange(len(qi)), nth] >= score[:, -1]) | (score[:, -1] == low))
            if not len(live):
                break
            for b in np.unique(nth[live]):
                rows = live[nth[live] == b]
                got = (q[rows] @ index[b].T).astype(np.int64)
                own = qi[rows, None] == ids[b][None, :]
                got[own] = low
                first = np.argsort(-got, axis=1, kind="stable")[:, :k]  # ids rise within a block
                s = np.concatenate([score[rows], np.take_along_axis(got, first, 1)], axis=1)
                w = np.concatenate([who[rows], np.where(np.take_along_axis(own, first, 1), np.iinfo(np.int64).max, ids[b][first])], axis=1)
                keep = np.lexsort((w, -s), axis=1)[:, :k]
                score[rows], who[rows] = np.take_along_axis(s, keep, 1), np.take_along_axis(w, keep, 1)
        r, c = np.nonzero(score != low)
        return pa.table({"query_id": qi[r], "vec_id": who[r, c], "score": score[r, c]})

    return cell


def search(queries: DataFrame, vectors: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best among all other vectors.

    Both inputs are ``vec_id, dim, v`` as ``quantised`` gives them.
    """
    blocks = settled(_packed(vectors, block), "blocks")
    asks = settled(_packed(queries, CELL_QUERIES), "queries")

    def numbered(df: DataFrame, per: int, name: str) -> DataFrame:
        """``per`` rows of one length together, by their place in the order of ids."""
        nth: Column = F.row_number().over(Window.partitionBy("dim").orderBy("lo_id"))
        at = df.select("dim", "lo_id", F.floor((nth - 1) / per).cast("int").alias(name))
        return df.join(at, ["dim", "lo_id"])

    asks, blocks = numbered(asks, 1, "row"), numbered(blocks, CELL_BLOCKS, "cell")
    rows = asks.groupBy("dim").agg((F.max("row") + 1).alias("rows"))
    cells = blocks.groupBy("dim").agg((F.max("cell") + 1).alias("cells"))
    asks = asks.join(cells, "dim").withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    blocks = blocks.join(rows, "dim").withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
    keys = ["dim", "row", "cell"]
    best = _best(k)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        return best(left, right)

    met = asks.select(*keys, "ids", "matrix").groupBy(*keys).cogroup(blocks.select(*keys, "ids", "matrix").groupBy(*keys))
    found = met.applyInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op4_exact_top_k(spark, sf_dir):
    """Every fiftieth vector as a query against all others: the five best by inner product."""
    vectors = settled(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")), "quantised")
    return search(vectors.where("vec_id % 50 = 0"), vectors)


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(256.0e0 * CAST(x AS DOUBLE)) AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
