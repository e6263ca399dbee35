"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length: bands of a constant ratio, each dealt into blocks of bounded size by a hash, so a band
that holds most vectors is many blocks. A first pass compares every query with the block of the longest vectors and
keeps the k-th best product as the query's threshold. In the second pass a block is met only by those blocks of
queries of which one can still reach its threshold there. Inside, ``threshold / (|query| longest)`` is the cosine a
vector of the block needs (the local threshold):

* over 1: nothing in the block can do, the query skips it;
* small: length pruning, only vectors of at least ``threshold / |query|`` are multiplied;
* large: coordinate pruning, the products over the query's largest coordinates plus the Cauchy-Schwarz bound of the
  rest leave few vectors.

Survivors are verified by exact integer products. Queries in blocks meet candidates in blocks; a task holds one pair
of blocks at a time. The k best of every pair are merged by a ranked limit that Spark applies before its shuffle.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part, nor do rows
without an identifier. Only vectors of equal dimension are compared. Rows with the query's identifier count as the
query's own; other repeated rows are candidates each. Ties go to the smaller identifier. Products beyond 64 bits
are clipped to their range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.textbytes import small_batches
from riskspark.session import scratch_path

CANDIDATE_BLOCK = 2048
QUERY_BLOCK = 256
BANDS_PER_DOUBLING = 8
COORDINATES_FROM = 0.5  # local cosine threshold from which coordinates are pruned
FOCUS = 12  # coordinates a query looks at first
_EXACT = 2.0**52

_PACKED = "dim int, block long, n long, longest double, ids binary, norms binary, vectors binary"


def quantised(vector, scale: float = 256.0):
    """``floor(scale * x)`` of every component, with ``x`` as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)))


def usable(vector):
    """Whether every component is a finite number and there is one at least."""
    wrong = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(wrong, F.lit(True))


def _pack(table: pa.Table) -> pa.Table:
    """One row per block: identifiers, norms and components, longest first."""
    ids = table.column("id").to_numpy()
    dim, block = table.column("dim")[0].as_py(), table.column("block")[0].as_py()
    vectors = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
    norms = np.sqrt((vectors.astype(float) ** 2).sum(1))
    order = np.lexsort((ids, -norms))
    return pa.table(
        {
            "dim": pa.array([dim], pa.int32()), "block": pa.array([block], pa.int64()), "n": pa.array([len(ids)], pa.int64()),
            "longest": [float(norms[order[0]])], "ids": pa.array([ids[order].tobytes()], pa.binary()),
            "norms": pa.array([norms[order].tobytes()], pa.binary()), "vectors": pa.array([vectors[order].tobytes()], pa.binary()),
        }
    )


def _packed(vectors: DataFrame, band, size: int) -> DataFrame:
    """Blocks of about ``size`` vectors of one dimension and band; the block's number is unique with the dimension."""
    placed = vectors.withColumn("band", band)
    share = placed.groupBy("dim", "band").agg(F.ceil(F.count("*") / size).alias("parts"))
    placed = placed.join(share, ["dim", "band"])
    number = F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts"))
    placed = placed.select("dim", (F.col("band").cast("long") * (1 << 40) + number).alias("block"), "id", "vector")
    path = scratch_path(vectors.sparkSession, "vector-blocks")
    placed.groupBy("dim", "block").applyInArrow(_pack, _PACKED).write.parquet(path)
    return vectors.sparkSession.read.schema(_PACKED).parquet(path)


def _open(row: dict, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dim = row["dim"]
    ids, norms = np.frombuffer(row[f"{side}_ids"], np.int64), np.frombuffer(row[f"{side}_norms"], np.float64)
    return ids, norms, np.frombuffer(row[f"{side}_vectors"], np.int64).reshape(len(ids), dim)


def products(left: np.ndarray, right: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products; floating point is exact while all partial sums stay below 2^52."""
    if bound < _EXACT:
        return (left.astype(float) @ right.astype(float).T).astype(np.int64)
    wide = left.astype(object) @ right.astype(object).T
    return np.clip(wide, -(2**63), 2**63 - 1).astype(np.int64)


def _best(query: int, scores: np.ndarray, ids: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The k best of at least ``least``, without the query's own identifier."""
    at = np.flatnonzero((scores >= least) & (ids != query))
    if len(at) > 4 * k:
        at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
    order = at[np.lexsort((ids[at], -scores[at]))][:k]
    return ids[order], scores[order]


def _thresholds(rows: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Per query the k-th best product with the longest vectors; ``need`` is the least length of any use to the block."""
    for batch in rows:
        out = []
        for row in batch.to_pylist():
            ids, norms, vectors = _open(row, "q")
            other, lengths, against = _open(row, "c")
            scores = products(vectors, against, float(norms.max() * lengths.max()))
            least = np.full(len(ids), -np.inf)
            for i, query in enumerate(ids):
                found = _best(int(query), scores[i], other, k, -np.inf)[1]
                if len(found) == k:
                    least[i] = found[-1]
            need = float(np.min(np.where(least > 0, least / np.maximum(norms, 1e-300), 0.0)))
            out.append((row["dim"], row["q_block"], need * (1 - 1e-9), least.tobytes()))
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.binary())],
            names=["dim", "q_block", "need", "least"],
        )


def search_block(
    queries: tuple[np.ndarray, np.ndarray, np.ndarray], block: tuple[np.ndarray, np.ndarray, np.ndarray], least: np.ndarray, k: int
) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The k best of the block for every query that can reach its threshold there: ``(query, ids, scores)``."""
    q_ids, q_norms, q = queries
    ids, norms, vectors = block
    bound = float(q_norms.max() * norms[0])
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(least > 0, least / (q_norms * norms[0]), 0.0)
        shortest = np.where(least > 0, least / q_norms * (1 - 1e-9), 0.0)
    # norms descend, so what is long enough is a prefix
    prefix = np.searchsorted(-norms, -shortest, side="right")
    prefix[~(local <= 1 + 1e-9)] = 0
    by_length = np.flatnonzero((prefix > 0) & (local < COORDINATES_FROM))
    by_coordinate = np.flatnonzero((prefix > 0) & (local >= COORDINATES_FROM))
    found = []
    if len(by_length):
        scores = products(q[by_length], vectors[: prefix[by_length].max()], bound)
        for row, i in zip(scores, by_length, strict=True):
            found.append((int(q_ids[i]), *_best(int(q_ids[i]), row[: prefix[i]], ids[: prefix[i]], k, least[i])))
    if len(by_coordinate):
        columns = np.ascontiguousarray(vectors.T).astype(float)
    for i in by_coordinate:
        focus = np.argsort(-np.abs(q[i]))[:FOCUS]
        near = columns[focus, : prefix[i]]
        weight = q[i][focus].astype(float)
        partial = weight @ near
        rest_q = np.sqrt(max(q_norms[i] ** 2 - (weight**2).sum(), 0.0))
        rest_c = np.sqrt(np.maximum(norms[: prefix[i]] ** 2 - (near**2).sum(0), 0.0))
        slack = 1e-6 * (1 + q_norms[i] * norms[0])
        left = np.flatnonzero(partial + rest_q * rest_c + slack >= least[i])
        scores = products(q[i : i + 1], vectors[left], bound)[0]
        found.append((int(q_ids[i]), *_best(int(q_ids[i]), scores, ids[left], k, least[i])))
    return [f for f in found if len(f[1])]


def _search(rows: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            found = search_block(_open(row, "q"), _open(row, "c"), np.frombuffer(row["least"], np.float64), k)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]), pa.int64()),
                        pa.array(np.concatenate([f[1] for f in found]), pa.int64()),
                        pa.array(np.concatenate([f[2] for f in found]), pa.int64()),
                    ],
                    names=["query_id", "vec_id", "score"],
                )


def top_products(
    vectors: DataFrame, queries, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0,
    block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for every row of ``vectors`` where the Column ``queries`` holds, the ``k`` rows
    of other identifiers with the largest inner products of the scaled and floored vectors."""
    clean = vectors.where(usable(vectors[vector_col]) & vectors[id_col].isNotNull()).select(
        vectors[id_col].cast("long").alias("id"), quantised(vectors[vector_col], scale).alias("vector"), queries.alias("asks")
    )
    clean = clean.withColumn("dim", F.size("vector"))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    band = F.coalesce(F.floor(F.log2(F.when(square > 0, square)) / 2 * BANDS_PER_DOUBLING), F.lit(-(1 << 20)))
    candidates = _packed(clean, band, block)
    asked = _packed(clean.where(F.coalesce("asks", F.lit(False))), F.lit(0), query_block)

    def side(frame: DataFrame, letter: str) -> DataFrame:
        names = ("block", "ids", "norms", "vectors")
        return frame.select("dim", "longest", *[F.col(c).alias(f"{letter}_{c}") for c in names])

    q, c = side(asked, "q").drop("longest"), side(candidates, "c")
    # one block per dimension: that of the longest vectors
    probes = candidates.groupBy("dim").agg(F.max_by("block", "longest").alias("c_block")).join(c, ["dim", "c_block"])
    probed = small_batches(q.join(probes, "dim")).mapInArrow(
        lambda rows: _thresholds(rows, k), "dim int, q_block long, need double, least binary"
    )
    path = scratch_path(vectors.sparkSession, "thresholds")
    probed.write.parquet(path)
    known = vectors.sparkSession.read.schema(probed.schema).parquet(path)

    # Pairs of block numbers, by equality on a bucket of candidate blocks: each block of queries visits all buckets.
    buckets = max(candidates.count(), 1)
    places = candidates.select("dim", F.col("block").alias("c_block"), "longest", F.pmod(F.xxhash64("dim", "block"), F.lit(buckets)).alias("bucket"))
    visits = known.select("dim", "q_block", "need", F.explode(F.expr(f"sequence(0L, {buckets - 1}L)")).alias("bucket"))
    pairs = visits.join(places, ["dim", "bucket"]).where("longest >= need").select("dim", "q_block", "c_block")
    pairs = pairs.join(q, ["dim", "q_block"]).join(known.drop("need"), ["dim", "q_block"]).join(c, ["dim", "c_block"])
    hits = small_batches(pairs.drop("longest")).mapInArrow(lambda rows: _search(rows, k), "query_id long, vec_id long, score long")
    ranked = hits.selectExpr("*", "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank")
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
