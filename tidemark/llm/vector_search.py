"""Operator 2. Maximum inner product search with score-aware quantisation.

Vectors are scaled to unit length, so the largest inner product is the largest cosine. A codebook of
16 centres for every pair of dimensions is fitted to the score-aware loss: the part of a residual
along its vector costs ``eta`` times as much as the part across, because it is what shifts high
scores. Every vector is encoded by coordinate descent on that loss, four bits a subspace, two codes
a byte. A query is a table of its inner products with all centres; scanning adds up table entries.
The best ``rerank`` of each block of candidates are scored again exactly, in double precision, on
the original vectors, and then all whose table score plus the norm of their residual, which no exact
score exceeds, reaches the k-th exact score. So the neighbours are the exact ones.

The index is fitted on at most ``FIT_ROWS`` vectors (by hash of the id); every row is encoded and
searched. Queries and candidates meet in a grid of bounded blocks: every block of queries against
every block of candidates.

Vectors that are null, empty, zero, of another dimension than most, or with null or non-finite
components take no part, nor do rows with a null id. Ties go to the smaller vec_id. Rows with the
same id as a query are not its candidates; rows repeating an id are candidates once each but a
neighbour only once, with the nearest of their vectors. With fewer than ``k`` candidates all are returned. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm._common import Steps

FIT_ROWS = 20_000
CENTRES = 16
SUBSPACE = 2
#: Inner products from this cosine on are what the index must rank well.
THRESHOLD = 0.2
ITERATIONS = 8
SWEEPS = 2
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 8192
RERANK = 64
#: Further candidates are scored so many at a time.
MORE = 1024
#: For rounding in the table scores.
SLACK = 1e-4


def eta(dimension: int, threshold: float = THRESHOLD) -> float:
    """Weight of the parallel against the orthogonal residual error, for unit vectors."""
    return max(1.0, (dimension - 1) * threshold**2 / (1 - threshold**2))


class Quantiser:
    """Codebooks (subspace, centre, SUBSPACE) and the weight of the parallel error."""

    def __init__(self, books: np.ndarray, weight: float):
        self.books, self.weight = books, weight

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes (row, subspace) that minimise the score-aware loss, one subspace after the other."""
        n, m = len(x), len(self.books)
        parts = x.reshape(n, m, -1)
        distance = ((parts[:, :, None, :] - self.books[None]) ** 2).sum(-1)  # squared error of each centre
        along = np.einsum("nms,mcs->nmc", parts, self.books)  # its share of <x, centre>
        codes = distance.argmin(-1)
        rows = np.arange(n)
        total = along[rows[:, None], np.arange(m)[None], codes].sum(1)
        for _ in range(SWEEPS):
            for j in range(m):
                rest = total - along[rows, j, codes[:, j]]
                parallel = 1 - (rest[:, None] + along[:, j])  # residual along the unit vector x
                codes[:, j] = (distance[:, j] + (self.weight - 1) * parallel**2).argmin(1)
                total = rest + along[rows, j, codes[:, j]]
        return codes

    def pack(self, codes: np.ndarray) -> np.ndarray:
        if codes.shape[1] % 2:
            codes = np.hstack([codes, np.zeros((len(codes), 1), codes.dtype)])
        return (codes[:, 0::2] | codes[:, 1::2] << 4).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(query, byte, 256): what each packed byte adds to the query's score."""
        each = np.einsum("qms,mcs->qmc", queries.reshape(len(queries), len(self.books), -1), self.books).astype(np.float32)
        if each.shape[1] % 2:
            each = np.concatenate([each, np.zeros((len(each), 1, CENTRES), np.float32)], 1)
        return (each[:, 1::2, :, None] + each[:, 0::2, None, :]).reshape(len(queries), -1, CENTRES * CENTRES)


def fit(x: np.ndarray, threshold: float = THRESHOLD) -> Quantiser:
    """Alternates score-aware encoding and weighted centre updates, on unit vectors x."""
    n, d = x.shape
    m = d // SUBSPACE
    weight = eta(d, threshold)
    parts = x.reshape(n, m, SUBSPACE)
    rng = np.random.default_rng(7)
    books = np.stack([parts[rng.choice(n, CENTRES, replace=n < CENTRES), j] for j in range(m)]).astype(np.float64)
    quantiser = Quantiser(books, weight)
    for round_ in range(ITERATIONS):
        if round_ < ITERATIONS - 2:  # plain least squares first: a good start
            codes = ((parts[:, :, None, :] - quantiser.books[None]) ** 2).sum(-1).argmin(-1)
            for j in range(m):
                for c in range(CENTRES):
                    if (own := codes[:, j] == c).any():
                        quantiser.books[j, c] = parts[own, j].mean(0)
            continue
        codes = quantiser.encode(x)
        chosen = quantiser.books[np.arange(m)[None], codes]
        total = (chosen * parts).sum((1, 2))
        for j in range(m):
            rest = total - (chosen[:, j] * parts[:, j]).sum(1)
            for c in range(CENTRES):
                own = codes[:, j] == c
                if own.any():  # (n I + (w-1) sum x x') b = sum x (1 + (w-1)(1 - rest))
                    p, r = parts[own, j], rest[own]
                    left = own.sum() * np.eye(SUBSPACE) + (weight - 1) * p.T @ p
                    quantiser.books[j, c] = np.linalg.solve(left, (p * (1 + (weight - 1) * (1 - r))[:, None]).sum(0))
    return quantiser


def usable(vectors: DataFrame, id_: str, embedding: str) -> DataFrame:
    """(id, v, dim) of the vectors that take part."""
    v = F.col(embedding)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col(id_).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    return rows.select(F.col(id_).cast("long").alias("id"), v.cast("array<double>").alias("v"), F.size(v).alias("dim"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return np.asarray(flat).reshape(len(column), -1)


def search(vectors: DataFrame, queries, k: int = 5, rerank: int = RERANK, id_: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that the condition ``queries`` (on id) selects, the k nearest others."""
    schema = "query_id long, vec_id long, score double"
    rows = usable(vectors, id_, embedding)
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    spark = vectors.sparkSession
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = sizes[0]["dim"], sizes[0]["n"]
    rows = rows.filter(F.col("dim") == dim)
    even = -(-dim // SUBSPACE) * SUBSPACE

    def unit(x: np.ndarray) -> np.ndarray:
        x = x / np.abs(x).max(1, keepdims=True)  # huge components must not overflow
        x = x / np.sqrt((x * x).sum(1, keepdims=True))
        return np.hstack([x, np.zeros((len(x), even - dim))]) if even > dim else x

    share = min(1.0, FIT_ROWS / n)
    sample = rows.filter(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").limit(2 * FIT_ROWS).toArrow()["v"]
    if not len(sample):
        sample = rows.select("v").limit(FIT_ROWS).toArrow()["v"]
    quantiser = fit(unit(_matrix(sample)))

    n_queries = rows.filter(queries).count()
    q_blocks, c_blocks = max(1, -(-n_queries // QUERY_BLOCK)), max(1, -(-n // CANDIDATE_BLOCK))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                units = unit(_matrix(part.column("v")))
                codes = quantiser.encode(units)
                chosen = quantiser.books[np.arange(codes.shape[1])[None], codes].reshape(len(codes), -1)
                packed = pa.array([row.tobytes() for row in quantiser.pack(codes)], pa.binary())
                residual = pa.array(np.sqrt(((units - chosen) ** 2).sum(1)))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), packed, residual], ["id", "v", "codes", "residual"])

    # every row is encoded once, whatever the number of query blocks it will meet
    index = Steps(spark, "vector-index").write(rows.select("id", "v").mapInArrow(encode, "id long, v array<double>, codes binary, residual double"), "index")

    def block(salt: str, blocks: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(blocks)).cast("int")

    q = rows.filter(queries).select("id", "v", block("q", q_blocks).alias("qb")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))
    c = index.withColumn("cb", block("c", c_blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not len(left) or not len(right):
            return none
        order = np.argsort(right["id"].to_numpy(), kind="stable")
        ids, x = right["id"].to_numpy()[order], _matrix(right["v"])[order]
        own, y = left["id"].to_numpy(), _matrix(left["v"])
        codes = np.frombuffer(b"".join(right["codes"].to_pylist()), np.uint8).reshape(len(x), -1)[order].T.copy()
        residual = right["residual"].to_numpy()[order]
        norms = np.sqrt((x * x).sum(1))

        def nearest(some: np.ndarray, query: np.ndarray, others: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Ids and exact scores of the k nearest of some candidates and others."""
            exact = np.concatenate([(x[some] * query).sum(1) / (norms[some] * np.sqrt((query * query).sum())), scores])
            names = np.concatenate([ids[some], others])
            keep = np.lexsort((names, -exact))
            _, once = np.unique(names[keep], return_index=True)
            keep = keep[np.sort(once)][:k]
            return names[keep], exact[keep]

        out: list[tuple] = []
        for a in range(0, len(y), 64):
            tables = quantiser.tables(unit(y[a : a + 64]))
            for table, query, me in zip(tables, y[a : a + 64], own[a : a + 64], strict=True):
                score = np.zeros(len(x), np.float32)
                for byte, code in enumerate(codes):
                    score += table[byte][code]
                score[ids == me] = -np.inf
                top = min(rerank, len(x))
                floor = np.partition(score, len(x) - top)[len(x) - top]
                best = np.flatnonzero(score > floor)
                ties = np.flatnonzero(score == floor)
                best = np.concatenate([best, ties[: top - len(best) if floor > -np.inf else 0]])  # ids ascend: ties to the least
                top_ids, exact = nearest(best, query, np.zeros(0, np.int64), np.zeros(0))
                upper = score + residual + SLACK
                upper[best] = -np.inf
                more = np.flatnonzero(upper >= (exact[k - 1] if len(exact) >= k else np.finfo(np.float64).min))
                more = more[np.argsort(-upper[more], kind="stable")]
                for at in range(0, len(more), MORE):
                    some = more[at : at + MORE]
                    if len(exact) >= k and upper[some[0]] < exact[k - 1]:
                        break
                    top_ids, exact = nearest(some, query, top_ids, exact)
                out.append((np.full(len(top_ids), me), top_ids, exact))
        return pa.table({name: pa.array(np.concatenate(col)) for name, col in zip(none.column_names, zip(*out, strict=True), strict=True)})

    found = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInArrow(cell, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # an id that repeats with other vectors counts with its nearest
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)
