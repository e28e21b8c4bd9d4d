"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Each vector is rotated by one random orthogonal matrix and kept as the sign bits of
the rotated unit vector, with two scalars: its norm and the inner product of the unit
vector with its own code (the correction). A rotated query becomes whole numbers of four
bits, so ``<o, q>`` is estimated by counting common bits of packed words and applying the correction. The
estimate has an error bound: a random part that shrinks with the square root of the dimension,
and what rounding the query may change. Within a block of vectors a query reranks exactly, in double
precision, every vector whose estimate plus bound reaches the 20th exact score known.

Queries meet all vectors in cells of a grid, one block of vectors with one block of
queries. Both blocks have a bounded number of rows, so a cell is bounded too; vectors
travel once per block of queries and queries once per block of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packsift.llm.tables import pick

VECTOR_BLOCK = 8192
QUERY_BLOCK = 1024
#: Bits of a query's component.
QUERY_BITS = 4
#: Half-widths of the error bound in standard deviations of the estimate.
BOUND = 3.0
SEED = 20
ROTATE_ROWS = 1024


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same in every task for one seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def valid_vectors(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """Rows ``(id, v, dim)`` that take part.

    Left out: a null id, a null or zero vector, one with a null or non-finite
    component. Of several rows with one id the smallest vector in array order counts.
    """
    rows = pick(vectors, id=id_column, v=vector_column).select("id", "v")
    usable = (
        F.col("id").isNotNull()
        & F.col("v").isNotNull()
        & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))
        & F.exists("v", lambda x: x != 0)
    )
    rows = rows.where(F.coalesce(usable, F.lit(False)))
    return rows.groupBy("id").agg(F.min("v").alias("v")).select("id", "v", F.size("v").alias("dim"))


def _code(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, norms and corrections of the rows of ``x``."""
    norm = np.linalg.norm(x, axis=1)
    # the norm of tiny or huge components may leave the range of a double
    scale = np.abs(x).max(axis=1)
    norm = np.where((norm > 0) & np.isfinite(norm), norm, scale * np.linalg.norm(x / scale[:, None], axis=1))
    o = (x / scale[:, None]) @ turn.T
    o /= np.linalg.norm(o, axis=1)[:, None]
    return np.packbits(o >= 0, axis=1), norm, np.abs(o).sum(axis=1) / np.sqrt(x.shape[1])


def one_bit_index(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``(id, v, dim, code, norm, fix)`` for every vector that takes part: packed sign bits,
    norm, and the correction ``<o, code>`` of the rotated unit vector."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROTATE_ROWS):
                part = batch.slice(at, ROTATE_ROWS)
                sizes = part.column(2).to_numpy()
                for dim in np.unique(sizes).tolist():
                    same = part.filter(pa.array(sizes == dim))
                    x = same.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                    if dim not in turns:
                        turns[dim] = rotation(dim)
                    codes, norm, fix = _code(x, turns[dim])
                    yield pa.RecordBatch.from_arrays(
                        [*same.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm), pa.array(fix)],
                        names=["id", "v", "dim", "code", "norm", "fix"],
                    )

    rows = valid_vectors(vectors, id_column, vector_column)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(encode, f"{kinds}, code binary, norm double, fix double")


def words_of(packed: np.ndarray) -> np.ndarray:
    """Rows of packed bits as rows of 64-bit words."""
    wide = np.zeros((len(packed), -(-packed.shape[1] // 8) * 8), np.uint8)
    wide[:, : packed.shape[1]] = packed
    return wide.view(np.uint64)


class QueryCode:
    """A rotated unit query in whole numbers of few bits, one plane of packed bits for each
    bit, so an inner product with a code is a few counts of common bits."""

    def __init__(self, unit: np.ndarray):
        dim = len(unit)
        self.low, high = float(unit.min()), float(unit.max())
        self.step = (high - self.low) / ((1 << QUERY_BITS) - 1) or 1.0
        number = np.clip(np.rint((unit - self.low) / self.step), 0, (1 << QUERY_BITS) - 1).astype(np.uint8)
        self.planes = [words_of(np.packbits((number >> j & 1)[None, :], axis=1))[0] for j in range(QUERY_BITS)]
        self.total, self.root = int(number.sum()), float(np.sqrt(dim))
        #: What rounding may change in the inner product with any code.
        self.rounding = float(np.abs(unit - (self.low + self.step * number)).sum()) / self.root

    def products(self, codes: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """Inner products with the unit vectors that the codes stand for; ``ones`` are the
        numbers of their set bits."""
        common = np.zeros(len(codes), np.int64)
        for j, plane in enumerate(self.planes):
            common += np.bitwise_count(codes & plane).sum(axis=1, dtype=np.int64) << j
        return (2 * (self.step * common + self.low * ones) - self.step * self.total) / self.root - self.low * self.root


def _search_cell(k: int):
    def search(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(vectors) and len(queries):
            vectors = vectors.sort_values("id")
            ids, x = vectors["id"].to_numpy(), np.stack(vectors["v"].to_numpy()).astype(np.float64)
            dim = x.shape[1]
            codes = words_of(np.frombuffer(b"".join(vectors["code"]), np.uint8).reshape(len(ids), -1))
            ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
            norm, fix = vectors["norm"].to_numpy(), vectors["fix"].to_numpy()
            scale = norm / fix
            spread = BOUND * scale * np.sqrt(np.maximum(1 - fix * fix, 0)) / np.sqrt(max(dim - 1, 1)) + 1e-6 * norm
            q = np.stack(queries["v"].to_numpy()).astype(np.float64)
            size = np.abs(q).max(axis=1)
            unit = (q / size[:, None]) @ rotation(dim).T
            length = np.linalg.norm(unit, axis=1)
            unit /= length[:, None]
            for row, query_id in enumerate(queries["id"].to_numpy()):
                code = QueryCode(unit[row])
                est = code.products(codes, ones) * scale  # of <o, q/|q|>, times |o|
                own = ids == query_id
                est[own] = -np.inf
                best = np.argpartition(-est, min(k, len(ids) - 1))[: k + 1] if len(ids) > k + 1 else np.arange(len(ids))
                exact = (x[best] * q[row]).sum(axis=1)
                exact[own[best]] = -np.inf
                level = -np.inf
                if len(best) >= k:
                    level = np.partition(exact, len(exact) - k)[len(exact) - k] / (length[row] * size[row])
                keep = np.flatnonzero((est + spread + code.rounding * scale >= level) & ~own)
                score = (x[keep] * q[row]).sum(axis=1)
                order = np.lexsort((ids[keep], -score))[:k]
                found += zip([query_id] * len(order), ids[keep][order], score[order], [len(keep)] * len(order), strict=True)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score", "reranked"])

    return search


def nearest(
    vectors: DataFrame,
    is_query,
    k: int = 20,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    vector_block: int = VECTOR_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """The ``k`` vectors of largest inner product for each query, the query's own row
    left out: ``(query_id, rank, vec_id, score)``.

    ``is_query`` takes the id column and says which rows are queries. Ties go to the
    smaller id. Scores are sums of products of the original components in double
    precision. Vectors of different lengths have no inner product, so a query meets those of
    its own length. See ``valid_vectors`` for the rows that take no part; a query with
    fewer candidates than ``k`` gets all of them, an empty table gives no rows.
    """
    index = one_bit_index(vectors, id_column, vector_column)
    total = vectors.count()
    v_blocks, q_blocks = -(-max(total, 1) // vector_block), 1
    queries = valid_vectors(vectors, id_column, vector_column).where(is_query(F.col("id")))
    q_blocks = -(-max(queries.count(), 1) // query_block)
    kind = index.schema["id"].dataType.simpleString()
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.withColumn("vb", F.pmod(F.xxhash64("id"), F.lit(v_blocks)).cast("int")).withColumn("qb", every(q_blocks))
    right = queries.select(
        "id", "v", "dim", F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int").alias("qb"), every(v_blocks).alias("vb")
    )
    cells = (
        left.groupBy("dim", "vb", "qb")
        .cogroup(right.groupBy("dim", "vb", "qb"))
        .applyInPandas(_search_cell(k), f"query_id {kind}, vec_id {kind}, score double, reranked int")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
