"""Nearest neighbours by score-aware anisotropic quantisation, four-bit table scans and exact reranking.

Vectors are scaled to length 1 and cut into pairs of dimensions with 16 codewords
each. Codewords and assignments minimise a residual error whose part parallel to
the vector counts `eta` times, since that part is what changes a high inner
product; both are fitted by coordinate descent on a bounded sample (`sample`
vectors with the smallest hashes). Every vector is encoded and stored in the
index, at four bits a pair. A search adds up table entries over the codes of a
block, two codes to a byte, and scores the best `rerank` vectors of each block
again on the original vectors in double precision.

Equal vectors are one index entry, with the k + 1 smallest of their ids: no more
can be among k neighbours, so nothing is lost and a very common vector costs no
more than a rare one. Vectors and queries are dealt to tasks in blocks.

Defined cases: vectors that are null, zero, or hold null or non-finite components
take no part, nor do those whose length is not the most frequent one of the
sample; rows without an id neither. A query never finds its own id. Ties go to
the smaller id. Fewer candidates than k give fewer rows; an empty table gives
none. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

SAMPLE, CODES, BLOCK, QUERIES, RERANK = 8192, 16, 8192, 4096, 128
THRESHOLD = 0.2


def eta_of(dimension: int, threshold: float = THRESHOLD) -> float:
    """Weight of the parallel residual for unit vectors when inner products above the threshold matter."""
    return max(1.0, (dimension - 1) * threshold**2 / (1 - threshold**2))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component to between 0.5 and 1: exact, and squares neither vanish nor overflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def pairs(x: np.ndarray) -> np.ndarray:
    """(n, pairs, 2) of unit vectors, padded to an even number of pairs."""
    x = scaled(x)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    pad = -x.shape[1] % 4
    return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, 2)


def assign(x: np.ndarray, books: np.ndarray, eta: float, sweeps: int = 2) -> np.ndarray:
    """Codes (n, pairs) by coordinate descent on |r|^2 + (eta - 1) <r, x>^2."""
    n, m, _ = x.shape
    codes = np.zeros((n, m), np.uint8)
    own = (x * x).sum(2)
    error = np.empty((m, n, len(books[0])))
    along = np.empty_like(error)
    for j in range(m):
        dot = x[:, j] @ books[j].T
        along[j] = own[:, j, None] - dot
        error[j] = own[:, j, None] - 2 * dot + (books[j] ** 2).sum(1)[None, :]
        codes[:, j] = error[j].argmin(1)
    rows = np.arange(n)
    total = sum(along[j, rows, codes[:, j]] for j in range(m))
    for _ in range(sweeps):
        for j in range(m):
            rest = total - along[j, rows, codes[:, j]]
            codes[:, j] = (error[j] + (eta - 1) * (rest[:, None] + along[j]) ** 2).argmin(1)
            total = rest + along[j, rows, codes[:, j]]
    return codes


def train(x: np.ndarray, eta: float, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Codebooks (pairs, 16, 2) of the sample: assignments, then codewords from their normal equations."""
    rng = np.random.default_rng(seed)
    n, m, _ = x.shape
    books = np.stack([x[rng.choice(n, CODES, replace=n < CODES), j] for j in range(m)])
    for t in range(rounds):
        weight = 1.0 if t < 3 else eta
        codes = assign(x, books, weight, sweeps=1)
        chosen = np.stack([books[j][codes[:, j]] for j in range(m)], 1)
        along = ((x - chosen) * x).sum(2)
        total = along.sum(1)
        own = (x * x).sum(2)
        for j in range(m):
            a = total - along[:, j] + own[:, j]
            outer = np.eye(2) + (weight - 1) * x[:, j, :, None] * x[:, j, None, :]
            right = x[:, j] * (1 + (weight - 1) * a)[:, None]
            for c in range(CODES):
                mine = codes[:, j] == c
                if mine.any():
                    books[j, c] = np.linalg.solve(outer[mine].sum(0) + 1e-9 * np.eye(2), right[mine].sum(0))
                else:
                    books[j, c] = x[rng.integers(n), j]
    return books


def pack(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes to a byte."""
    return codes[:, 0::2] | codes[:, 1::2] << 4


def scan(packed: np.ndarray, books: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Approximate inner products (queries, rows) from tables of 256 entries for each pair of codes."""
    q = pairs(queries)
    tables = np.einsum("qjd,jcd->qjc", q, books).astype(np.float32)
    both = tables[:, 1::2, :, None] + tables[:, 0::2, None, :]
    both = both.reshape(len(q), both.shape[1], CODES * CODES)
    out = np.zeros((len(q), len(packed)), np.float32)
    for j in range(packed.shape[1]):
        out += both[:, j].take(packed[:, j], axis=1)
    return out


def usable(vectors: DataFrame, vector_id: str, vector: str) -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part, but for their length."""
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    return vectors.select(F.col(vector_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("vec_id is not null and v is not null").where(fine)


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def build(entries: DataFrame, books: np.ndarray, eta: float, dimension: int, blocks: int) -> DataFrame:
    """The index: ids, v, codes (binary) and block of every entry, in the shared folder."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                codes = pack(assign(pairs(_matrix(part.column("v"), dimension)), books, eta))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.tobytes() for c in codes], pa.binary())], [*part.schema.names, "codes"])

    spread = entries.select("ids", "v", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(blocks)).alias("block"))
    return cut(spread.mapInArrow(run, "ids array<long>, v array<double>, block long, codes binary"), "ann-index")


_FOUND = pa.schema([("query_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])


def _search(books: np.ndarray, dimension: int, k: int, rerank: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return _FOUND.empty_table()
        v, q = scaled(_matrix(rows.column("v"), dimension)), scaled(_matrix(queries.column("v"), dimension))
        packed = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(v), -1)
        ids, asked = rows.column("ids").to_pylist(), queries.column("query_id").to_numpy()
        norm = np.sqrt((v * v).sum(1))
        out: tuple[list, list, list] = ([], [], [])
        top = min(rerank, len(v))
        for a in range(0, len(q), 256):
            near = scan(packed, books, q[a : a + 256])
            best = np.argpartition(-near, top - 1, axis=1)[:, :top]
            for i, some in enumerate(best):
                x = q[a + i]
                exact = (v[some] * x).sum(1) / (norm[some] * np.sqrt((x * x).sum()))
                me = int(asked[a + i])
                other = [next((d for d in ids[s] if d != me), None) for s in some]
                order = sorted((-e, o, s) for e, o, s in zip(exact.tolist(), other, some.tolist(), strict=True) if o is not None)[:k]
                out[0].extend([me] * len(order))
                out[1].extend(ids[s] for _, _, s in order)
                out[2].extend(-e for e, _, _ in order)
        return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(out, _FOUND, strict=True)], schema=_FOUND)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, sample: int = SAMPLE, rerank: int = RERANK, vector_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of `vectors` by cosine for each of `queries` (the same columns)."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors, vector_id, vector)
    drawn = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    if not drawn:
        return spark.createDataFrame([], schema)
    sizes = Counter(len(r["v"]) for r in drawn)
    dimension = max(sizes, key=lambda d: (sizes[d], d))
    eta = eta_of(dimension)
    books = train(pairs(np.array([r["v"] for r in drawn if len(r["v"]) == dimension])), eta)
    rows = rows.where(F.size("v") == dimension)
    order = Window.partitionBy("v").orderBy("vec_id")
    entries = (
        rows.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
        .groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    )
    asked = usable(queries, vector_id, vector).where(F.size("v") == dimension).select(F.col("vec_id").alias("query_id"), "v").distinct()
    blocks, parts = max(1, -(-rows.count() // BLOCK)), max(1, -(-asked.count() // QUERIES))
    index = build(entries, books, eta, dimension, blocks)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = index.withColumn("part", each(parts))
    right = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts))).withColumn("block", each(blocks))
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(_search(books, dimension, k, rerank), "query_id long, ids array<long>, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
