"""Mixing sources to target weights by cube-method balanced sampling.

A source's target over its size is its rate r, from 0 to 2. Each document is
taken floor(r) times and once more with probability r - floor(r). Which documents
get the extra copy is decided by the cube method: inclusion probabilities move
through the null space of the balancing constraints (documents and tokens of the
source) until each is 0 or 1, so that both totals stay on target. The flight runs
in blocks of bounded size, dealt by a hash of the document; the two or so
documents that a block leaves fractional go on to the next level, until one block
of a source is left, whose last few are landed by trying every rounding.

Defined cases: null text has size 0; a null source is a source of its own, last
in order; sources without words have target 0 and nothing of them is taken.
Repeated rows are sampled one by one; only rows alike in id and text share a
hash, and so a block. Equal hashes are ordered by doc_id and size. An empty table gives no rows. Reruns agree: blocks, order and random draws
depend on the seed and the documents alone.
"""

from __future__ import annotations

import itertools
import math
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel
from .shared import cut, free_names

BLOCK = 4096
MAX_SOURCES = 100_000


def word_counts(docs: DataFrame, separators: bytes = kernel.BLANKS, text: str = "text", seed: int = 7) -> DataFrame:
    """doc_id, source, size, h: words of the whole text, counted on Arrow buffers, and a hash of id and text."""
    is_word, _ = kernel.class_table(separators)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.zeros(batch.num_rows, np.int64)
            for at, data, offsets in kernel.chunks(batch.column("text")):
                _, _, rows = kernel.word_bounds(data, offsets, is_word)
                sizes[at : at + len(offsets) - 1] = kernel.row_counts(rows, len(offsets) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(sizes), batch.column("h")], ["doc_id", "source", "size", "h"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col(text).alias("text"), F.xxhash64(F.col("doc_id").cast("long"), F.col(text), F.lit(seed)).alias("h"))
    return picked.mapInArrow(count, "doc_id long, source string, size long, h long")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, cap: float = 2.0) -> dict[str | None, float]:
    """Words to take of each source: weights repeat over the sources by code point, null last; excess above the cap is reshared."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = budget * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
        left = max(0.0, left)
    return out


def flight(sizes: list[float], probs: list[float], draw: random.Random) -> list[float]:
    """Moves probabilities to 0 or 1 with the sums of p and of p * size kept; at most two stay fractional."""
    out, eps = list(probs), 1e-9
    held: list[int] = []
    waiting = iter([i for i, p in enumerate(out) if eps < p < 1 - eps])
    while True:
        while len(held) < 3:
            if (i := next(waiting, None)) is None:
                break
            held.append(i)
        way = _direction([sizes[i] for i in held])
        if way is None:
            return out
        most = least = math.inf
        for i, v in zip(held, way, strict=True):
            if v > 0:
                most, least = min(most, (1 - out[i]) / v), min(least, out[i] / v)
            elif v < 0:
                most, least = min(most, -out[i] / v), min(least, (out[i] - 1) / v)
        go = most if draw.random() * (most + least) < least else -least
        for i, v in zip(held, way, strict=True):
            p = out[i] + go * v
            out[i] = 0.0 if p < eps else 1.0 if p > 1 - eps else p
        held = [i for i in held if 0 < out[i] < 1]


def _direction(s: list[float]) -> list[float] | None:
    """A vector in the null space of the rows (1, ...) and (sizes)."""
    if len(s) == 3:
        way = [s[1] - s[2], s[2] - s[0], s[0] - s[1]]
        top = max(map(abs, way))
        return [v / top for v in way] if top else [1.0, -1.0, 0.0]
    if len(s) == 2 and s[0] == s[1]:
        return [1.0, -1.0]
    return None


def land(sizes: list[float], probs: list[float], draw: random.Random) -> list[float]:
    """Rounds the last few by the choice nearest to their expected words, then documents."""
    open_ = [i for i, p in enumerate(probs) if 0 < p < 1]
    words, count = sum(probs[i] * sizes[i] for i in open_), sum(probs[i] for i in open_)
    best = min(
        itertools.product((0.0, 1.0), repeat=len(open_)),
        key=lambda x: (abs(sum(a * sizes[i] for a, i in zip(x, open_, strict=True)) - words), abs(sum(x) - count), draw.random()),
    )
    out = list(probs)
    for i, a in zip(open_, best, strict=True):
        out[i] = a
    return out


FLOWN = "doc_id long, source string, size long, h long, p double"


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, cap: float = 2.0, seed: int = 7, text: str = "text") -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken for every row of docs."""
    spark = docs.sparkSession
    rows = cut(word_counts(docs, text=text, seed=seed), "mix-sizes")
    per = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).limit(MAX_SOURCES + 1).collect()
    if len(per) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: mix by a coarser column")
    sizes = {r["source"]: int(r["words"] or 0) for r in per}
    goal = targets(sizes, weights, budget, cap)
    rate = {s: goal[s] / sizes[s] if sizes[s] else 0.0 for s in sizes}
    docs_of = {r["source"]: r["docs"] for r in per}
    schema = T.StructType([T.StructField("s", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("base", T.LongType()), T.StructField("frac", T.DoubleType()), T.StructField("blocks", T.LongType())])

    def blocks(n: dict) -> list[tuple]:
        return [(s, sizes[s], goal[s], math.floor(rate[s] + 1e-12), max(0.0, rate[s] - math.floor(rate[s] + 1e-12)), max(1, -(-n[s] // BLOCK))) for s in sizes]

    def fly(last: bool):
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["h", "doc_id", "size"], kind="stable", na_position="first", ignore_index=True)
            draw = random.Random(zlib.crc32(f"{seed}|{key[0]}|{key[1]}|{key[2]}".encode()))
            s, p = pdf["size"].astype(float).tolist(), pdf["p"].tolist()
            p = flight(s, p, draw)
            pdf["p"] = land(s, p, draw) if last else p
            return pdf[["doc_id", "source", "size", "h", "p"]]

        return run

    table = lambda n: F.broadcast(spark.createDataFrame(blocks(n), schema))  # noqa: E731  MAX_SOURCES rows at most
    left, level, done = None, 0, []
    counts = dict(docs_of)
    current = rows.join(table(counts), F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "h", F.col("frac").alias("p"), "blocks")
    while True:
        n_blocks = {s: max(1, -(-counts[s] // BLOCK)) for s in counts}
        if left is not None:
            current = left.join(table(counts), F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "h", "p", "blocks")
        last = max(n_blocks.values(), default=1) == 1
        flown = cut(
            current.withColumn("lv", F.lit(level)).withColumn("blk", F.pmod(F.xxhash64("h", "lv"), F.col("blocks")))
            .groupBy("source", "lv", "blk").applyInPandas(fly(last), FLOWN),
            "mix-flight",
        )
        if last:
            done.append(flown)
            break
        done.append(flown.where("p = 0 or p = 1"))
        left = flown.where("p > 0 and p < 1")
        counts = {s: 0 for s in counts} | {r["source"]: r["n"] for r in left.groupBy("source").agg(F.count("*").alias("n")).collect()}
        level += 1
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole.join(table(docs_of), F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "size", "source", "source_size", "target",
        (F.col("base") + F.round("p").cast("long")).alias("copies"),
        ((F.col("base") + F.round("p").cast("long")) * F.col("size")).alias("taken"),
    )


def take(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them. Rows that repeat a document share its copies."""
    cols = docs.columns
    key, of, copies, rows, n = free_names(docs, "__id", "__source", "__copies", "__rows", "__n")
    share = mixed.groupBy(F.col("doc_id").alias(key), F.col("source").alias(of)).agg(F.sum("copies").alias(copies), F.count("*").alias(rows)).where(F.col(copies) > 0)
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & F.col("source").eqNullSafe(F.col(of))
    once = docs.join(share.where(F.col(rows) == 1).hint("shuffle_hash"), on).select(*cols, copies)
    again = docs.join(share.where(F.col(rows) > 1), on)
    order = Window.partitionBy(key, of).orderBy(*[F.col(c) for c in cols])
    own = F.expr(f"{copies} div {rows} + if({n} <= {copies} % {rows}, 1, 0)")
    again = again.withColumn(n, F.row_number().over(order)).select(*cols, own.alias(copies))
    return once.unionByName(again).where(F.col(copies) > 0).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*cols)
