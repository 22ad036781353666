"""MinHash near-dedup by a multi-index Hamming join.

A document's set is its distinct five-word shingles. Its signature is SYMBOLS
b-bit MinHash values. The signature is split into chunks; with at most
ERRORS = 2 * CHUNKS - 1 differing symbols in all, some chunk has at most one
(pigeonhole), so enumerating the allowed error of each chunk - one key for each
left-out symbol - guarantees that every pair within that signature distance
shares a key. Pairs that share a key are then held against the signature
distance FAR, against their sizes and against a second sketch (one byte for the
smallest hash of each of BINS ranges), and what is left is confirmed on full
sets. FAR is wider than ERRORS: pairs at the similarity threshold miss all keys,
lie beyond FAR, or fail the sketch with a chance of about 1e-6 each.

Equal sets are one node from the start. Only classes are asked for, so a pair
within one class needs no look. First each node is held against the leads of its
keys (of a key's nodes the one with the most company), which joins dense classes
without their pairs. Then the nodes of each key that are still in different
classes are joined by signature distance. A key of many nodes is cut into blocks
of bounded size, nodes of one large class into blocks of their own, and blocks of
the same class are never compared. A cell is two blocks of a key. Its pairs are
never written: a first pass over signatures names the nodes of each cell that
have a near partner there, their full sets are brought to the cell, and a second
pass confirms the pairs and returns a spanning forest of their links. So what is
written grows with the nodes of the keys, not with their pairs.

Defined cases: a document with fewer than five words is one shingle; without
words or text it has none and is linked with nothing. Documents with a null id
are linked with nothing: component_id is null and kept is true. Rows repeating a
doc_id are judged by their own text; copies share a component. An empty table
gives no rows. Ties go to the smaller doc_id. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .shared import components, cut, free_names, ranked, shuffled

WORDS, SIMILAR = 5, 75
CHUNKS, PER = 10, 4
SYMBOLS = CHUNKS * PER
ERRORS = 2 * CHUNKS - 1
#: Differing symbols up to which a pair that shares a key is confirmed.
FAR = 24
#: Ranges of the second sketch, and the chance that it drops a pair at the threshold.
BINS, MISS = 128, 1e-6
#: Nodes of a block of a hot key, on average at most, and of a part of a key in a join.
BLOCK = 512

_IS_WORD, _LOWERED = kernel.class_table(kernel.BLANKS)
_FACTORS = kernel.seeds(SYMBOLS, 3) | np.uint64(1)
_ONE, _TWO = kernel.seeds(2, 5)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, rows = kernel.word_bounds(data, offsets, _IS_WORD)
    return kernel.shingle_sets(kernel.word_hashes(data, starts, ends, _LOWERED), rows, len(offsets) - 1, k)


def set_hashes(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set that starts at `at`; none of them is empty."""
    return np.add.reduceat(kernel.mix(sets + _ONE), at), np.add.reduceat(kernel.mix(sets ^ _TWO), at)


def signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """CHUNKS 64-bit words for each set, each of PER 16-bit symbols."""
    out = np.zeros((len(at), CHUNKS), np.uint64)
    for j in range(SYMBOLS):
        symbol = kernel.mix(np.minimum.reduceat(sets * _FACTORS[j], at)) >> np.uint64(48)
        out[:, j // PER] |= symbol << np.uint64(16 * (j % PER))
    return out


def sketches(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(sets, BINS) bytes: of the smallest hash in each range, 0 for none. Sets are sorted, so these are the first of their runs."""
    row = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(sets))))
    slot = row * BINS + (sets >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
    out = np.zeros(len(at) * BINS, np.uint8)
    out[slot[first]] = kernel.mix(sets[first] + _TWO) % np.uint64(255) + np.uint64(1)
    return out.reshape(len(at), BINS)


def sketch_limits(similar: int) -> np.ndarray:
    """By the number of ranges in use: the differing bytes that a pair at the threshold exceeds with a chance of MISS at most."""
    p, out = 1 - similar / 100, [0]
    for m in range(1, BINS + 1):
        tail, q = 0.0, m
        while q > 0 and tail + math.comb(m, q) * p**q * (1 - p) ** (m - q) <= MISS:
            tail += math.comb(m, q) * p**q * (1 - p) ** (m - q)
            q -= 1
        out.append(q)
    return np.array(out)


SIGNED = "doc_id long, n_shingles long, h1 long, h2 long, signature array<long>, sketch binary"


def sign(docs: DataFrame, k: int = WORDS, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, a 128-bit hash of the set, its signature and its sketch (empty where there are no shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in kernel.chunks(batch.column("text")):
                n = len(offsets) - 1
                sets, bounds = shingles(data, offsets, k)
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                h = np.zeros((2, n), np.uint64)
                words, marks = np.zeros((0, CHUNKS), np.uint64), np.zeros((0, BINS), np.uint8)
                if len(full):
                    h[:, full] = set_hashes(sets, bounds[full])
                    words, marks = signatures(sets, bounds[full]), sketches(sets, bounds[full])
                ends = np.concatenate(([0], np.cumsum((sizes > 0) * CHUNKS))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(words.reshape(-1).view(np.int64)))
                ends = np.concatenate(([0], np.cumsum((sizes > 0) * BINS))).astype(np.int32)
                bins = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(marks.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, n), pa.array(sizes), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)), lists, bins],
                    ["doc_id", "n_shingles", "h1", "h2", "signature", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SIGNED)


def distinct_sets(signed: DataFrame) -> DataFrame:
    """h1, h2, set_id (the smallest doc_id), docs, n, signature, sketch: one node for each set."""
    first = [F.first("n_shingles").alias("n"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch")]
    return signed.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("set_id"), F.count("*").alias("docs"), *first).where("set_id is not null")


def chunk_keys(signature: Column) -> Column:
    """The keys of a signature: for each chunk, the other symbols for each left-out one."""
    keys = []
    for c in range(CHUNKS):
        word = signature[c]
        for o in range(PER):
            low = word.bitwiseAND((1 << 16 * o) - 1) if o else F.lit(0).cast("long")
            high = F.shiftleft(F.shiftrightunsigned(word, 16 * (o + 1)), 16 * o) if o < PER - 1 else F.lit(0).cast("long")
            keys.append(low.bitwiseOR(high).bitwiseOR(F.lit((c * PER + o) << 48).cast("long")))
    return F.array(*keys)


def distance(a: Column, b: Column) -> Column:
    """Differing symbols of two signatures (Spark columns)."""
    differ = F.transform(F.arrays_zip(a.alias("l"), b.alias("r")), lambda w: w["l"].bitwiseXOR(w["r"]))
    symbol = lambda x, o: F.when(F.shiftrightunsigned(x, 16 * o).bitwiseAND(F.lit(0xFFFF)) != 0, 1).otherwise(0)
    return F.aggregate(differ, F.lit(0), lambda n, x: n + symbol(x, 0) + symbol(x, 1) + symbol(x, 2) + symbol(x, 3))


def near(a: str, b: str, similar: int) -> Column:
    """Whether two nodes are close enough, by size and signature, to be confirmed on their sets."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    sized = (100 * n >= similar * m) & (100 * m >= similar * n)
    return sized & (distance(F.col(f"{a}.signature"), F.col(f"{b}.signature")) <= FAR)


def buckets(nodes: DataFrame) -> DataFrame:
    """key, set_id, size of every key that at least two nodes have."""
    keys = nodes.select("set_id", F.explode(chunk_keys(F.col("signature"))).alias("key"))
    return keys.join(shuffled(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")), "key").select("key", "set_id", "size")


def _part(block: int = BLOCK) -> Column:
    """The part of its key that a node is in: a key of many nodes has several, so no join meets all of them in one task."""
    return F.pmod(F.xxhash64("set_id"), F.ceil(F.col("size") / block).cast("long")).alias("part")


def _all_parts(block: int = BLOCK) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / block).cast("long") - 1)).alias("part")


def star_pairs(shared: DataFrame, nodes: DataFrame, similar: int) -> DataFrame:
    """(a, b): each node b with the leads a of its keys, if near. A lead has the largest company over all its keys; ties go to the smaller id."""
    company = shared.groupBy("set_id").agg(F.sum("size").alias("company"))
    # bitwise_not turns the order of ids without overflow
    top = F.max(F.struct("company", F.bitwise_not("set_id").alias("turned")))
    leads = shared.join(shuffled(company), "set_id").groupBy("key").agg(F.bitwise_not(top["turned"]).alias("a"), F.first("size").alias("size")).select("key", "a", _all_parts())
    stars = shared.select("key", "set_id", _part()).join(shuffled(leads), ["key", "part"]).where("a <> set_id").select("a", F.col("set_id").alias("b")).distinct()
    return _near_pairs(stars, nodes, similar)


def _near_pairs(pairs: DataFrame, nodes: DataFrame, similar: int) -> DataFrame:
    x, y = nodes.select("set_id", "n", "signature").alias("x"), nodes.select("set_id", "n", "signature").alias("y")
    both = pairs.join(shuffled(x), F.col("a") == F.col("x.set_id")).join(shuffled(y), F.col("b") == F.col("y.set_id"))
    return both.where(near("x", "y", similar)).select("a", "b")


def open_rows(shared: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """key, size, set_id, of, n, signature, sketch: the nodes of keys whose nodes are not yet of one class of `found` (id, component)."""
    placed = shared.join(shuffled(found.withColumnRenamed("id", "set_id")), "set_id", "left").select("key", "size", "set_id", F.coalesce("component", "set_id").alias("of"))
    several = placed.groupBy("key").agg(F.min("of").alias("lo"), F.max("of").alias("hi"), F.first("size").alias("size")).where("lo <> hi").select("key", _all_parts())
    return placed.select("*", _part()).join(shuffled(several), ["key", "part"]).drop("part").join(shuffled(nodes.select("set_id", "n", "signature", "sketch")), "set_id")


def cells(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of open_rows in all their cells (key, p, q): a block p of a key and a block q; `right` tells the rows of q where they differ."""
    # Nodes of one large class of a key have blocks of their own, the rest are mixed.
    large = rows.groupBy("key", "of").agg(F.count("*").alias("m"), F.first("size").alias("size")).where(F.col("m") >= block)
    apart = large.groupBy("key").agg(F.sum("m").alias("apart"))
    per = rows.groupBy("key").agg(F.count("*").alias("every"), F.first("size").alias("size")).join(shuffled(apart), "key", "left")
    per = per.select("key", (F.col("every") - F.coalesce("apart", F.lit(0))).alias("small"), _all_parts(block))
    big = F.col("m").isNotNull()
    count = F.when(big, F.ceil(F.col("m") / block)).otherwise(F.ceil(F.col("small") / block)).cast("long")
    blk = F.xxhash64(big, F.when(big, F.col("of")).otherwise(0).cast("long"), F.pmod(F.xxhash64("set_id"), count))
    dealt = (
        rows.select("*", _part(block)).join(shuffled(large.select("key", "of", "m", _all_parts(block))), ["key", "of", "part"], "left").join(shuffled(per), ["key", "part"])
        .select("key", "set_id", "of", "n", "signature", "sketch", blk.alias("blk"), F.when(big, F.col("of")).alias("pure"))
    )
    blocks = dealt.select("key", "blk", "pure").distinct()
    made = (
        blocks.select("key", F.col("blk").alias("p"), F.col("pure").alias("one")).join(shuffled(blocks.select("key", F.col("blk").alias("q"), F.col("pure").alias("other"))), "key")
        .where((F.col("p") <= F.col("q")) & ~F.coalesce(F.col("one") == F.col("other"), F.lit(False))).select("key", "p", "q")
    )
    dealt = dealt.drop("pure")
    cols = ["key", "p", "q", "right", "set_id", "of", "n", "signature", "sketch"]
    x = dealt.withColumnRenamed("blk", "p").join(shuffled(made), ["key", "p"]).withColumn("right", F.lit(False))
    y = dealt.withColumnRenamed("blk", "q").join(shuffled(made.where("p <> q")), ["key", "q"]).withColumn("right", F.lit(True))
    return x.select(*cols).unionByName(y.select(*cols))


def _by_cell(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "right", "set_id")


def near_rows(rows: DataFrame, similar: int) -> DataFrame:
    """The rows of `cells` that have a near partner in their cell: at most as many as there are."""
    return _by_cell(rows).mapInArrow(_with_partners(similar), CELL)


CELL = "key long, p long, q long, right boolean, set_id long, of long, n long, signature array<long>, sketch binary"


def first_keys(differ: np.ndarray) -> np.ndarray:
    """The first key that pairs share, as chunk * PER + left-out symbol, from their differing symbols (pairs, SYMBOLS); SYMBOLS where there is none."""
    by_chunk = differ.reshape(len(differ), CHUNKS, PER)
    few = by_chunk.sum(2)
    ok = few <= 1
    chunk = ok.argmax(1)
    rows = np.arange(len(differ))
    return np.where(ok.any(1), chunk * PER + by_chunk[rows, chunk].argmax(1), SYMBOLS)


#: Pairs looked at in one piece, and pairs from which a cell is looked at as a matrix.
PIECE, MATRIX = 1 << 16, 1 << 12


def close_pairs(cell: np.ndarray, right: np.ndarray, left_out: np.ndarray, of: np.ndarray, n: np.ndarray, symbols: np.ndarray, sketch: np.ndarray, similar: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): the near pairs of rows of each cell that are of different classes and have `left_out` as their first shared key.

    Rows are sorted by cell, and in it by side; in a cell of one block all rows are on the left and pair with those behind them.
    """
    starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    ends = np.append(starts[1:], len(cell))
    middle = starts + np.add.reduceat((~right).astype(np.int64), starts)
    one = middle == ends
    at = np.arange(len(cell))
    which = np.repeat(np.arange(len(starts)), ends - starts)
    begin = np.where(one[which], at + 1, middle[which])
    count = np.where(right, 0, ends[which] - begin)
    large = np.add.reduceat(count, starts) >= MATRIX
    out: list[tuple[np.ndarray, np.ndarray]] = []

    limits = sketch_limits(similar)

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        good = first_keys(symbols[i] != symbols[j]) == left_out[i]
        i, j = i[good], j[good]
        x, y = sketch[i], sketch[j]
        good = (x != y).sum(1) <= limits[((x | y) != 0).sum(1)]
        out.append((i[good], j[good]))

    rows = np.flatnonzero((count > 0) & ~large[which])
    total = np.cumsum(count[rows])
    a = 0
    while a < len(rows):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PIECE, "right")))
        some = rows[a:b]
        i = np.repeat(some, count[some])
        j = np.arange(len(i)) - np.repeat(np.cumsum(count[some]) - count[some], count[some]) + np.repeat(begin[some], count[some])
        fit = (of[i] != of[j]) & (100 * n[i] >= similar * n[j]) & (100 * n[j] >= similar * n[i])
        i, j = i[fit], j[fit]
        fit = (symbols[i] != symbols[j]).sum(1) <= FAR
        keep(i[fit], j[fit])
        a = b
    for c in np.flatnonzero(large).tolist():
        lo, mid, hi = int(starts[c]), int(middle[c]), int(ends[c])
        x = slice(lo, mid)
        y = x if one[c] else slice(mid, hi)
        apart = np.zeros((mid - lo, y.stop - y.start), np.uint8)
        for s in range(SYMBOLS):
            apart += symbols[x, s, None] != symbols[None, y, s]
        fit = (apart <= FAR) & (of[x, None] != of[None, y]) & (100 * n[x, None] >= similar * n[None, y]) & (100 * n[None, y] >= similar * n[x, None])
        if one[c]:
            fit = np.triu(fit, 1)
        i, j = np.nonzero(fit)
        for k in range(0, len(i), PIECE):
            keep(i[k : k + PIECE] + lo, j[k : k + PIECE] + y.start)
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that end with a cell; a cell is bounded, so what is held back is too."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        ids = np.stack([table.column(c).to_numpy() for c in ("key", "p", "q")])
        last = np.flatnonzero((ids != ids[:, -1:]).any(0))
        at = int(last[-1]) + 1 if len(last) else 0
        held = table.slice(at)
        if at:
            yield table.slice(0, at)
    if held is not None:
        yield held


def pairs_of(table: pa.Table, similar: int) -> tuple[np.ndarray, np.ndarray]:
    """close_pairs of the rows of a table of whole cells."""
    key, p, q, of, n = (table.column(c).to_numpy() for c in ("key", "p", "q", "of", "n"))
    symbols = table.column("signature").combine_chunks().flatten().to_numpy().view(np.uint16).reshape(-1, SYMBOLS)
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
    cell = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]))))
    return close_pairs(cell, table.column("right").to_numpy(), key.view(np.uint64) >> np.uint64(48), of, n, symbols, sketch, similar)


def _with_partners(similar: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_cells(batches):
            some = np.zeros(table.num_rows, bool)
            for side in pairs_of(table, similar):
                some[side] = True
            yield from table.filter(pa.array(some)).combine_chunks().to_batches()

    return run


def spanning(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Of links between rows, those that join parts which no earlier one has joined."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x

    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        a, b = top(x), top(y)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((x, y))
    return out


def _confirm_cells(similar: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_cells(batches):
            i, j = pairs_of(table, similar)
            ids, hashes = table.column("set_id").to_numpy(), table.column("hashes").combine_chunks()
            sets = [np.frombuffer(h.as_buffer(), np.uint64) for h in hashes]
            size = np.array([len(x) for x in sets], np.int64)
            order = np.lexsort((j, i))
            i, j = i[order], j[order]
            starts = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else np.empty(0, np.int64)
            linked = np.zeros(len(i), bool)
            for a, b in zip(starts.tolist(), np.append(starts[1:], len(i)).tolist(), strict=True):
                lead = sets[i[a]]
                both = shares(lead, [sets[x] for x in j[a:b].tolist()])
                linked[a:b] = 100 * both >= similar * (len(lead) + size[j[a:b]] - both)
            kept = spanning(ids[i[linked]], ids[j[linked]])
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in kept], pa.int64()), pa.array([y for _, y in kept], pa.int64())], ["a", "b"])

    return run


def full_sets(docs: DataFrame, wanted: DataFrame, k: int, text: str) -> DataFrame:
    """set_id, hashes: the full set of each wanted node (set_id, h1, h2), hashed again from its document's whole text."""
    picked = docs.select(F.col("doc_id").cast("long").alias("set_id"), F.col(text).alias("text")).join(wanted.hint("shuffle_hash"), "set_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
            for at, data, offsets in kernel.chunks(batch.column("text")):
                sets, bounds = shingles(data, offsets, k)
                full = np.flatnonzero(np.diff(bounds))
                if not len(full):
                    continue
                own = [h.view(np.int64) for h in set_hashes(sets, bounds[full])]
                keep = full[(own[0] == h1[at + full]) & (own[1] == h2[at + full])]
                hashes = pa.array([sets[bounds[i] : bounds[i + 1]].tobytes() for i in keep], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("set_id").take(pa.array(at + keep)), hashes], ["set_id", "hashes"])

    return picked.select("set_id", "text", "h1", "h2").mapInArrow(run, "set_id long, hashes binary")


def shares(lead: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted set with others; none is empty."""
    values = np.concatenate(others)
    place = np.minimum(np.searchsorted(lead, values), len(lead) - 1)
    begin = np.cumsum([0, *map(len, others[:-1])])
    return np.add.reduceat((lead[place] == values).astype(np.int64), begin)


def _confirm_stars(similar: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, own = np.empty(0, np.uint64), None
        for batch in batches:
            a, chunk, b = (batch.column(c).to_numpy() for c in ("a", "chunk", "b"))
            leads, hashes = batch.column("leads").to_numpy(zero_copy_only=False), batch.column("hashes")
            starts = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (chunk[1:] != chunk[:-1]))))
            linked = []
            for i, j in zip(starts.tolist(), np.append(starts[1:], len(a)).tolist(), strict=True):
                sets = [np.frombuffer(hashes[x].as_buffer(), np.uint64) for x in range(i, j)]
                if leads[i]:
                    lead, own, i, sets = sets[0], (a[i], chunk[i]), i + 1, sets[1:]
                if i == j:
                    continue
                if own != (a[i], chunk[i]):
                    raise ValueError("partners without their lead")
                both, size = shares(lead, sets), np.array([len(x) for x in sets])
                linked.append(i + np.flatnonzero(100 * both >= similar * (len(lead) + size - both)))
            at = np.concatenate(linked) if linked else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at])], ["a", "b"])

    return run


def set_table(docs: DataFrame, nodes: DataFrame, ids: DataFrame, k: int, text: str) -> DataFrame:
    """set_id, hashes of the nodes in ids (set_id), written once."""
    wanted = ids.distinct().join(shuffled(nodes.select("set_id", "h1", "h2")), "set_id")
    return cut(full_sets(docs, wanted, k, text).dropDuplicates(["set_id"]), "dup-sets", "lz4")


def star_links(stars: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The links among stars (a, b), on full sets. A lead of many partners is confirmed in chunks of about BLOCK."""
    per = stars.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("chunks"))
    celled = stars.join(shuffled(per), "a").select("a", F.pmod(F.xxhash64("b"), "chunks").alias("chunk"), "b")
    partners = celled.join(shuffled(sets), F.col("b") == F.col("set_id")).select("a", "chunk", F.lit(False).alias("leads"), "b", "hashes")
    leads = celled.select("a", "chunk").distinct().join(shuffled(sets), F.col("a") == F.col("set_id")).select("a", "chunk", F.lit(True).alias("leads"), F.col("a").alias("b"), "hashes")
    rows = leads.unionByName(partners).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.desc("leads"))
    return rows.mapInArrow(_confirm_stars(similar), "a long, b long")


def cell_links(rows: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """A spanning forest of the links in each cell of near_rows, on full sets."""
    held = _by_cell(rows.join(shuffled(sets), "set_id").select(*[c.split()[0] for c in CELL.split(", ")], "hashes"))
    return held.mapInArrow(_confirm_cells(similar), "a long, b long")


def near_duplicates(docs: DataFrame, k: int = WORDS, similar: int = SIMILAR, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    signed = cut(sign(docs, k, text), "dup-signed")
    nodes = cut(distinct_sets(signed), "dup-nodes")
    shared = cut(buckets(nodes), "dup-buckets")
    stars = cut(star_pairs(shared, nodes, similar), "dup-stars")
    ids = stars.select(F.col("a").alias("set_id")).union(stars.select("b"))
    links = cut(star_links(stars, set_table(docs, nodes, ids, k, text), similar), "dup-star-links")
    found = components(links, "dup-classes")
    rest = cut(near_rows(cells(cut(open_rows(shared, nodes, found), "dup-open")), similar), "dup-near")
    if not rest.isEmpty():
        more = cut(cell_links(rest, set_table(docs, nodes, rest.select("set_id"), k, text), similar), "dup-cell-links")
        found = components(links.unionByName(more), "dup-links")
    classes = (
        nodes.select("h1", "h2", "set_id", "docs").join(shuffled(found), F.col("set_id") == F.col("id"), "left")
        .select("h1", "h2", "docs", "set_id", F.coalesce("component", "set_id").alias("component"))
        .where("docs > 1 or component <> set_id").select("h1", "h2", "component")
    )
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return (
        signed.where("n_shingles > 0").select("doc_id", "n_shingles", "h1", "h2").join(shuffled(classes), ["h1", "h2"], "left")
        .select("doc_id", "n_shingles", own.alias("component_id"))
        .unionByName(signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def drop_near_duplicates(docs: DataFrame, k: int = WORDS, similar: int = SIMILAR, text: str = "text") -> DataFrame:
    """docs with one row of each group; of rows that repeat a doc_id and its text one stays. Texts that share a doc_id are judged apart."""
    key, of, n, place = free_names(docs, "__id", "__digest", "__n", "__rank")
    some, none = docs.where("doc_id is not null"), docs.where("doc_id is null")
    own = F.col("doc_id").cast("long")
    if some.groupBy(own.alias(key)).agg(F.count("*").alias(n)).where(F.col(n) > 1).isEmpty():
        ids = cut(near_duplicates(docs, k, similar, text).where("kept and doc_id is not null").select(F.col("doc_id").alias(key)), "dup-kept")
        return docs.join(ids.hint("shuffle_hash"), own == F.col(key), "left_semi").unionByName(none)
    # Each text of an id gets a rank in the order of ids, which stands for the id.
    digest = F.coalesce(F.md5(F.col(text)), F.lit(""))
    texts = ranked(some.groupBy(own.alias(key), digest.alias(of)).agg(F.count("*").alias(n)), "dup-texts", key, of, rank=place)
    texts = cut(texts, "dup-ranks")
    on = (own == F.col(key)) & (digest == F.col(of))
    named = cut(some.join(texts.hint("shuffle_hash"), on).select(F.col(place).alias("doc_id"), F.col(text).alias("text")), "dup-named")
    kept = near_duplicates(named, k, similar).where("kept").select(F.col("doc_id").alias(place)).distinct()
    kept = cut(texts.join(kept, place).drop(place), "dup-kept")
    once = some.join(kept.where(F.col(n) == 1).hint("shuffle_hash"), on, "left_semi")
    again = some.join(kept.where(F.col(n) > 1).hint("shuffle_hash"), on).dropDuplicates([key, of]).select(*docs.columns)
    return once.unionByName(again).unionByName(none)


SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS t
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(t, s + 1, s + 5), ' ') AS w FROM docs, unnest(range(0, greatest(len(t) - 5, 0) + 1)) u(s) WHERE len(t) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
both_in AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.w = b.w AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM both_in b JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * b.n >= 75 * (p.n + q.n - b.n)),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, far) AS (SELECT x, x FROM sides UNION SELECT r.doc_id, s.y FROM reach r JOIN sides s ON r.far = s.x),
least_of AS (SELECT doc_id, min(far) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, d.doc_id = coalesce(component_id, d.doc_id) AS kept
FROM docs d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN least_of l ON l.doc_id = d.doc_id
"""
