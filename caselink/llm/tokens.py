"""Token ids and their binary files, compressed by a Re-Pair grammar per shard.

Texts are encoded by a given tokenizer file and each document ends with an end
id. Documents are dealt by range of doc_id, so shards in the order of (part, seq)
hold all documents in ascending doc_id order. A shard is one file, stored as a
row (part, seq, ids, data) of a Parquet table, whose commit protocol leaves no
half file behind when an executor is lost.

In a shard, frequent pairs of neighbouring symbols are replaced by nonterminals,
round after round until no pair has LEAST places; a pair never spans two documents, so each document keeps its
own run of symbols. The file holds the rules, the length that each rule expands
to, and each document's first symbol and id count: one document, or a range of
its ids, is decoded without touching the others.

File format, little-endian: magic `RPAIR1\\0\\0`; uint32 documents, rules, symbol
width in bytes, first nonterminal; uint64 symbols; int64 doc_id and uint8 null
flag of each document; uint32 id counts; uint64 first symbols (one more than
documents); uint32 pairs of each rule; uint32 expansion lengths; the symbols.

Defined cases: null text is empty: only the end id. A null doc_id comes first.
Rows repeating a doc_id stand next to each other, by text. An empty table gives
no shard and no rows. Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel
from .shared import cut

SHARD_IDS = 1 << 20
PER_ROUND, LEAST = 2048, 16
CACHE_UNITS = 1_000_000
MAGIC = b"RPAIR1\0\0"


_BLANK, _LETTER, _DIGIT, _PUNCT, _ODD = range(5)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """(class of each byte, whether a byte behind 0xC3 completes a Latin letter)."""
    out = np.full(256, _ODD, np.uint8)
    for c in range(128):
        ch = chr(c)
        out[c] = _LETTER if ch.isalpha() else _DIGIT if ch.isdigit() else _PUNCT if ch.isprintable() and ch not in " '<>" else _ODD
    out[list(kernel.BLANKS)] = _BLANK
    second = np.zeros(256, bool)
    second[[*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)]] = True
    return out, second


_CLASS, _SECOND = _classes()
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def units(data: np.ndarray, offsets: np.ndarray):
    """(bytes to look up, starts, ends, rows, odd): what is encoded on its own, in order.

    A word of ASCII and Latin letters, digits and marks falls into its runs of
    letters, single digits and runs of marks, lowered: the tokenizer parts it there
    and lowers it. A word that holds anything else (an apostrophe, `<`, another
    script) is one odd unit, as it stands.
    """
    kind = _CLASS[data]
    low = _LOWER[data]
    pair = np.flatnonzero(data[:-1] == 0xC3)
    pair = pair[_SECOND[data[pair + 1]]]
    kind[pair] = kind[pair + 1] = _LETTER
    upper = pair[data[pair + 1] <= 0x9E] + 1
    low[upper] = data[upper] + 0x20
    starts, ends, rows = kernel.word_bounds(data, offsets, _IS_WORD)
    total = np.concatenate(([0], np.cumsum(kind == _ODD)))
    odd = total[ends] > total[starts]
    if odd.any():
        edge = np.zeros(len(data) + 1, np.int8)
        edge[starts[odd]] = 1
        edge[ends[odd]] -= 1
        inside = np.cumsum(edge[:-1]).astype(bool)
        low[inside] = data[inside]
        kind[inside] = _ODD
    new = np.zeros(len(data), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    new &= kind != _BLANK
    new[starts] = True
    at = np.flatnonzero(new)
    word = np.searchsorted(starts, at, "right") - 1
    stop = np.minimum(np.append(at[1:], len(data)), ends[word])
    return low, at, stop, rows[word], odd[word]


_IS_WORD, _ = kernel.class_table(kernel.BLANKS)


class Encoder:
    """Encodes whole texts; each unit of a word is encoded once and remembered.

    The tokenizer's pattern never spans a blank, and it parts letters from digits
    and marks, so the ids of a text are those of its units in order (a test compares
    whole texts). The cache is emptied when full.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        suffix = self.tokenizer.model.end_of_word_suffix
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.same = np.arange(256, dtype=np.uint8)
        self.clear()

    def clear(self) -> None:
        self.hashes = np.empty(0, np.uint64)  # of the known units, sorted
        self.slots = np.empty(0, np.int64)  # their places in bounds
        self.count = 0
        self.ids = np.zeros(1 << 16, np.uint32)
        self.bounds = np.zeros(1 << 12, np.int64)

    def _add(self, n: int, ids: np.ndarray, ends: np.ndarray) -> None:
        while self.count + n + 1 > len(self.bounds):
            self.bounds = np.concatenate((self.bounds, np.zeros_like(self.bounds)))
        at = self.bounds[self.count]
        while at + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[at : at + len(ids)] = ids
        self.bounds[self.count + 1 : self.count + 1 + n] = at + ends
        self.count += n

    def _whole(self, unit: bytes) -> None:
        ids = np.array(self.tokenizer.encode(unit.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
        self._add(1, ids, np.array([len(ids)]))

    def _learn(self, plain: list[bytes], odd: list[bytes]) -> None:
        """Plain units are encoded many at a time: each ends with the only token that carries the end-of-word suffix."""
        for a in range(0, len(plain), 1024):
            part = plain[a : a + 1024]
            ids = np.array(self.tokenizer.encode(b" ".join(part).decode(), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                self._add(len(part), ids, ends)
            else:
                for unit in part:
                    self._whole(unit)
        for unit in odd:
            self._whole(unit)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, one after the other, each with the end id; counts by row)."""
        n = len(offsets) - 1
        low, starts, ends, rows, odd = units(data, offsets)
        hashes, first, back = np.unique(kernel.word_hashes(low, starts, ends, self.same), return_index=True, return_inverse=True)
        if self.count > CACHE_UNITS:
            self.clear()
        place = np.searchsorted(self.hashes, hashes)
        at = np.full(len(hashes), -1, np.int64)
        inside = np.flatnonzero(place < len(self.hashes))
        hit = inside[self.hashes[place[inside]] == hashes[inside]]
        at[hit] = self.slots[place[hit]]
        if len(missing := np.flatnonzero(at < 0)):
            strange = odd[first[missing]]
            order = np.concatenate((missing[~strange], missing[strange]))
            raw = low.tobytes()
            new = [raw[a:b] for a, b in zip(starts[first[order]].tolist(), ends[first[order]].tolist(), strict=True)]
            at[order] = self.count + np.arange(len(order))
            self._learn(new[: len(new) - int(strange.sum())], new[len(new) - int(strange.sum()) :])
            self.hashes = np.insert(self.hashes, place[missing], hashes[missing])
            self.slots = np.insert(self.slots, place[missing], at[missing])
        at = at[back] if len(hashes) else np.empty(0, np.int64)
        begin, size = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
        counts = np.bincount(rows, weights=size, minlength=n).astype(np.int64) + 1
        # Each row's end id goes behind the last unit of the row.
        behind = np.cumsum(np.bincount(rows, minlength=n))
        begin, size = np.insert(begin, behind, -1), np.insert(size, behind, 1)
        total = int(size.sum())
        out_at = np.cumsum(size) - size
        where = np.repeat(begin - out_at, size) + np.arange(total)
        out = self.ids[np.maximum(where, 0)]
        out[out_at[begin < 0]] = end_id
        return out, counts


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of a worker process: what one task has learnt serves the next."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


@dataclass
class Shard:
    doc_ids: list[int | None]
    counts: np.ndarray  # ids of each document
    firsts: np.ndarray  # first symbol of each document, and the end
    rules: np.ndarray  # (rules, 2)
    lengths: np.ndarray
    symbols: np.ndarray
    base: int

    def dump(self) -> bytes:
        width = 2 if self.base + len(self.rules) <= 1 << 16 else 4
        null = np.array([d is None for d in self.doc_ids], np.uint8)
        ids = np.array([d or 0 for d in self.doc_ids], "<i8")
        head = MAGIC + struct.pack("<4IQ", len(ids), len(self.rules), width, self.base, len(self.symbols))
        return b"".join([head, ids.tobytes(), null.tobytes(), self.counts.astype("<u4").tobytes(), self.firsts.astype("<u8").tobytes(), self.rules.astype("<u4").tobytes(), self.lengths.astype("<u4").tobytes(), self.symbols.astype(f"<u{width}").tobytes()])

    @classmethod
    def load(cls, data: bytes) -> Shard:
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        docs, rules, width, base, symbols = struct.unpack_from("<4IQ", data, 8)
        at = 32
        parts = []
        for kind, n in (("<i8", docs), ("<u1", docs), ("<u4", docs), ("<u8", docs + 1), ("<u4", 2 * rules), ("<u4", rules), (f"<u{width}", symbols)):
            parts.append(np.frombuffer(data, kind, n, at))
            at += parts[-1].nbytes
        if at != len(data):
            raise ValueError("token shard of a wrong length")
        ids, null, counts, firsts, pairs, lengths, seq = parts
        return cls([None if b else int(a) for a, b in zip(ids, null, strict=True)], counts.astype(np.int64), firsts.astype(np.int64), pairs.astype(np.int64).reshape(-1, 2), lengths.astype(np.int64), seq.astype(np.int64), base)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that a run of symbols stands for."""
        while len(big := np.flatnonzero(symbols >= self.base)):
            size = np.ones(len(symbols), np.int64)
            size[big] = 2
            at = np.cumsum(size) - size
            out = np.repeat(symbols, size)
            pairs = self.rules[symbols[big] - self.base]
            out[at[big]], out[at[big] + 1] = pairs[:, 0], pairs[:, 1]
            symbols = out
        return symbols.astype(np.uint32)

    def every_id(self) -> np.ndarray:
        """The ids of all documents. Each rule is expanded once, then every symbol is a run of what has been expanded."""
        rules = self.expand(self.rules.reshape(-1))
        known = np.concatenate((np.arange(self.base, dtype=np.uint32), rules))
        size = np.concatenate((np.ones(self.base, np.int64), self.lengths))
        begin, size = (np.cumsum(size) - size)[self.symbols], size[self.symbols]
        at = np.repeat(begin - (np.cumsum(size) - size), size)
        at += np.arange(len(at))
        return known[at]

    def document(self, i: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop of document i; only the symbols that cover them are expanded."""
        run = self.symbols[self.firsts[i] : self.firsts[i + 1]]
        stop = int(self.counts[i]) if stop is None else min(stop, int(self.counts[i]))
        size = np.ones(len(run), np.int64)
        big = run >= self.base
        size[big] = self.lengths[run[big] - self.base]
        ends = np.cumsum(size)
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        before = int(ends[a - 1]) if a else 0
        return self.expand(run[a:b])[start - before : stop - before] if stop > start else np.empty(0, np.uint32)


def _slots(code: np.ndarray) -> np.ndarray:
    """A slot of each pair, by the high bits of a product of all its bits."""
    if code.dtype == np.uint32:
        return ((code * np.uint32(0x9E3779B1)) >> np.uint32(12)).astype(np.int64)
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


def repair(doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray, base: int) -> Shard:
    """Re-Pair: in each round the most frequent pairs of neighbours become nonterminals, until none has LEAST places; overlapping places go to the left one."""
    kind, shift = (np.uint64, 32) if base > 1 << 16 else (np.uint32, 16)
    seq = ids.astype(kind)
    ends = np.cumsum(counts) - 1
    last = np.zeros(len(seq), bool)
    last[ends] = True
    rules: list[np.ndarray] = []
    lengths = np.empty(0, np.int64)
    made = 0
    while len(seq) > 1:
        code = (seq[:-1] << kind(shift)) | seq[1:]
        slot = _slots(code)
        slot[last[:-1]] = 1 << 20
        seen = np.bincount(slot, minlength=(1 << 20) + 1)
        seen[1 << 20] = 0
        often = seen[seen >= LEAST]
        floor = int(np.partition(often, -PER_ROUND)[-PER_ROUND]) if len(often) > PER_ROUND else LEAST
        while True:
            maybe = np.flatnonzero((seen >= floor)[slot])
            pairs, n = np.unique(code[maybe], return_counts=True)
            pairs, n = pairs[n >= LEAST], n[n >= LEAST]
            if len(pairs) or floor == LEAST:
                break
            floor = LEAST  # rare pairs that share a slot hid the frequent ones
        if not len(pairs):
            break
        chosen = np.sort(pairs[np.lexsort((pairs, -n))[:PER_ROUND]])
        # One pair to a slot; another pair of the slot waits for the next round.
        place = np.full((1 << 20) + 1, -1, np.int64)
        where_to = _slots(chosen)
        _, one = np.unique(where_to, return_index=True)
        chosen, where_to = chosen[np.sort(one)], where_to[np.sort(one)]
        place[where_to] = np.arange(len(chosen))
        at = place[slot[maybe]]
        hit = (at >= 0) & (chosen[np.maximum(at, 0)] == code[maybe])
        where, which = maybe[hit], at[hit]
        run = np.flatnonzero(np.concatenate(([True], np.diff(where) != 1)))
        odd = (np.arange(len(where)) - np.repeat(run, np.diff(np.append(run, len(where))))) & 1
        where, which = where[odd == 0], which[odd == 0]
        left, right = (chosen >> kind(shift)).astype(np.int64), (chosen & kind((1 << shift) - 1)).astype(np.int64)
        size = lambda s: np.where(s < base, 1, lengths[np.clip(s - base, 0, max(0, len(lengths) - 1))] if len(lengths) else 1)
        more = size(left) + size(right)
        if kind is np.uint32 and base + made + len(chosen) > 1 << 16:
            kind, shift = np.uint64, 32
            seq = seq.astype(kind)
        seq[where] = (base + made + which).astype(kind)
        last[where] |= last[where + 1]
        keep = np.ones(len(seq), bool)
        keep[where + 1] = False
        seq, last = seq[keep], last[keep]
        rules.append(np.stack((left, right), 1))
        lengths = np.concatenate((lengths, more))
        made += len(chosen)
    firsts = np.concatenate(([0], np.flatnonzero(last) + 1))
    return Shard(doc_ids, counts, firsts, np.concatenate(rules) if rules else np.empty((0, 2), np.int64), lengths, seq, base)


SHARDS = "part long, seq long, ids long, docs long, data binary"


def write(docs: DataFrame, tokenizer: str, end_id: int = 1, shard_ids: int = SHARD_IDS, text: str = "text") -> DataFrame:
    """The shards of docs in the shared folder: part, seq, ids, docs, data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = encoder_of(tokenizer)
        base = encoder.tokenizer.get_vocab_size()
        part, seq = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq
            ids, counts = np.concatenate(held), np.concatenate(sizes)
            data = repair(list(names), ids, counts, base).dump()
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([len(counts)], pa.int64()), pa.array([data], pa.binary())], ["part", "seq", "ids", "docs", "data"])
            seq += 1
            names.clear(), held.clear(), sizes.clear()
            return out

        waiting = 0
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for at, data, offsets in kernel.chunks(batch.column("text"), 2 * kernel.CHUNK):
                ids, counts = encoder.encode(data, offsets, end_id)
                names += doc_ids.slice(at, len(counts)).to_pylist()
                held.append(ids)
                sizes.append(counts)
                waiting += len(ids)
                if waiting >= shard_ids:
                    yield flush()
                    waiting = 0
        if names:
            yield flush()

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(picked.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, SHARDS), "token-shards", "none")


def read(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the shard files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard.load(batch.column("data")[i].as_py())
                ids = shard.every_id().astype("<u4")
                ends = np.cumsum(shard.counts)
                if len(ids) != (ends[-1] if len(ends) else 0):
                    raise ValueError("a shard does not expand to its id counts")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip((ends - shard.counts).tolist(), ends.tolist(), strict=True)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, pa.int64()), pa.array(np.full(n, batch.column("part")[i].as_py())), pa.array(np.full(n, batch.column("seq")[i].as_py())), pa.array(ends - shard.counts), pa.array(shard.counts), pa.array(crc, pa.int64())],
                    ["doc_id", "part", "seq", "local", "n_tokens", "ids_crc32"],
                )

    rows = shards.select("part", "seq", "data").mapInArrow(run, "doc_id long, part long, seq long, local long, n_tokens long, ids_crc32 long")
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = shards.select("part", "seq", "ids").select("part", "seq", before.alias("before"))
    return rows.join(offsets, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
