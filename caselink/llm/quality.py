"""Quality classifier: a weak-label model and a hashed linear scorer.

Overlapping heuristic labellers vote low, high or nothing on each document. The
votes of all documents are counted by pattern (at most 3 ** labellers rows reach
the driver), and expectation-maximisation estimates the class prior and, for each labeller, how
often its votes are right. The posterior of a pattern is the soft label of its documents. A logistic scorer over hashed features (byte
trigrams, and word events such as a repeat of the previous word) is fitted to the
soft labels of a bounded sample (`sample` documents with the smallest hashes of id
and text, as vectors of fixed size) and then scores the whole text of every
document.

Defined cases: null and empty text, and text without words, score 0 and are
rejected. Documents that the labellers abstain on get the scorer's verdict.
Rows repeating a document are scored one by one; an empty table gives no rows.
Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .shared import cut

SAMPLE = 4000
TRIGRAMS, EVENTS = 1 << 12, 1 << 8
THRESHOLD = 0.5

#: Frequent words of four languages.
STOP_WORDS = (
    "the of and to in is that for it with as was on be by this are from or an at which have not"
    " le la les de des et en un une du que qui dans par pour sur au est ne pas"
    " der die das und den von zu mit sich auf für ist im dem nicht ein eine als auch es"
    " el los se del las por con una para al lo como más su y"
)

_IS_WORD, _LOWERED = kernel.class_table(kernel.BLANKS)


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[[ord(c) for c in chars]] = 1
    return out


_SYMBOL, _BAR, _MARK = _table("#$%&*<>{}[]^~\\="), _table("|"), _table("!?")
_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _table("abcdefghijklmnopqrstuvwxyz")
#: First bytes of characters beyond Latin-1: of other scripts, nearly always.
_OTHER = np.array([0] * 0xC4 + [1] * 60, np.int64)


def _hashes_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = kernel.word_bounds(data, np.array([0, len(data)]), _IS_WORD)
    return np.sort(kernel.word_hashes(data, starts, ends, _LOWERED))


_STOP = np.unique(_hashes_of(STOP_WORDS))


class Words(NamedTuple):
    """The words of a chunk of documents: bounds, document, hash, and whether each repeats the one before."""

    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    hashes: np.ndarray
    again: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    starts, ends, rows = kernel.word_bounds(data, offsets, _IS_WORD)
    hashes = kernel.word_hashes(data, starts, ends, _LOWERED)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    return Words(starts, ends, rows, hashes, again)


def statistics(data: np.ndarray, offsets: np.ndarray, found: Words) -> dict[str, np.ndarray]:
    """Per document: words and the shares that the labellers look at."""
    n = len(offsets) - 1
    starts, ends, rows, words, again = found
    count = kernel.row_counts(rows, n)
    some = np.maximum(count, 1)

    def of_bytes(table: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(table[data])))
        return total[offsets[1:]] - total[offsets[:-1]]

    stop = _STOP[np.minimum(np.searchsorted(_STOP, words), len(_STOP) - 1)] == words
    first = np.concatenate(([0], np.cumsum(count)))
    distinct = np.array([len(np.unique(words[first[i] : first[i + 1]])) for i in range(n)], np.int64)
    upper, lower, other = of_bytes(_UPPER), of_bytes(_LOWER), of_bytes(_OTHER)
    return {
        "foreign": other / np.maximum(1, upper + lower + other),
        "words": count,
        "symbol": of_bytes(_SYMBOL) / some,
        "bar": of_bytes(_BAR) / some,
        "mark": of_bytes(_MARK) / some,
        "upper": upper / np.maximum(1, upper + lower),
        "again": np.bincount(rows, weights=again, minlength=n) / some,
        "distinct": distinct / some,
        "stop": np.bincount(rows, weights=stop & ~again, minlength=n) / some,
        "length": np.bincount(rows, weights=ends - starts, minlength=n) / some,
    }


#: labeller: (statistic, least words to vote, low if, high if); bounds are (comparison, value) or None for never.
LABELLERS = {
    "symbols": ("symbol", 1, (">", 0.5), None),
    "bars": ("bar", 1, (">", 0.2), None),
    "marks": ("mark", 1, (">", 0.5), None),
    "capitals": ("upper", 3, (">", 0.4), None),
    "repeats": ("again", 10, (">", 0.2), None),
    "variety": ("distinct", 60, ("<", 0.3), (">", 0.6)),
    "stop_words": ("stop", 20, ("<", 0.1), (">", 0.15)),
    "word_length": ("length", 20, (">", 6.8), None),
}
#: These judge by Latin words: they abstain where more than this share of letters is of other scripts.
LATIN_ONLY, FOREIGN = ("stop_words", "word_length"), 0.3
ABSTAIN, LOW, HIGH = 0, 1, 2


def vote(found: dict[str, np.ndarray]) -> np.ndarray:
    """(documents, labellers) of ABSTAIN, LOW or HIGH."""
    out = np.zeros((len(found["words"]), len(LABELLERS)), np.int64)
    for j, (labeller, (name, least, low, high)) in enumerate(LABELLERS.items()):
        x, enough = found[name], found["words"] >= least
        if labeller in LATIN_ONLY:
            enough = enough & (found["foreign"] <= FOREIGN)
        for verdict, rule in ((HIGH, high), (LOW, low)):
            if rule is None:
                continue
            sign, bound = rule
            out[enough & ((x > bound) if sign == ">" else (x < bound)), j] = verdict
    return out


_POWERS = 3 ** np.arange(len(LABELLERS))


def unpack(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // _POWERS % 3


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float, np.ndarray]:
    """EM over vote patterns: (posterior of `good` by pattern, prior, accuracy of each labeller's votes).

    A labeller is right with its accuracy whenever it votes; abstaining says
    nothing. Accuracies start at 0.8 and are kept from 0.55 to 0.99, so the classes
    cannot change places; the prior may be anything.
    """
    votes = unpack(patterns)
    right, prior = np.full(votes.shape[1], 0.8), 0.7
    low, high = votes == LOW, votes == HIGH
    for _ in range(rounds):
        lean = np.log(right / (1 - right))
        good = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + high @ lean - low @ lean, -500, 500)))
        was = np.append(right, prior)
        prior = float(np.clip((good * counts).sum() / max(1, counts.sum()), 0.001, 0.999))
        agree = ((high * good[:, None] + low * (1 - good)[:, None]) * counts[:, None]).sum(0) + 4
        right = np.clip(agree / (((high | low) * counts[:, None]).sum(0) + 5), 0.55, 0.99)
        if np.abs(np.append(right, prior) - was).max() < 1e-9:
            break
    return good, prior, right


def features(data: np.ndarray, offsets: np.ndarray, found: Words):
    """Feature ids and their rows: ((trigram buckets, rows), (word events, rows))."""
    low = data.astype(np.uint32)
    code = (low[:-2] << 16 | low[1:-1] << 8 | low[2:]) if len(low) > 2 else np.empty(0, np.uint32)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row[:-2] == row[2:] if len(low) > 2 else np.empty(0, bool)
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(32 - 12)).astype(np.int64)
    starts, ends, rows, _, again = found
    head, tail = _KIND[data[starts]], _KIND[data[ends - 1]]
    size = np.minimum((ends - starts) // 4, 3)
    return (bucket[inside], row[:-2][inside]) if len(low) > 2 else (bucket, row[:0]), (again.astype(np.int64) * 128 + head * 32 + tail * 4 + size, rows)


def _kinds() -> np.ndarray:
    """Byte classes for word events: 0 lower, 1 upper, 2 digit, 3 not ASCII; 4-7 marks (tails only use all)."""
    out = np.full(256, 3, np.int64)
    for c in range(128):
        ch = chr(c)
        out[c] = 0 if ch.islower() else 1 if ch.isupper() else 2 if ch.isdigit() else 4 if ch in ".,;:" else 5 if ch in "!?" else 6 if ch in "|" else 7
    return out


_KIND = _kinds()


def vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Dense hashed features (relative frequencies) of a few documents, for training."""
    n, size = len(offsets) - 1, TRIGRAMS + EVENTS * 2
    out = np.zeros((n, size), np.float32)
    for base, (ids, rows) in zip((0, TRIGRAMS), features(data, offsets, words_of(data, offsets)), strict=True):
        np.add.at(out, (rows, base + ids), 1)
    for a, b in ((0, TRIGRAMS), (TRIGRAMS, size)):
        out[:, a:b] /= np.maximum(1, out[:, a:b].sum(1, keepdims=True))
    return out


def fit_scorer(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 200, rate: float = 0.5, shrink: float = 1e-4) -> np.ndarray:
    """Logistic regression by Adam on scaled features; x is scaled in place. Returns weights on raw features and the bias last."""
    scale = 1 / np.sqrt(np.einsum("ij,ij->j", x, x) / len(x) + 1e-8)
    scale = np.minimum(scale, 1e3)
    x *= (scale / np.sqrt(x.shape[1])).astype(np.float32)
    z = x
    w, b = np.zeros(x.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(z @ w.astype(np.float32) + b, -40, 40)))
        miss = (p - y) * weight / weight.sum()
        g = np.append(miss.astype(np.float32) @ z + shrink * w, miss.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return np.append(w * scale / np.sqrt(x.shape[1]), b)


def score(data: np.ndarray, offsets: np.ndarray, found: Words, weights: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    total = np.full(n, weights[-1])
    for base, (ids, rows) in zip((0, TRIGRAMS), features(data, offsets, found), strict=True):
        count = np.maximum(1, np.bincount(rows, minlength=n))
        total += np.bincount(rows, weights=weights[base + ids], minlength=n) / count
    return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def votes_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, h (a hash of id and text), pattern (the votes as one number), n_words for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in kernel.chunks(batch.column("text")):
                found = statistics(data, offsets, words_of(data, offsets))
                own = [batch.column(c).slice(at, len(offsets) - 1) for c in ("doc_id", "h")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(vote(found) @ _POWERS), pa.array(found["words"].astype(np.int64))], ["doc_id", "h", "pattern", "n_words"])

    return _picked(docs, text).mapInArrow(run, "doc_id long, h long, pattern long, n_words long")


def _picked(docs: DataFrame, text: str) -> DataFrame:
    own = F.col("doc_id").cast("long")
    return docs.select(own.alias("doc_id"), F.col(text).alias("text"), F.xxhash64(own, F.col(text)).alias("h"))


def posterior_of(pattern: np.ndarray, patterns: np.ndarray, posterior: np.ndarray) -> np.ndarray:
    """Posteriors of vote patterns, by the sorted ones that EM has seen."""
    near = np.minimum(np.searchsorted(patterns, pattern), max(0, len(patterns) - 1))
    return posterior[near] if len(patterns) else np.zeros(len(pattern))


def _sample_vectors(docs: DataFrame, text: str, least: int, patterns: np.ndarray, posterior: np.ndarray) -> DataFrame:
    """h, posterior, x (float32 bytes) of the documents with words whose hash is at most `least`, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in kernel.chunks(batch.column("text"), 1 << 18):
                found = statistics(data, offsets, words_of(data, offsets))
                some = np.flatnonzero(found["words"])
                soft = posterior_of(vote(found) @ _POWERS, patterns, posterior)[some]
                x = vectors(data, offsets)[some]
                yield pa.RecordBatch.from_arrays([batch.column("h").take(pa.array(at + some)), pa.array(soft), pa.array([v.tobytes() for v in x], pa.binary())], ["h", "posterior", "x"])

    rows = _picked(docs, text).where(F.col("h") <= least).mapInArrow(run, "h long, posterior double, x binary")
    return rows.groupBy("h").agg(F.first("posterior").alias("posterior"), F.first("x").alias("x"))


def _fit_task(table: pa.Table) -> pa.Table:
    """The weights, from the bounded sample in one task: rows of fixed size."""
    order = np.argsort(table.column("h").to_numpy(), kind="stable")
    y = table.column("posterior").to_numpy()[order]
    rows = table.column("x").combine_chunks()
    x = np.empty((len(y), TRIGRAMS + EVENTS * 2), np.float32)
    for i, k in enumerate(order.tolist()):
        x[i] = np.frombuffer(rows[k].as_buffer(), np.float32)
    del table, rows
    w = fit_scorer(x, y, (np.abs(y - 0.5) + 0.05) * np.where(y < 0.5, 4, 1))
    return pa.table({"weights": pa.array([w.tolist()], pa.list_(pa.float64()))})


def _model(docs: DataFrame, sample: int, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vote patterns, their posteriors, weights of the scorer) of docs."""
    voted = cut(votes_of(docs, text), "quality-votes").where("n_words > 0")
    seen = voted.groupBy("pattern").agg(F.count("*").alias("n")).collect()
    patterns = np.array(sorted(r["pattern"] for r in seen), np.int64)
    count_of = {r["pattern"]: r["n"] for r in seen}
    weights, posterior = np.zeros(TRIGRAMS + EVENTS * 2 + 1), np.empty(0)
    if len(patterns):
        posterior, _, _ = fit_labels(patterns, np.array([count_of[p] for p in patterns], float))
        least = voted.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
        rows = _sample_vectors(docs, text, least, patterns, posterior)
        fitted = rows.withColumn("of", F.lit("sample")).groupBy("of").applyInArrow(_fit_task, "weights array<double>").collect()
        if fitted:
            weights = np.array(fitted[0]["weights"])
    return patterns, posterior, weights


def classify(docs: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """doc_id, posterior (of the votes, null without words), score, keep for every row of docs."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    patterns, posterior, weights = _model(docs, sample, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in kernel.chunks(batch.column("text")):
                words = words_of(data, offsets)
                found = statistics(data, offsets, words)
                some = found["words"] > 0
                post = posterior_of(vote(found) @ _POWERS, patterns, posterior)
                good = np.where(some, score(data, offsets, words, weights), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(good)), pa.array(post, mask=~some), pa.array(good), pa.array(some & (good >= threshold))], ["doc_id", "posterior", "score", "keep"]
                )

    return picked.mapInArrow(run, "doc_id long, posterior double, score double, keep boolean")


def drop_low_quality(docs: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """docs without the rows that the classifier rejects, each by its own text."""
    _, _, weights = _model(docs, sample, text)

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        found = []
        for _, data, offsets in kernel.chunks(texts):
            words = words_of(data, offsets)
            some = kernel.row_counts(words.rows, len(offsets) - 1) > 0
            found.append(some & (score(data, offsets, words, weights) >= threshold))
        return pa.array(np.concatenate(found) if found else np.empty(0, bool))

    return docs.where(good(F.col(text)))
