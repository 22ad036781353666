import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from caselink.llm import kernel, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")

TEXTS = [
    "The cat's hat isn't here, it's GONE!!", "", None, "ÉTÉ naïve ß×÷ 中文 \U0001f600 é", "a<|endoftext|>b <|startoftext|> <|im_end|>", "123 4a5 b6 007 1.5e10 ٢½", "###!! ,,, ...x... (a) [b] {c}",
    "tab\tnl\nvt\x0bff\x0cnbsp x y\x1cz\x85w", "İI ſs Σς ǅ", "x" * 3000, "don't 'tis 'S'T'LL 're", "word " * 400 + "end", "café. CAFÉ, café; café!", "\x00\x01 \x7f a\x00b",
]


def want(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def encode(texts):
    e = tokens.Encoder(PATH)
    out = []
    for _, data, offsets in kernel.chunks(pa.array(texts, pa.string()), 200):
        ids, counts = e.encode(data, offsets, 1)
        out += [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])]
    return out


def test_units_equal_whole_texts():
    assert encode(TEXTS) == want(TEXTS)


def test_random_texts_equal_whole_texts():
    rng = random.Random(8)
    letters = "abcABCéÉß中Σ'.,!#<>|_-09½ \t\n ́\U0001f600"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 60))) for _ in range(400)]
    assert encode(texts) == want(texts)


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_UNITS", 5)
    assert encode(TEXTS * 3) == want(TEXTS * 3)


@pytest.mark.parametrize("base", [100, 49408, 70_000])
def test_repair_round_trip_and_random_access(base):
    rng = np.random.default_rng(base)
    parts = [np.tile(rng.integers(0, min(base, 40), 7), rng.integers(1, 30))[: rng.integers(1, 150)] for _ in range(300)]
    parts += [np.full(50, 3), np.array([5])]
    ids, counts = np.concatenate(parts).astype(np.uint32), np.array([len(p) for p in parts])
    shard = tokens.repair(list(range(len(parts))), ids, counts, base)
    assert len(shard.rules) and len(shard.symbols) < len(ids)
    again = tokens.Shard.load(shard.dump())
    assert (again.expand(again.symbols) == ids).all()
    assert [len(again.expand(np.array([base + r]))) for r in range(len(again.rules))] == again.lengths.tolist()
    for i in range(0, len(parts), 7):
        assert (again.document(i) == parts[i]).all()
        assert (again.document(i, 2, 9) == parts[i][2:9]).all()


def often(shard):
    """The most places that a pair within documents has left."""
    inside = np.ones(len(shard.symbols), bool)
    inside[shard.firsts[1:] - 1] = False
    at = np.flatnonzero(inside)
    return np.unique(np.stack((shard.symbols[at], shard.symbols[at + 1])), axis=1, return_counts=True)[1].max(initial=0)


@pytest.mark.parametrize("base", [300, 49408, 65_500, 70_000])
def test_no_frequent_pair_is_left(base, monkeypatch):
    rng = np.random.default_rng(base)
    passage = rng.integers(0, base, 500)
    parts = [np.concatenate((rng.integers(0, 20, rng.integers(0, 9)), passage)) for _ in range(40)] + [np.full(900, 7)]
    ids, counts = np.concatenate(parts).astype(np.uint32), np.array([len(p) for p in parts])
    for slots in (tokens._slots, lambda code: (code % code.dtype.type(5)).astype(np.int64)):
        monkeypatch.setattr(tokens, "_slots", slots)
        shard = tokens.Shard.load(tokens.repair(list(range(len(parts))), ids, counts, base).dump())
        assert often(shard) < tokens.LEAST and shard.lengths.max() == 500
        assert (shard.expand(shard.symbols) == ids).all()
        assert (shard.document(5, 100, 300) == parts[5][100:300]).all()


def test_a_broken_shard_is_refused():
    shard = tokens.repair([1], np.array([1, 2, 3], np.uint32), np.array([3]), 10).dump()
    for bad in (b"x" + shard[1:], shard[:-1]):
        with pytest.raises(ValueError):
            tokens.Shard.load(bad)


def test_whole_table(spark, messy, nothing):
    shards = tokens.write(messy, PATH, shard_ids=50)
    rows = tokens.read(shards).orderBy("start").collect()
    docs = sorted(((r["doc_id"], r["text"] or "") for r in messy.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    start = 0
    for r, (doc_id, ids) in zip(rows, zip([d for d, _ in docs], want([t for _, t in docs])), strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokens.read(tokens.write(nothing, PATH)).count() == 0


def test_every_id_expands_as_symbols_do():
    draw = np.random.default_rng(5)
    cases = [
        np.zeros(4096, np.uint32),
        np.tile(np.arange(16, dtype=np.uint32), 5000),
        draw.zipf(1.3, 50_000).clip(0, 499).astype(np.uint32),
        np.array([7], np.uint32),
    ]
    for ids in cases:
        cuts = np.unique(np.concatenate((draw.integers(1, len(ids) + 1, 9), [len(ids)])))
        shard = tokens.Shard.load(tokens.repair(list(range(len(cuts))), ids, np.diff(cuts, prepend=0), 500).dump())
        assert np.array_equal(shard.every_id(), ids)
        assert np.array_equal(shard.expand(shard.symbols), ids)
