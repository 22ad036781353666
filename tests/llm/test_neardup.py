import random
import re

import numpy as np
import pytest

from caselink.llm import kernel, neardup

from .conftest import DOCS


def brute(rows):
    """doc_id -> (n_shingles, component_id) by comparing all pairs of full sets."""
    sets = {}
    for doc_id, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[doc_id] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
    ids = sorted(sets)
    label = {i: i for i in ids}
    changed = True
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return {i: (len(sets[i]), label[i]) for i in ids}


def corpus(seed, n=60, copies=90):
    """Texts, and edited copies whose similarity lies on both sides of the threshold."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice((3, 5, 8, 40, 120)))) for _ in range(n)]
    for _ in range(copies):
        t = rng.choice(texts).split()
        for _ in range(rng.randrange(0, max(1, len(t) // 15) + 1)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t).upper() if rng.random() < 0.1 else " ".join(t))
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_large_group_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup.cells, "__defaults__", (16,))
    monkeypatch.setattr(neardup._part, "__defaults__", (16,))
    monkeypatch.setattr(neardup._all_parts, "__defaults__", (16,))
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "MATRIX", 64)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(90):
        t = list(base)
        for _ in range(rng.randrange(1, 6)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(30)}"
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_hub_and_spokes(spark):
    """Copies that are close to one text only, which has the largest id."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(40):
        t = list(base)
        for _ in range(4):
            t[rng.randrange(len(t))] = f"x{i}"
        rows.append((i, " ".join(t)))
    rows.append((99, " ".join(base)))
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df).collect()}
    assert got == brute(rows)


def boilerplate(n, seed=4):
    """Texts that share a passage: pairs have a similarity of 0.2 to 0.4, or are copies of one another (one in fifty)."""
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(n):
        if i % 50 == 49:
            t = rows[-1][1].split()
            t[-1] = "end"
            rows.append((i, " ".join(t)))
            continue
        rows.append((i, " ".join(common + [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(45, 70))])))
    return rows


def test_shared_passages_do_not_make_groups(spark):
    rows = boilerplate(1500)
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    nodes = neardup.distinct_sets(neardup.sign(df)).persist()
    shared = neardup.buckets(nodes)
    stars = neardup.star_pairs(shared, nodes, 75).count()
    none = spark.createDataFrame([], "id long, component long")
    dealt = neardup.cells(neardup.open_rows(shared, nodes, none))
    near = neardup.near_rows(dealt, 75).count()
    assert stars < 0.01 * 1500 * 1499 / 2 and near < 0.1 * dealt.count()
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()}
    assert got == {i: i - 1 if i % 50 == 49 else i for i, _ in rows}


def test_close_pairs_equal_all_pairs():
    """Every pair of different classes within FAR and the size ratio comes out once, in the cell of its first shared key."""
    rng = np.random.default_rng(6)
    n = 300
    base = rng.integers(0, 1 << 16, (6, neardup.SYMBOLS)).astype(np.uint16)
    symbols = base[rng.integers(0, 6, n)].copy()
    for row in symbols:
        row[rng.choice(neardup.SYMBOLS, rng.integers(0, 22), replace=False)] = rng.integers(0, 1 << 16)
    sketch = np.zeros((n, neardup.BINS), np.uint8)
    of, size = rng.integers(0, 40, n), rng.integers(50, 90, n)
    keys: dict = {}
    for i, row in enumerate(symbols.reshape(n, neardup.CHUNKS, neardup.PER)):
        for c in range(neardup.CHUNKS):
            for o in range(neardup.PER):
                keys.setdefault((c * neardup.PER + o, tuple(np.delete(row[c], o))), []).append(i)
    found = []
    for limit in (1, 1 << 30):
        neardup_matrix, neardup.MATRIX = neardup.MATRIX, limit
        rows = [(k[0], r, cell) for cell, (k, members) in enumerate(keys.items()) for r in members]
        at = np.array([r for _, r, _ in rows])
        i, j = neardup.close_pairs(np.array([c for _, _, c in rows]), np.zeros(len(rows), bool), np.array([k for k, _, _ in rows], np.uint64), of[at], size[at], symbols[at], sketch[at], 75)
        found.append(sorted((min(x), max(x)) for x in zip(at[i].tolist(), at[j].tolist())))
        neardup.MATRIX = neardup_matrix
    together = {frozenset(p) for members in keys.values() for p in ((x, y) for x in members for y in members if x != y)}
    want = sorted(
        (a, b) for a, b in (sorted(p) for p in together)
        if of[a] != of[b] and (symbols[a] != symbols[b]).sum() <= neardup.FAR and 100 * min(size[a], size[b]) >= 75 * max(size[a], size[b])
    )
    assert found[0] == found[1] == want and len(want) > 100


def test_sketch_keeps_pairs_at_the_threshold():
    """Of pairs of sets with similarity 0.75, none fails the sketch; of 0.33 nearly all do."""
    rng = np.random.default_rng(9)
    limits = neardup.sketch_limits(75)
    for shared, own, few in ((600, 100, 0), (60, 10, 0), (300, 300, 5), (6, 1, 0)):
        missed, kept = 0, 0
        for _ in range(300):
            x = rng.integers(0, 1 << 64, shared + 2 * own, dtype=np.uint64)
            sets = [np.unique(x[: shared + own]), np.unique(np.concatenate((x[:shared], x[shared + own :])))]
            a, b = neardup.sketches(np.concatenate(sets), np.array([0, len(sets[0])]))
            ok = (a != b).sum() <= limits[((a | b) != 0).sum()]
            missed, kept = missed + (not ok), kept + ok
        assert kept <= few if few else missed == 0


def test_spanning_links_join_the_same_parts():
    rng = random.Random(4)
    for _ in range(50):
        links = [(rng.randrange(12), rng.randrange(12)) for _ in range(rng.randrange(0, 25))]
        kept = neardup.spanning(np.array([a for a, _ in links], np.int64), np.array([b for _, b in links], np.int64))
        part = lambda pairs: {frozenset(_reach(x, pairs)) for x in range(12)}
        assert part(kept) == part(links) and len(kept) == 12 - len(part(links))


def _reach(x, pairs):
    seen, todo = {x}, [x]
    while todo:
        v = todo.pop()
        for a, b in pairs:
            for w in ((b,) if a == v else ()) + ((a,) if b == v else ()):
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
    return seen


def test_words_that_a_polynomial_hash_confuses(spark):
    """A Thue-Morse word and its complement are different texts."""
    word = "a"
    while len(word) < 2048:
        word = "".join({"a": "ab", "b": "ba"}[c] for c in word)
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 1}


def test_pairs_within_the_distance_share_a_key(spark):
    """The guarantee: up to ERRORS differing symbols, wherever they stand, leave a common key."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    rows = []
    for _ in range(200):
        a = rng.integers(0, 1 << 16, neardup.SYMBOLS)
        b = a.copy()
        b[rng.choice(neardup.SYMBOLS, neardup.ERRORS, replace=False)] ^= 1
        rows.append(tuple([int(x) for x in (v.reshape(neardup.CHUNKS, 4).astype(np.uint64) << np.arange(0, 64, 16, dtype=np.uint64)).sum(1, dtype=np.uint64).view(np.int64)] for v in (a, b)))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    keys = df.select(neardup.chunk_keys(F.col("a")).alias("a"), neardup.chunk_keys(F.col("b")).alias("b"))
    assert keys.where(~F.arrays_overlap("a", "b")).count() == 0


def test_defined_cases(messy, nothing):
    got = neardup.near_duplicates(messy)
    assert got.count() == messy.count()
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert [(r["n_shingles"], r["component_id"], r["kept"]) for r in by[1]] == [(5, 1, True)] * 2
    assert by[2][0]["component_id"] == 1 and not by[2][0]["kept"]
    assert all(by[i][0]["n_shingles"] == 0 and by[i][0]["kept"] for i in (3, 4, 5))
    assert by[6][0]["n_shingles"] == 1
    assert by[8][0]["component_id"] == 7
    assert all(r["component_id"] is None and r["kept"] for r in by[None])
    assert neardup.near_duplicates(nothing).count() == 0
    kept = neardup.drop_near_duplicates(messy)
    assert kept.columns == messy.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "5", "6", "7", "9", "None", "None"]


def test_texts_that_share_an_id_are_judged_apart(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(3, text), (5, text), (5, "another text that stands under the same number"), (6, "first of two texts of six"), (6, "second one of six"), (6, "second one of six"), (6, None), (None, text), (None, text)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    kept = neardup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(str((r["doc_id"], r["text"])) for r in kept.collect()) == sorted(str(r) for k, r in enumerate(rows) if k not in (1, 5))


def test_kernel_words():
    import pyarrow as pa

    is_word, low = kernel.class_table(kernel.BLANKS)
    texts = ["Ab ab", None, "", " x\x00y \x1cz ", "É é A"]
    (at, data, offsets), *more = kernel.chunks(pa.array(texts))
    assert at == 0 and not more
    starts, ends, rows = kernel.word_bounds(data, offsets, is_word)
    assert [(int(r), bytes(data[a:b])) for a, b, r in zip(starts, ends, rows)] == [(0, b"Ab"), (0, b"ab"), (3, b"x\x00y"), (3, b"\x1cz"), (4, "É".encode()), (4, "é".encode()), (4, b"A")]
    h = kernel.word_hashes(data, starts, ends, low)
    assert h[0] == h[1] and h[4] != h[5]


def test_tables_behind_an_explode_are_not_broadcast(spark):
    # Spark's estimate of the keys of a written table is of less than one key for each signature, which has 40.
    words = "river stone meadow lantern harbor copper willow signal garden timber".split()
    docs = spark.createDataFrame([(i, " ".join(words[j % 10] + str(j % (5 + i % 3)) for j in range(30)), "en", "a", 1) for i in range(8)], DOCS)
    nodes = neardup.cut(neardup.distinct_sets(neardup.sign(docs, neardup.WORDS, "text")), "test-nodes")
    for made in (neardup.buckets(nodes), neardup._near_pairs(neardup.cut(spark.range(1).selectExpr("id a", "id b"), "test-pairs"), nodes, neardup.SIMILAR)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
