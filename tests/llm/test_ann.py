import numpy as np

from caselink.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5):
    """query -> [(id, score)] over all usable vectors, in double precision."""
    use = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and all(x is not None for x in v) and np.isfinite(np.array(v, float)).all() and np.any(v)]
    out = {}
    for i, q in use:
        if i % 50 == 0:
            found = sorted((-float(q @ v / np.sqrt((q @ q) * (v @ v))), j) for j, v in use if j != i)[:k]
            out[i] = [(j, -s) for s, j in found]
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], SCHEMA)
    out = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0"), **more).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 700)
    monkeypatch.setattr(ann, "QUERIES", 9)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 31)) * rng.uniform(0.2, 4, (2000, 1))
    rows = [(i, x[i].astype(np.float32).tolist()) for i in range(2000)]
    got, want = run(spark, rows, rerank=64), brute(rows)
    assert set(got) == set(want)
    hits = sum(len({j for _, j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    exact = {(q, j): s for q in want for j, s in want[q]}
    for q, found in got.items():
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        assert [s for _, _, s in found] == sorted((s for _, _, s in found), reverse=True)
        assert all(abs(exact[q, j] - s) < 1e-12 for _, j, s in found if (q, j) in exact)


def test_a_very_common_vector_and_ties(spark):
    rng = np.random.default_rng(1)
    common = rng.normal(size=8).astype(np.float32).tolist()
    rows = [(i, common if i % 2 == 0 else rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    got, want = run(spark, rows), brute(rows)
    assert {q: [j for _, j, _ in f] for q, f in got.items()} == {q: [j for j, _ in f] for q, f in want.items()}
    assert [j for _, j, _ in got[0]] == [2, 4, 6, 8, 10]


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0, 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (50, [0.0, -0.0]), (6, [1.0, 1.0]), (100, [-1.0, 0.0])]
    got = run(spark, rows)
    assert {q: [j for _, j, _ in f] for q, f in got.items()} == {0: [6, 100], 100: [6, 0]}
    assert run(spark, []) == {}


def test_anisotropic_codes_lower_the_parallel_residual():
    rng = np.random.default_rng(5)
    x = ann.pairs(rng.normal(size=(1500, 32)))
    eta = ann.eta_of(32)
    assert eta > 1
    gap = {}
    for weight in (1.0, eta):
        books = ann.train(x, weight)
        codes = ann.assign(x, books, weight)
        chosen = np.stack([books[j][codes[:, j]] for j in range(x.shape[1])], 1)
        gap[weight] = float(((((x - chosen) * x).sum((1, 2))) ** 2).mean())
    assert gap[eta] < gap[1.0]


def test_tables_equal_sums_over_codewords():
    rng = np.random.default_rng(7)
    x, q = rng.normal(size=(50, 10)), rng.normal(size=(3, 10))
    p = ann.pairs(x)
    books = ann.train(p, 2.0)
    codes = ann.assign(p, books, 2.0)
    plain = np.einsum("qjd,njd->qn", ann.pairs(q), np.stack([books[j][codes[:, j]] for j in range(p.shape[1])], 1))
    assert np.allclose(ann.scan(ann.pack(codes), books, q), plain, atol=1e-5)


def test_tiny_and_huge_vectors(spark):
    """Vectors whose squares vanish or overflow have the cosine of their scaled copies."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(11)
    x = rng.normal(size=(120, 6))
    factor = np.array([1e-200, 1.0, 1e200])[np.arange(120) % 3]
    schema = "vec_id long, embedding array<double>"
    plain = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], schema)
    odd = spark.createDataFrame([(i, (v * f).tolist()) for i, (v, f) in enumerate(zip(x, factor))], schema)
    for c in ("v", "ids", "block", "part", "score", "rank"):
        odd = odd.withColumn(c, F.lit("clash"))
    rows = [[(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 12)) for r in ann.nearest(d, d.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()] for d in (plain, odd)]
    assert rows[0] == rows[1] and len(rows[0]) == 15
    assert all(np.isfinite(r[3]) for r in rows[1])
