import random

import pytest

from caselink.llm import mixing

from .conftest import DOCS


def test_targets_reshare_what_the_cap_leaves():
    got = mixing.targets({"a": 100, "b": 100, None: 1000})
    # budget 1800: shares 1125, 450, 225; a and b stop at 200, the rest goes to None
    assert got == {"a": 200, "b": 200, None: 1400}
    assert mixing.targets({"a": 0}) == {"a": 0}
    assert mixing.targets({}) == {}
    order = mixing.targets({"b": 10**6, "é": 10**6, "a": 10**6, "B": 10**6})
    assert [round(order[s] / 6e6, 6) for s in ("B", "a", "b", "é")] == [round(min(x / 13, 1 / 3), 6) if x < 5 else round(x / 13, 6) for x in (5, 2, 1, 5)] or sum(order.values()) == pytest.approx(6e6)


def test_flight_keeps_both_totals():
    for seed in range(20):
        rng = random.Random(seed)
        n = rng.randrange(1, 200)
        sizes = [float(rng.choice((0, 1, 5, 80, 80, 3000))) for _ in range(n)]
        probs = [rng.random() for _ in range(n)]
        out = mixing.flight(sizes, probs, random.Random(seed))
        assert all(0 <= p <= 1 for p in out)
        assert sum(0 < p < 1 for p in out) <= 2
        assert sum(out) == pytest.approx(sum(probs))
        assert sum(p * s for p, s in zip(out, sizes)) == pytest.approx(sum(p * s for p, s in zip(probs, sizes)), abs=1e-3)
        landed = mixing.land(sizes, out, random.Random(seed))
        assert all(p in (0.0, 1.0) for p in landed)


def test_flight_draws_with_the_given_probabilities():
    hits = [0.0] * 6
    for seed in range(3000):
        out = mixing.land([1.0] * 6, mixing.flight([1.0] * 6, [0.5] * 6, random.Random(seed)), random.Random(seed))
        hits = [h + p for h, p in zip(hits, out)]
    assert all(abs(h / 3000 - 0.5) < 0.05 for h in hits)


def docs(spark, n=900):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.choice((1, 10, 50, 400))), "en", rng.choice(["hot"] * 6 + ["b", "c", None]), 0) for i in range(n)]
    return spark.createDataFrame(rows, DOCS)


def test_whole_table(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 64)  # several levels
    d = docs(spark)
    rows = mixing.mix(d).collect()
    assert len(rows) == 900
    sizes = {r["doc_id"]: len((r["text"] or "").split()) for r in d.collect()}
    per = {}
    for r in rows:
        assert r["size"] == sizes[r["doc_id"]] and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        per.setdefault(r["source"], []).append(r)
    goal = mixing.targets({s: sum(r["size"] for r in p) for s, p in per.items()})
    for s, p in per.items():
        assert p[0]["target"] == pytest.approx(goal[s]) and p[0]["source_size"] == sum(r["size"] for r in p)
        assert abs(sum(r["taken"] for r in p) - goal[s]) <= 400
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(d.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_take_repeats_rows(spark):
    d = docs(spark, 200).unionByName(docs(spark, 20))  # 20 repeated rows
    m = mixing.mix(d)
    out = mixing.take(d, m)
    assert out.columns == d.columns
    want, got = {}, {}
    for r in m.collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["copies"]
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {k: v for k, v in want.items() if v}


def test_defined_cases(messy, nothing):
    rows = mixing.mix(messy).collect()
    assert len(rows) == messy.count()
    assert all(r["size"] == 0 and r["taken"] == 0 for r in rows if r["doc_id"] in (3, 4, 5))
    assert mixing.mix(nothing).count() == 0
    assert mixing.take(messy, mixing.mix(messy)).columns == messy.columns
