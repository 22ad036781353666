import hashlib
import random
import re

from caselink.llm import decontaminate

from .conftest import DOCS


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    cuts = [(str(i), w[k : k + 10]) for i, t in items for w in [words(t)] if w for k in range(max(1, len(w) - 9))]
    out = {}
    for doc_id, text in docs:
        w = words(text)
        hit, names = set(), set()
        for name, c in cuts:
            for s in range(len(w) - len(c) + 1):
                if w[s : s + len(c)] == c:
                    hit |= set(range(s, s + len(c)))
                    names.add(name)
        out[doc_id] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    return out


def fixture():
    rng = random.Random(4)
    vocabulary = ["the", "of", "Été", "été", "A1", "cat", "dog", "run", "blue", "sky"] + [f"v{i}" for i in range(30)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, make(rng.choice((2, 9, 10, 11, 25)))) for i in range(12)]
    items += [(12, []), (13, items[4][1]), (14, ["the"] * 14)]
    docs = []
    for d in range(60):
        t = make(rng.randrange(0, 60))
        if d % 3 == 0:
            i = rng.choice(items)[1]
            a = rng.randrange(0, max(1, len(i) - 9))
            t[len(t) // 2 : len(t) // 2] = i[a : a + rng.choice((9, 10, 14, 30))]
        docs.append((d, ", ".join(t).upper() if d % 7 == 0 else " ".join(t)))
    docs.append((60, "the " * 40))
    return docs, [(i, " ".join(t)) for i, t in items]


def test_equals_brute_force(spark):
    docs, items = fixture()
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.contamination(d, b).collect()}
    want = brute(docs, items)
    assert got == want
    assert any(v[4] for v in want.values()) and not all(v[4] for v in want.values())
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(d, b).collect()}
    assert kept == {i for i, v in want.items() if not v[4]}


def test_shuffle_path_gives_the_same(spark, monkeypatch):
    docs, items = fixture()
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS)
    b = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.contamination(d, b).collect()}
    assert got == brute(docs, items)


def test_prefix_rows_are_bounded(spark):
    """Many windows around one common word: the word joins with its places in a window, not with the windows."""
    rng = random.Random(2)
    items = [(i, " ".join(["the"] * 9 + [f"r{rng.randrange(5)}"])) for i in range(200)] + [(i, " ".join(rng.sample([f"c{j}" for j in range(12)], 10))) for i in range(200, 500)]
    docs = [(d, " ".join(rng.choice(["the", "r1", *[f"c{j}" for j in range(12)]]) for _ in range(400))) for d in range(10)]
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS)
    b = spark.createDataFrame(items, "item_id long, text string")
    cuts = decontaminate.windows(b)
    counts = decontaminate.cut_words(d).selectExpr("explode(t) as token").groupBy("token").count().withColumnRenamed("count", "n")
    per = [r["count"] for r in decontaminate.prefixes(cuts, counts).groupBy("token").count().collect()]
    assert cuts.count() > 250 and max(per) <= decontaminate.WINDOW
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.contamination(d, b).collect()}
    assert got == brute(docs, items)


def test_defined_cases(spark, messy, nothing):
    b = spark.createDataFrame([(1, None), (None, "quick brown fox"), (2, ""), (3, "zebra")], "item_id long, text string")
    rows = decontaminate.contamination(messy, b).collect()
    assert len(rows) == messy.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[1]["item_ids"] == ["null"] and by[1]["n_hit"] == 3 and by[2]["contaminated"]
    assert by[3]["n_words"] == 0 and by[3]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    assert decontaminate.contamination(nothing, b).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(messy, none).where("contaminated").count() == 0
    assert decontaminate.drop_contaminated(messy, b).columns == messy.columns


def test_rows_that_share_an_id_are_dropped_one_by_one(spark):
    rows = [(i, t, "en", "s", 0) for i in (None, 5) for t in ("a quick brown fox", "a clean text", "a clean text", None)]
    b = spark.createDataFrame([(1, "quick brown fox")], "item_id long, text string")
    kept = [(r["doc_id"], r["text"]) for r in decontaminate.drop_contaminated(spark.createDataFrame(rows, DOCS), b).collect()]
    assert sorted(map(str, kept)) == sorted(str(r[:2]) for r in rows if r[1] != "a quick brown fox")


def test_no_python_in_the_plan(spark, messy):
    b = spark.createDataFrame([(1, "quick brown fox")], "item_id long, text string")
    plan = decontaminate.contamination(messy, b)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))
