"""Blocking, resolution, similarity and links."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from caselink.operators import blocking, features, links, resolve, similarity

PERSON = "person_id string, name string, date_of_birth string, phone string, address string, vehicles array<string>"


def people(spark, *rows):
    return spark.createDataFrame([(*r, *[None] * (6 - len(r))) for r in rows], PERSON)


def test_block_persons(spark):
    p = people(spark, ("p1", "Rahul Kumar", "1990-01-01"), ("p2", "Shri Rahul Kumar", "1990-05-05"), ("p3", "Sunita Das", "1985-01-01"), ("p4", "Raul Kumar", None), (None, "Rahul Kumar", None))
    got = {(r["id1"], r["id2"]): r["signals"] for r in blocking.block_persons(p).collect()}
    assert got[("p1", "p2")] == ["DOB_YEAR", "EXACT_NAME", "PHONETIC_NAME", "SURNAME"]
    assert ("p1", "p3") not in got and got[("p1", "p4")] == ["PHONETIC_NAME", "SURNAME"]
    assert all(a < b for a, b in got)


def test_block_methods_drops_large_buckets(spark):
    rows = [(f"c{i}", "theft", "common lock broken") for i in range(12)] + [("d1", "fraud", "rare forged cheque"), ("d2", "scam", "forged letter")]
    df = spark.createDataFrame(rows, "case_id string, crime_category string, description string")
    got = {(r["id1"], r["id2"]): r["signals"] for r in blocking.block_methods(df, most=10).collect()}
    assert got == {("d1", "d2"): ["MO_KEYWORD_TOKEN"]}


def test_block_locations_skips_rows_without_text(spark):
    df = spark.createDataFrame([("l1", "Master Sq", "Khurda"), ("l2", "master square", "khurda "), ("l3", None, "Khurda"), ("l4", " ", "Khurda")], "location_id string, locality string, district string")
    assert [(r["id1"], r["id2"], r["signals"]) for r in blocking.block_locations(df).collect()] == [("l1", "l2", ["DISTRICT", "NORMALIZED_LOCALITY"])]


def judge(spark, a, b):
    p = people(spark, ("a", *a), ("b", *b))
    (r,) = resolve.resolve_persons(spark.createDataFrame([("a", "b")], "id1 string, id2 string"), p).collect()
    return r


def test_resolution_bands(spark):
    assert judge(spark, ("Rahul Kumar", "1990-01-01", "9861105000"), ("Shri Rahul Kumar", "1990-01-01", "+91 9861105000"))["decision"] == "HIGH_CONFIDENCE_MATCH"
    r = judge(spark, ("Rahul Kumar", "1990-01-01"), ("Rahul Kumar", "1980-01-01"))
    assert (r["score"], r["decision"]) == (0.4423, "NO_MATCH")
    r = judge(spark, ("Rahul Kumar",), ("Rahul Kumar Jena",))
    assert (r["score"], r["decision"]) == (0.5667, "POSSIBLE_MATCH")
    r = judge(spark, ("Rahul Kumar", "1990-01-01", "9861105000"), ("Rahul Kumar", "1980-01-01", "9861105999"))
    assert r["decision"] == "NO_MATCH" and sorted(r["conflicting"]) == ["DOB_MATCH", "PHONE_MATCH"]
    assert judge(spark, (None,), (None,))["score"] == 0.0
    r = judge(spark, ("R Kumar", None, None, None, ["OD02AB1234"]), ("Rahul Kumar", None, None, None, ["od-02-ab-1234"]))
    assert "VEHICLE_MATCH" in r["matching"] and "PHONETIC_MATCH" in r["matching"]


def test_missing_candidates_are_dropped(spark):
    p = people(spark, ("a", "Rahul"))
    assert resolve.resolve_persons(spark.createDataFrame([("a", "zz")], "id1 string, id2 string"), p).count() == 0


FEATURES = (
    "case_id string, crime_type string, crime_category string, district string, registration_date date, time_bucket string, place string, has_place boolean, latitude double, longitude double, persons array<string>, plates array<string>, numbers array<string>, sections array<string>"
)


def case(case_id, **kw):
    base = {"crime_type": "HOUSE", "crime_category": "THEFT", "district": "Khurda", "registration_date": dt.date(2024, 1, 10), "time_bucket": "NIGHT", "place": "", "has_place": False, "latitude": None, "longitude": None, "persons": [], "plates": [], "numbers": [], "sections": []}
    base |= kw
    return (case_id, *base.values())


def compared(spark, a, b):
    df = spark.createDataFrame([case("a", **a), case("b", **b)], FEATURES)
    (r,) = similarity.compare(spark.createDataFrame([("a", "b")], "id1 string, id2 string"), df).collect()
    return {s["name"]: (s["score"], s["status"]) for s in r["signals"]}, r


def test_signals(spark):
    s, _ = compared(spark, {"sections": ["BNS_303"]}, {"sections": ["IPC_303"], "crime_type": "CAR"})
    assert s["CRIME_CATEGORY"] == (0.85, "MATCH") and s["LEGAL_SECTIONS"] == (0.0, "MISMATCH") and s["GEOGRAPHIC"] == (0.40, "PARTIAL") and s["TEMPORAL"] == (1.0, "MATCH")
    assert s["VEHICLE_OVERLAP"] == (0.0, "UNAVAILABLE")
    s, _ = compared(spark, {"latitude": 20.27, "longitude": 85.84}, {"latitude": 20.2704, "longitude": 85.8402})
    assert s["GEOGRAPHIC"][1] == "MATCH" and s["GEOGRAPHIC"][0] > 0.99
    s, _ = compared(spark, {"latitude": 999.0, "longitude": -500.0, "place": "master canteen square", "has_place": True}, {"place": "master canteen square", "has_place": True})
    assert s["GEOGRAPHIC"] == (0.75, "PARTIAL")
    s, _ = compared(spark, {"place": "khurda"}, {"place": "khurda"})  # a district alone is no place
    assert s["GEOGRAPHIC"] == (0.40, "PARTIAL")
    s, _ = compared(spark, {"place": "khurda square x", "has_place": True}, {"place": "puri square y", "has_place": True, "district": "Puri"})
    assert s["GEOGRAPHIC"] == (0.0, "MISMATCH")
    s, _ = compared(spark, {}, {"district": "Puri"})
    assert s["GEOGRAPHIC"] == (0.0, "MISMATCH")
    s, _ = compared(spark, {"district": None}, {})
    assert s["GEOGRAPHIC"] == (0.0, "UNAVAILABLE")
    s, _ = compared(spark, {"numbers": ["1"], "plates": ["A"]}, {"numbers": ["1", "2"], "plates": ["B"]})
    assert s["PHONE_OVERLAP"] == (1.0, "MATCH") and s["VEHICLE_OVERLAP"] == (0.0, "MISMATCH")
    s, _ = compared(spark, {"registration_date": None}, {})
    assert s["TEMPORAL"] == (0.0, "UNAVAILABLE")


def test_self_and_insufficient(spark):
    df = spark.createDataFrame([case("a")], FEATURES)
    (r,) = similarity.compare(spark.createDataFrame([("a", "a")], "id1 string, id2 string"), df).collect()
    assert (r["score"], r["level"]) == (1.0, "SELF")
    _, r = compared(spark, {"crime_category": None, "district": None, "registration_date": None}, {"numbers": ["1"]})
    assert (r["score"], r["level"]) == (0.0, "INSUFFICIENT_DATA")


def test_cosine_and_method(spark):
    texts = spark.createDataFrame([("a", "broke the lock"), ("b", "broke the lock"), ("c", "sold fake notes"), ("d", None), ("e", "broke a window")], "case_id string, description string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d"), ("a", "e")], "id1 string, id2 string")
    got = {r["id2"]: r["cosine"] for r in similarity.cosine(pairs, texts).collect()}
    from math import log

    w = 1 + log(1.5)
    assert got["b"] == 1.0 and got["c"] == got["d"] == 0.0 and got["e"] == round(1 / ((1 + 2 * w * w) ** 0.5 * (1 + 2 * w * w) ** 0.5), 4)
    m = {r["id2"]: (r["score"], r["status"]) for r in similarity.method_similarity(pairs, texts).collect()}
    assert m["b"] == (0.9, "MATCH") and m["c"] == (0.0, "MISMATCH") and m["d"] == (0.0, "UNAVAILABLE")


@pytest.mark.parametrize(("own", "factor"), [((1, 1), 1.0), ((1, 0), 0.95), ((0, 0), 0.90)])
def test_dedicated_method_texts_count_more(spark, own, factor):
    name = {1: "DEDICATED_MO", 0: "DESCRIPTION_DERIVED"}
    texts = spark.createDataFrame([("a", "broke lock", name[own[0]]), ("b", "broke lock", name[own[1]])], "case_id string, description string, source string")
    (r,) = similarity.method_similarity(spark.createDataFrame([("a", "b")], "id1 string, id2 string"), texts, source="source").collect()
    assert r["score"] == factor


def test_features_need_an_id(spark):
    empty = lambda s: spark.createDataFrame([], s)
    cases = spark.createDataFrame([("c1", " ", "L1")], "case_id string, fir_number string, location_id string")
    for c in ("station_id", "crime_type", "crime_category", "district"):
        cases = cases.withColumn(c, F.lit(None).cast("string"))
    cases = cases.withColumn("registration_date", F.lit(None).cast("date")).withColumn("incident_hour", F.lit(None).cast("int"))
    f = features.extract(cases, empty("case_id string, person_id string"), empty("case_id string, registration_number string"), empty("case_id string, number string"), empty("case_id string, section string"), empty("location_id string, locality string, latitude double, longitude double"))
    with pytest.raises(Exception, match="FIR"):
        f.collect()


def scored(spark, *signals):
    df = spark.createDataFrame([("a", "b", t, s, c, u) for t, s, c, u in signals], "id1 string, id2 string, rel_type string, score double, certainty string, unverified boolean")
    (r,) = links.confidence(df).collect()
    return r["score"], r["level"], r["families"]


def test_confidence(spark):
    exact, weak, ctx = "EXACT_ATTRIBUTE_MATCH", "WEAK_UNVERIFIED", "CONTEXTUAL"
    assert scored(spark, ("SHARED_PHONE", 1.0, exact, False)) == (0.63, "MODERATE", ["CONTACT"])
    assert scored(spark, ("SHARED_VEHICLE", 1.0, exact, False))[:2] == (0.595, "MODERATE")
    s = scored(spark, ("SIMILAR_CRIME_CATEGORY", 0.85, ctx, False), ("SIMILAR_LEGAL_SECTIONS", 1.0, ctx, False))
    assert abs(s[0] - 0.34375) < 1e-4 and s[1] == "LOW"
    many = [("SIMILAR_CRIME_CATEGORY", 1.0, ctx, False), ("SIMILAR_LEGAL_SECTIONS", 1.0, ctx, False), ("TEMPORAL_PROXIMITY", 1.0, ctx, False), ("SIMILAR_MODUS_OPERANDI", 1.0, ctx, False)]
    assert scored(spark, *many)[0] == 0.45
    assert scored(spark, ("POSSIBLE_PERSON_RELATIONSHIP", 0.35, weak, True))[0] == 0.0103  # 0.01025: halves round up
    full = [("SHARED_HIGH_CONFIDENCE_PERSON", 1.0, "HIGH_CONFIDENCE_ENTITY", False), ("SHARED_PHONE", 1.0, exact, False), ("SHARED_VEHICLE", 1.0, exact, False), ("SHARED_LOCATION", 1.0, exact, False)]
    assert scored(spark, *full)[:2] == (1.0, "VERY_HIGH")
    two = [("SHARED_PHONE", 1.0, exact, False), ("SHARED_PHONE", 1.0, exact, False)]
    assert scored(spark, *two)[0] == 0.7875


def test_chain_invents_no_link(spark):
    """A-B share a phone, B-C a vehicle; A and C are not linked."""
    phones = spark.createDataFrame([("A", "1"), ("B", "1")], "case_id string, phone_id string")
    plates = spark.createDataFrame([("B", "v"), ("C", "v")], "case_id string, vehicle_id string")
    none = spark.createDataFrame([], "case_id string, person_id string")
    got = {(r["id1"], r["id2"]): (r["confidence"], r["family"]) for r in links.quick_links(none, plates, phones).collect()}
    assert got == {("A", "B"): (0.70, "CONTACT"), ("B", "C"): (0.70, "VEHICLE")}


def test_person_overlap_prefers_name_only_less(spark):
    f = spark.createDataFrame([("a", ["p"]), ("b", ["q"]), ("c", ["p"])], "case_id string, persons array<string>")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "id1 string, id2 string")
    resolved = spark.createDataFrame([("p", "q", "NO_MATCH", True, True)], "id1 string, id2 string, decision string, same_name boolean, same_sound boolean")
    got = {r["id2"]: (r["score"], r["status"]) for r in similarity.person_overlap(pairs, f, resolved).collect()}
    assert got == {"b": (0.35, "PARTIAL"), "c": (1.0, "MATCH")}


def test_all_signals_of_a_pair(spark):
    """Every signal type at once, by hand; locations are correlational, and a case has no signal with itself."""
    near = {"latitude": 20.27, "longitude": 85.84, "sections": ["BNS_303"], "numbers": ["+911", "+912"], "plates": ["A", "B"]}
    f = spark.createDataFrame([case("a", **near), case("b", **near)], FEATURES)
    people = spark.createDataFrame([("a", "b", "HIGH_CONFIDENCE_MATCH", True, True), ("a", "b", "POSSIBLE_MATCH", False, True), ("a", "b", "NO_MATCH", False, True), ("a", "b", "NO_MATCH", False, False)], "id1 string, id2 string, decision string, same_name boolean, same_sound boolean")
    methods = spark.createDataFrame([("a", "b", 0.3, "PARTIAL")], "id1 string, id2 string, score double, status string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "a")], "id1 string, id2 string")
    rows = links.analyze_pairs(pairs, f, people, methods)
    got = sorted((r["rel_type"], r["score"], r["certainty"], r["unverified"]) for r in rows.collect())
    assert got == sorted([
        ("SHARED_HIGH_CONFIDENCE_PERSON", 1.0, "HIGH_CONFIDENCE_ENTITY", False), ("POSSIBLE_PERSON_RELATIONSHIP", 0.70, "POSSIBLE_ENTITY", False), ("POSSIBLE_PERSON_RELATIONSHIP", 0.40, "WEAK_UNVERIFIED", True),
        *[("SHARED_PHONE", 1.0, "EXACT_ATTRIBUTE_MATCH", False)] * 2, *[("SHARED_VEHICLE", 1.0, "EXACT_ATTRIBUTE_MATCH", False)] * 2, ("SHARED_LOCATION", 1.0, "CORRELATIONAL", False),
        ("SIMILAR_MODUS_OPERANDI", 0.3, "INFERRED_PATTERN", False), ("SIMILAR_LEGAL_SECTIONS", 1.0, "CONTEXTUAL", False), ("TEMPORAL_PROXIMITY", 1.0, "CORRELATIONAL", False), ("SIMILAR_CRIME_CATEGORY", 1.0, "CONTEXTUAL", False),
    ])
    (r,) = links.confidence(rows).collect()
    worth = {"person": 1 + 0.25 * (0.45 * 0.7 + 0.45 * 0.4), "contact": 0.9 * 1.25, "vehicle": 0.85 * 1.25, "place": 0.5, "habit": 0.25 + 0.25 * 0.6 * 0.3, "legal": 0.15, "time": 0.35}
    top = max(worth.values())
    assert r["score"] == min(1.0, round(0.7 * top + 0.3 * (sum(worth.values()) - top) + 0.25 + 4 * 0.05, 4)) and r["level"] == "VERY_HIGH" and r["signals"] == 12
    texts = [({"place": "square 1 puri", "has_place": True}, {"place": "square 1 puri", "has_place": True}, [0.75]), ({"place": "puri"}, {"place": "puri"}, [])]
    for x, y, want in texts:
        both = similarity.paired(pairs.where("id2 = 'b'"), spark.createDataFrame([case("a", **x), case("b", **y)], FEATURES))
        assert [r["score"] for r in links.location_signals(both).collect()] == want


def test_rows_of_a_hot_bucket(spark):
    """One row for each id of a bucket says what all pairs of it say."""
    rows = [(f"p{i:02d}", "Rahul Das" if i % 2 else f"Name{i} Un{i}ik", "1980-01-01") for i in range(20)]
    entries = blocking.person_keys(spark.createDataFrame(rows, "person_id string, name string, date_of_birth string"))
    per: dict = {}
    for r in blocking.classes(entries).collect():
        per.setdefault((r["signal"], r["key"]), []).append((r["id"], r["first_id"], r["ids"]))
    made = {(a[0], b[0]) for g in per.values() for a in g for b in g if a[0] < b[0]}
    assert made == {(r["id1"], r["id2"]) for r in blocking.pairs(entries).collect()}
    assert all(f == min(i for i, _, _ in g) and n == len(g) for g in per.values() for _, f, n in g)


def test_features_of_place_method_and_evidence(spark):
    cases = spark.createDataFrame([("c1", "F1", "L1", "cut the lock", "told"), ("c2", "F2", "L2", " ", "told"), ("c3", "F3", None, None, None)], "case_id string, fir_number string, location_id string, method string, description string")
    for c in ("station_id", "crime_type", "crime_category"):
        cases = cases.withColumn(c, F.lit(None).cast("string"))
    cases = cases.withColumn("district", F.lit("Puri")).withColumn("registration_date", F.lit(None).cast("date")).withColumn("incident_hour", F.lit(None).cast("int"))
    places = spark.createDataFrame([("L1", "Master Sq", "Plot 7", None, None), ("L2", " ", None, 1.0, 2.0)], "location_id string, locality string, address string, latitude double, longitude double")
    empty = lambda s: spark.createDataFrame([], s)
    seen = spark.createDataFrame([("c1", "CCTV"), ("c1", "CCTV"), ("c1", "WEAPON")], "case_id string, evidence_type string")
    f = features.extract(cases, empty("case_id string, person_id string"), empty("case_id string, registration_number string"), empty("case_id string, number string"), empty("case_id string, section string"), places, seen)
    got = {r["case_id"]: (r["place"], r["has_place"], r["method"], r["method_source"], r["evidence"]) for r in f.collect()}
    assert got == {"c1": ("master square plot 7 puri", True, "cut the lock", "DEDICATED_MO", ["CCTV", "WEAPON"]), "c2": ("puri", False, "told", "DESCRIPTION_DERIVED", []), "c3": ("puri", False, None, "UNAVAILABLE", [])}


def test_pairs_once_are_all_pairs(spark):
    """Ids of several keys of a signal as well: the pairs and signals of the plain join, each once."""
    rows = [(s, f"k{(i * m) % n}", f"i{i}") for i in range(60) for s, m, n in (("X", 1, 7), ("X", 3, 11), ("Y", 1, 5), ("Z", 2, 23))]
    entries = spark.createDataFrame(rows, "signal string, key string, id string").distinct()
    told = lambda df: sorted((r["id1"], r["id2"], tuple(r["signals"])) for r in df.collect())
    assert told(blocking.pairs_once(entries, ["X", "Y", "Z"])) == told(blocking.pairs(entries))


def test_blocking_shuffles_no_pairs(spark):
    """The last exchanges of the plan are those of the join: nothing is gathered by pair."""
    p = people(spark, ("p1", "Rahul Kumar", "1990-01-01"), ("p2", "Raul Kumar", "1990-05-05"))
    v = spark.createDataFrame([("v1", "OD02AB1234"), ("v2", "OD02AB1235")], "vehicle_id string, registration_number string")
    for made in (blocking.block_persons(p), blocking.block_vehicles(v)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan[: plan.index("Join")], plan


def test_blocked_resolution_shuffles_no_pairs(spark):
    """The same rows as blocking and then resolving, and nothing is exchanged after the join."""
    p = people(spark, ("p1", "Rahul Kumar", "1990-01-01", "9861105000", "Plot 1"), ("p2", "Raul Kumar", "1990-05-05", None, "Plot 1"), ("p3", "Shri Rahul Kumar", None), ("p4", "Sunita Das", "1990-02-02"), ("p4", "Sunita Das", "1985-02-02"))
    made = resolve.resolve_blocked(p)
    told = lambda df: sorted(map(str, df.collect()))
    assert told(made) == told(resolve.resolve_persons(blocking.block_persons(p), p))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Join") > plan.index("ArrowEvalPython") and "Exchange" not in plan[: plan.index("Join")], plan


def test_quick_links_shuffle_no_pairs(spark):
    """Cases that share several persons, vehicles and phones: each pair once, with no exchange after the join."""
    pick = lambda n, *ks: spark.createDataFrame([(f"c{i}", f"x{(i * k) % n}") for i in range(40) for k in ks], "case_id string, v string")
    p, v, t = pick(17, 1, 3), pick(13, 1, 5), pick(5, 1, 2)
    made = links.quick_links(p.withColumnRenamed("v", "person_id"), v.withColumnRenamed("v", "vehicle_id"), t.withColumnRenamed("v", "phone_id"))
    held = [{c: {r["v"] for r in df.collect() if r["case_id"] == c} for c in (f"c{i}" for i in range(40))} for df in (p, v, t)]
    want = {}
    for a in held[0]:
        for b in held[0]:
            same = [bool(h[a] & h[b]) for h in held]
            if a < b and any(same):
                want[a, b] = (0.95 if same[0] and same[1] else 0.85 if same[0] else 0.70, "PERSON_IDENTITY" if same[0] else "VEHICLE" if same[1] else "CONTACT")
    got = made.collect()
    assert len(got) == len(want) and {(r["id1"], r["id2"]): (r["confidence"], r["family"]) for r in got} == want
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Join")], plan


def test_person_overlap_met_equals_that_of_rows(spark):
    """Pairs met in their bucket score as pairs of rows do, for cases of none, one, several, equal and unknown persons."""
    import itertools

    people = [("p1", "Rahul Das", "1980-01-01", "Plot 1, X rd"), ("p2", "Rahul Das", "1980-01-01", "Plot 1, X rd"), ("p3", "Rahul Das", "1999-02-02", None), ("p4", "Raahul Dass", "1980-01-01", "Plot 1, X rd"), ("p5", "Meena Roy", None, "Plot 9"), ("p6", "", "1980-01-01", "")]
    persons = spark.createDataFrame(people, "person_id string, name string, date_of_birth string, address string")
    has = {"c0": [], **{f"c{i}": [f"p{i}"] for i in range(1, 7)}, "c7": ["p1", "p5"], "c8": ["p9"], "c9": ["p3", "p9"], "d1": ["p1"]}
    cp = spark.createDataFrame([(c, p) for c, ps in has.items() for p in ps], "case_id string, person_id string")
    keyed = spark.createDataFrame([(c, "k") for c in has] + [("c1", "j"), ("c2", "j")], "case_id string, value string")
    pairs = spark.createDataFrame([(a, b) for a, b in itertools.combinations(sorted(has), 2)], "id1 string, id2 string")
    named = spark.createDataFrame(list(itertools.combinations([p[0] for p in people], 2)), "id1 string, id2 string")
    f = cp.groupBy("case_id").agg(F.collect_set("person_id").alias("persons"))
    want = sorted(tuple(r) for r in similarity.person_overlap(pairs, f, resolve.resolve_persons(named, persons)).collect())
    found = similarity.person_overlap_met(keyed, cp, persons)
    assert sorted(tuple(r) for r in found.collect()) == want and len({r[2] for r in want}) > 2


def test_met_method_texts_equal_rows_of_pairs(spark):
    """Words of two or three texts, of none, accents, marks, repeats and an empty text; homes in one turn and in many."""
    texts = [(1, "broke the lock with pliers pliers"), (2, "Pliers, lock! entered naïve café"), (10, "pliers café lock don’t dont"), (3, "café naïve naïve window"), (4, None), (5, "window window 日本x fence"), (6, "fence fence fence lock")]
    rows = spark.createDataFrame([(i, t, str(i)) for i, t in texts], "id long, text string, case_id string")
    old = rows.select(F.col("id").alias("case_id"), F.col("text").alias("description"))
    entries = blocking.method_keys(old.withColumn("crime_category", F.lit("x"))).where("signal = 'MO_KEYWORD_TOKEN'")
    pairs = blocking.pairs(entries, 2, 3).select(F.col("id1").cast("long").alias("id1"), F.col("id2").cast("long").alias("id2"))
    want = sorted(map(tuple, similarity.method_similarity(pairs, old).collect()))
    for at_once in (1 << 30, 60):
        packed = similarity.packed(rows)
        met = blocking.rare_pairs(similarity.keywords_of(packed))
        assert sorted(map(tuple, met.collect())) == sorted(map(tuple, pairs.collect()))
        assert sorted(map(tuple, similarity.method_similarity_met(met, packed, at_once).collect())) == want and len(want) > 5
