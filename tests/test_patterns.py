import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from caselink.operators import explain, graph, patterns

CASE = "case_id string, station_id string, district string, crime_category string, crime_type string, registration_date date"


def cases(spark, *rows):
    return spark.createDataFrame([(i, s, "Khurda", "THEFT", "HOUSE", d) for i, s, d in rows], CASE)


def four(spark):
    day = dt.date(2024, 8, 1)
    c = cases(spark, ("A", "S1", day), ("B", "S2", day + dt.timedelta(5)), ("C", "S3", day + dt.timedelta(9)))
    return c.unionByName(spark.createDataFrame([("D", "S1", "Puri", "FRAUD", "CARD", dt.date(2020, 1, 1))], CASE))


def test_detectors(spark):
    c = four(spark)
    people = spark.createDataFrame([("A", "P", "Ann"), ("B", "P", "Ann"), ("C", "P", "Anne"), ("C", "P", "Anne"), ("D", "Q", "Bo")], "case_id string, person_id string, name string")
    (r,) = patterns.recurring(c, people, "person_id", "Person", "name", members=True).collect()
    assert (r["occurrence_count"], r["stations"], r["strength"], r["case_ids"], r["entity_id"]) == (3, 3, 0.75, ["A", "B", "C"], "P")
    assert r["signals"] == ["Shared Person Entity: Ann (P)"]
    text = "RECURRING_ENTITY:A|B|C:P:Shared Person Entity: Ann (P)"
    assert r["pattern_id"] == "pat:recurring_entity:" + hashlib.sha256(text.encode()).hexdigest()[:12]
    evidence = spark.createDataFrame([("A", "CCTV"), ("B", "MOBILE"), ("D", "WEAPON")], "case_id string, evidence_type string")
    (r,) = patterns.modus_operandi(c, evidence, members=True).collect()
    assert r["signals"] == ["Crime Category: THEFT", "Crime Type: HOUSE", "Evidence Type: CCTV", "Evidence Type: MOBILE"] and r["strength"] == 0.6
    (r,) = patterns.cross_station(c, members=True).collect()
    assert (r["occurrence_count"], r["stations"], r["strength"]) == (4, 3, 0.75) and "(S1, S2, S3)" in r["description"]
    (r,) = patterns.characteristics(c, members=True).collect()
    assert r["title"] == "Structured Case Characteristic Combination: HOUSE in Khurda" and r["case_ids"] == ["A", "B", "C"]
    assert patterns.cross_station(c.where("station_id = 'S1'")).count() == 0


def test_temporal_window_is_inclusive(spark):
    c = cases(spark, ("a", "S1", dt.date(2024, 8, 1)), ("b", "S1", dt.date(2024, 8, 31)), ("c", "S2", dt.date(2024, 11, 10)), ("d", "S2", dt.date(2024, 11, 15)), ("e", None, None))
    rows = patterns.temporal(c, members=True).collect()
    assert sorted(r["case_ids"] for r in rows) == [["a", "b"], ["c", "d"]]
    assert {r["description"] for r in rows} >= {"Identified 2 cases registered within a 30-day temporal window between 2024-08-01 and 2024-08-31."}


def test_temporal_forms_agree(spark):
    rng = random.Random(1)
    rows = [(f"c{i:03d}", f"S{i % 3}", dt.date(2024, 1, 1) + dt.timedelta(rng.randrange(90))) for i in range(120)]
    c = cases(spark, *rows)
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    want = {}
    for i, (name, _, day) in enumerate(order):
        inside = [r for r in order[i:] if (r[2] - day).days <= 14]
        want[name] = (len(inside), max(r[2] for r in inside))
    assert {r["case_id"]: (r["n"], r["end_day"]) for r in patterns.temporal_sizes(c, 14).collect()} == want
    small = {(r["occurrence_count"], r["title"], r["description"]) for r in patterns.temporal(c, 14).collect()}
    full = {(r["occurrence_count"], r["title"], r["description"]) for r in patterns.temporal(c, 14, members=True).collect()}
    assert small == full


def test_finalize(spark):
    c = four(spark).unionByName(four(spark))
    found = patterns.finalize(graph.union(patterns.characteristics(c), patterns.characteristics(c), patterns.temporal(c)))
    ids = [r["pattern_id"] for r in found.collect()]
    assert len(ids) == len(set(ids)) and found.count() >= 2
    assert {r["pattern_type"]: r["n"] for r in patterns.histogram(found).collect()}["CASE_CHARACTERISTIC"] == 1
    assert patterns.in_order(found).first()["occurrence_count"] >= 3


def test_language_guard(spark):
    c = spark.createDataFrame([("A", "S", "K", "THEFT", "GANG THEFT", None), ("B", "S", "K", "THEFT", "GANG THEFT", None)], CASE)
    rows = patterns.characteristics(c)
    assert rows.first()["is_blocked"] and patterns.finalize(rows).count() == 0
    with pytest.raises(Exception, match="forbidden"):
        patterns.unblocked(rows, strict=True).collect()


def test_explanations_of_patterns_and_links(spark):
    c = four(spark)
    told = explain.of_patterns(patterns.finalize(patterns.characteristics(c, members=True))).first()
    assert told["subject_type"] == "Case" and told["subject_id"] == "A" and len(told["limitations"]) == 2
    link = spark.createDataFrame([("a", "b", "a:b:RELATED_TO", 0.3, "LOW", ["LEGAL"], 0, 1, 0, False, True)], "id1 string, id2 string, pair_key string, score double, level string, families array<string>, high int, possible int, weak int, direct boolean, cautious boolean")
    r = explain.union(explain.of_links(link), explain.of_links(link)).collect()
    assert len(r) == 1 and len(r[0]["limitations"]) == 4 and r[0]["subject_type"] == "CasePair"
    assert explain.union(explain.of_links(link), subject="none").count() == 0
    bad = explain.of_links(link).withColumn("title", F.lit("The culprit"))
    assert explain.union(bad).count() == 0
    assert explain.in_order(explain.of_links(link)).count() == 1
