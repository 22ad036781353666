"""Explanations of links, of which only those that share an id are shuffled."""

from pyspark.sql import functions as F

from caselink.operators import explain
from caselink.plans import queries

SF = "/root/testdata/sf0.001"


def test_pairs_that_share_an_id_are_found(spark, monkeypatch):
    monkeypatch.setattr(explain, "link_id", lambda key: F.concat(F.lit("exp:relationship:0000000"), F.when(key.startswith("C"), "fffff").otherwise(F.substring(F.sha2(key, 256), 1, 5))))
    pairs = spark.createDataFrame([("C1", "C2"), ("C1", "C3"), ("D1", "D2")], "id1 string, id2 string")
    assert sorted(map(tuple, explain.ids_met_again(pairs).collect())) == [("C1", "C2"), ("C1", "C3")]
    assert explain.ids_met_again(pairs.where("id2 <> 'C3'")).count() == 0


def test_one_link_of_an_id_stays(spark):
    row = lambda i, subject, title: (i, subject, "CasePair", title, "seen", "told", ["a"], [], ["s"], 0.5, ["l"])
    schema = "explanation_id string, subject_id string, subject_type string, title string, observation string, explanation string, case_ids array<string>, entity_ids array<string>, signals array<string>, weight double, limitations array<string>"
    told = spark.createDataFrame([row("e1", "p1", "b"), row("e1", "p2", "a"), row("e2", "p3", "c"), row("e3", "p4", "the culprit")], schema)
    found = explain.union_of_links(told, told.where("explanation_id = 'e1'"))
    assert sorted(map(str, found.collect())) == sorted(map(str, explain.union(told).collect()))
    assert sorted(r["subject_id"] for r in found.collect()) == ["p2", "p3"]


def test_no_explanation_is_shuffled(spark):
    plan = queries.QUERIES["explain_links"](spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
    meets = next(i for i, line in enumerate(plan) if "Join [key" in line)
    assert not [line for line in plan[:meets] if "Exchange hashpartitioning" in line]
    assert not [line for line in plan if "Window" in line]
