import pytest
from pyspark.sql import functions as F

from caselink.operators import features, graph, links, patterns, privacy, report, similarity
from caselink.sources import lookups, synthetic, tables


def test_upsert_remove_and_tag(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int")
    assert sorted(map(tuple, lookups.upsert(t, new, "k").collect())) == [("a", 1), ("b", 9), ("c", 3)]
    assert sorted(map(tuple, lookups.remove(t, new, "k").collect())) == [("a", 1)]
    nodes = spark.createDataFrame([("a", {"x": "1"}), ("b", {})], "node_id string, props map<string,string>")
    got = {r["node_id"]: r["props"] for r in lookups.tag(nodes, spark.createDataFrame([("a",)], "node_id string"), x="2", set="demo").collect()}
    assert got == {"a": {"x": "2", "set": "demo"}, "b": {}}


def test_tables_and_graph_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("s1", "303", "t", None, "BNS")], "section_id string, code string, title string, description string, law_name string")
    tables.write_table(rows, str(tmp_path), "legal_sections")
    assert tables.read_table(spark, str(tmp_path), "legal_sections").collect() == rows.collect()
    nodes = spark.createDataFrame([("a", "Case", "S", {"k": "v"}), ("p", "Person", None, {})], "node_id string, label string, station_id string, props map<string,string>")
    edges = spark.createDataFrame([("a:HAS_PERSON:p", "a", "p", "HAS_PERSON", 1.0)], "edge_id string, src string, dst string, rel_type string, weight double")
    tables.write_graph(nodes, edges, str(tmp_path / "g"))
    n, e = tables.read_graph(spark, str(tmp_path / "g"))
    assert sorted(map(tuple, n.select("node_id", "label").collect())) == [("a", "Case"), ("p", "Person")] and e.collect() == edges.collect()
    plan = e.where("rel_type = 'HAS_PHONE'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan or "LocalTableScan" in plan
    assert tables.probe(spark) == "UP"
    assert tables.scrub("bad hunter2 with sk-abcdefgh123 and Bearer xyz", ("hunter2", "")) == "bad *** with *** and ***"


def test_graph_constraints(spark):
    nodes = spark.createDataFrame([("a", "Case", None, {}), ("a", "Case", None, {}), ("z", "Robot", None, {})], "node_id string, label string, station_id string, props map<string,string>")
    edges = spark.createDataFrame([("e1", "a", "q", "HAS_PERSON", 1.0), ("e2", "z", "a", "RELATED_TO", 1.0), ("e3", "a", "z", "KNOWS", 1.0)], "edge_id string, src string, dst string, rel_type string, weight double")
    got = sorted((r["rule"], r["id"]) for r in graph.violations(nodes, edges).collect())
    assert got == [("RELATED_TO is not canonical", "e2"), ("edge without an end", "e1"), ("node id is not unique", "a"), ("unknown edge type", "e3"), ("unknown label or no id", "z")]


def test_synthetic_tables(spark):
    t = synthetic.tables(spark, cases=60)
    assert {k: v.count() for k, v in t.items()} == {"cases": 60, "persons": 220, "vehicles": 140, "phones": 180, "locations": 100, "evidences": 60, "case_persons": 60, "case_vehicles": 60, "case_phones": 60}
    assert t["cases"].exceptAll(synthetic.tables(spark, cases=60)["cases"]).count() == 0
    assert t["cases"].exceptAll(synthetic.tables(spark, cases=60, seed=1)["cases"]).count() > 0
    names = t["case_persons"].join(t["persons"], "person_id")
    assert patterns.recurring(t["cases"], names, "person_id", "Person", "name").count() > 0
    assert links.quick_links(t["case_persons"], t["case_vehicles"], t["case_phones"]).count() > 0


def test_synthetic_histories(spark):
    t = synthetic.tables(spark, cases=60)
    h = synthetic.histories(t)
    per = h["investigation_events"].groupBy("case_id").count().collect()
    assert len(per) == 60 and {r["count"] for r in per} == {1, 2, 3, 4}
    early = h["investigation_events"].join(t["cases"], "case_id").where("event_date <= registration_date").count()
    assert early == 0 and h["case_sections"].where("section is null").count() == 0 and h["case_sections"].count() == 60


def test_planted_clusters_are_found(spark):
    t = synthetic.planted(synthetic.tables(spark, cases=40), clusters=4)
    truth = {}
    for r in t["truth"].collect():
        truth.setdefault(r["cluster_id"], set()).add(r["case_id"])
    assert sorted(map(len, truth.values())) == [3, 3, 3, 3]
    found = {(r["id1"], r["id2"]) for r in links.quick_links(t["case_persons"], t["case_vehicles"], t["case_phones"]).collect()}
    for members in truth.values():
        assert {(a, b) for a in members for b in members if a < b} <= found
    own = {c: k for k, members in truth.items() for c in members}
    assert all(own.get(a) == own.get(b) for a, b in found if a in own or b in own)
    stations = t["truth"].join(t["cases"], "case_id").groupBy("cluster_id").agg(F.count_distinct("station_id").alias("n")).collect()
    assert {r["n"] for r in stations} == {3}
    p = t["persons"]
    kin = t["people"].join(p, "person_id").join(p.select(F.col("person_id").alias("suspect_id"), F.col("name").alias("its"), F.col("date_of_birth").alias("born")), "suspect_id")
    same = {(r["kind"], r["name"] == r["its"], r["date_of_birth"] == r["born"]) for r in kin.collect()}
    assert same == {("VARIANT", False, True), ("DECOY", True, False)}
    assert t["people"].join(t["case_persons"], "person_id").count() == 0


def test_jdbc_reads_ranges_of_a_key(spark):
    url = "jdbc:derby:memory:cases;create=true"
    rows = spark.createDataFrame([(i, i * i) for i in range(1, 41)], "k int, v int")
    rows.write.jdbc(url, "numbers", mode="overwrite", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    got = tables.read_jdbc(spark, url, "numbers", "k", 1, 40, parts=4, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert got.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))


def test_nested_records(spark):
    schema = "id string, fir_number string, legal_sections array<string>, persons array<struct<id:string,name:string>>, phones array<struct<id:string,normalized_number:string>>, location_id string"
    rows = [("c1", "F1", ["BNS 303", "66D"], [("p1", "Ann")], [("t1", "9861105000")], None), ("c2", "F2", None, None, None, None)]
    parts = features.split_records(spark.createDataFrame(rows, schema))
    assert {k: v.count() for k, v in parts.items()} == {"cases": 2, "sections": 2, "persons": 1, "vehicles": 0, "phones": 1, "evidences": 0, "locations": 0}
    with pytest.raises(Exception, match="FIR"):
        features.split_records(spark.createDataFrame([("c", None, None, None, None, None)], schema))["persons"].sparkSession and features.split_records(spark.createDataFrame([("c", None, None, None, None, None)], schema))["cases"].collect()


def test_eight_signals(spark):
    f = spark.createDataFrame(
        [("a", "X", "T", None, None, None, "", False, None, None, [], [], [], []), ("b", "X", "T", None, None, None, "", False, None, None, [], [], [], [])],
        "case_id string, crime_type string, crime_category string, district string, registration_date date, time_bucket string, place string, has_place boolean, latitude double, longitude double, persons array<string>, plates array<string>, numbers array<string>, sections array<string>",
    )
    pairs = spark.createDataFrame([("a", "b")], "id1 string, id2 string")
    extra = spark.createDataFrame([("a", "b", 0.8, "MATCH")], "id1 string, id2 string, score double, status string")
    (r,) = similarity.compare(pairs, f, persons=extra, methods=extra).collect()
    assert [s["name"] for s in r["signals"]] == ["MODUS_OPERANDI", "CRIME_CATEGORY", "LEGAL_SECTIONS", "GEOGRAPHIC", "TEMPORAL", "VEHICLE_OVERLAP", "PHONE_OVERLAP", "PERSON_OVERLAP"]
    assert r["score"] == round((0.25 * 0.8 + 0.15 + 0.15 * 0.8) / 0.55, 4)
    kinds = {x["rel_type"] for x in links.trait_signals(similarity.compare(pairs, f, methods=extra)).collect()}
    assert kinds == {"SIMILAR_MODUS_OPERANDI", "SIMILAR_CRIME_CATEGORY"}


def test_entity_aliases_and_restored_report(spark):
    cases = spark.createDataFrame([("c1", "F1"), ("c2", "F2")], "case_id string, fir_number string")
    people = spark.createDataFrame([("c1", "p1", "Ann"), ("c2", "p2", "Bo"), ("c2", "p3", None)], "case_id string, id string, name string")
    got = {r["original"]: (r["alias"], r["shown"]) for r in privacy.entity_aliases(cases, Person=people).collect()}
    assert got["c1"] == ("Case-A", "c1") and got["F1"][0] == "Case-B" and got["c2"][0] == "Case-C"
    assert got["p1"] == got["Ann"] == ("Person-A", "Ann") and got["p2"] == got["Bo"] == ("Person-B", "Bo") and got["p3"] == ("Person-C", "p3")
    said = spark.createDataFrame([("e1", "Person-A and Person-B in Case-C")], "explanation_id string, statement string")
    aliases = privacy.entity_aliases(cases, Person=people).select("alias", F.col("shown").alias("original")).distinct()
    assert report.restored(said, aliases).first()["statement"] == "Ann and Bo in c2"
    assert report.empty(spark).first()["sentences"] == 0
