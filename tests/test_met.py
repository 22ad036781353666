"""Pairs judged where they are met, against the same by rows of pairs."""

from pyspark.sql import functions as F

from caselink.operators import blocking, features, graph, links, resolve, similarity
from caselink.plans import queries

SF = "/root/testdata/sf0.001"


def _tables(spark):
    day = "2024-01-0"
    cases = spark.createDataFrame(
        [(f"C{i}", f"F{i}", "S", t, c, "d", f"{day}{i}", i, f"L{i % 2}", m) for i, (t, c, m) in enumerate([("theft", "A", "broke the window lock"), ("theft", "A", "broke window lock at night"), ("fraud", "A", None), ("theft", "B", "broke lock")], 1)],
        "case_id string, fir_number string, station_id string, crime_type string, crime_category string, district string, registration_date string, incident_hour int, location_id string, method string",
    ).withColumn("registration_date", F.to_date("registration_date"))
    # C9 is no case; P1 and P2 have one name and dates that differ, P3 and P4 one name and a date unknown; P5 has no name.
    cp = spark.createDataFrame([("C1", "P1"), ("C1", "P3"), ("C2", "P1"), ("C2", "P2"), ("C3", "P2"), ("C3", "P4"), ("C4", "P5"), ("C1", "P5"), ("C9", "P1"), ("C9", None)], "case_id string, person_id string")
    persons = spark.createDataFrame([("P1", "Amit Das", "1990-01-01"), ("P2", "Shri Amit Das", "1991-01-01"), ("P3", "Rekha Lal", None), ("P4", "rekha lal", "1980-05-05"), ("P5", "", None)], "person_id string, name string, date_of_birth string")
    plates = spark.createDataFrame([("C1", "OD01AB0001"), ("C2", "od01-ab0001"), ("C1", "OD01AB0002"), ("C2", "OD01AB0002"), ("C3", "OD01AB0003")], "case_id string, registration_number string")
    numbers = spark.createDataFrame([("C1", "9000000001"), ("C3", "09000000001")], "case_id string, number string")
    sections = spark.createDataFrame([("C1", "ipc_101"), ("C2", "ipc_101"), ("C2", "ipc_102"), ("C4", "ipc_101")], "case_id string, section string")
    places = spark.createDataFrame([("L0", "Sq 1", None, 20.0, 85.0), ("L1", "Sq 2", None, 20.01, 85.0)], "location_id string, locality string, address string, latitude double, longitude double")
    return features.extract(cases, cp, plates, numbers, sections, places, in_turn=True), cp, persons


def _rows(df):
    return sorted(tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect())


def test_met_pairs_are_judged_as_rows_of_pairs(spark):
    f, cp, persons = _tables(spark)
    named = blocking.pairs(blocking.keys(persons, "person_id", {"N": F.lower(F.regexp_replace("name", "Shri ", ""))}))
    judged = resolve.resolve_persons(named, persons).select("id1", "id2", "decision", "same_name", "same_sound")
    both = judged.unionByName(judged.withColumns({"id1": F.col("id2"), "id2": F.col("id1")}))
    a, b = cp.select(F.col("case_id").alias("id1"), F.col("person_id").alias("x")), cp.select(F.col("case_id").alias("id2"), F.col("person_id").alias("y"))
    other = a.join(both.withColumnsRenamed({"id1": "x", "id2": "y"}), "x").join(b, "y").where("id1 < id2").select("id1", "id2", "decision", "same_name", "same_sound")
    own = links.shared(cp, "person_id").select("id1", "id2", F.lit("HIGH_CONFIDENCE_MATCH").alias("decision"), F.lit(True).alias("same_name"), F.lit(True).alias("same_sound"))
    people = graph.union(own, other)
    pairs = people.select("id1", "id2").distinct()
    methods = queries._methods(pairs, f)
    met = similarity.met_by_name(similarity.people_of_cases(cp, persons), f, methods)
    assert _rows(met.select("id1", "id2")) == _rows(pairs)  # each pair once
    assert _rows(links.confidence_met(met)) == _rows(links.confidence(links.analyze_pairs(pairs, f, people, methods)))
    assert _rows(similarity.compare_met(met)) == _rows(similarity.compare(pairs, f, similarity.person_overlap(pairs, f, judged), methods))


def test_no_pair_is_shuffled(spark):
    for name in ("case_similarity", "pair_confidence"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
        meets = next(i for i, line in enumerate(plan) if "Join" in line and "key" in line)
        assert not [line for line in plan[:meets] if "Exchange" in line], name
