"""Queries against SQL, the whole analysis, lookups, streams, and the entry module."""

import importlib
import itertools
import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from caselink.plans.analyze import Scope, analyze
from caselink.plans.oracle import SQL
from caselink.plans.queries import QUERIES
from caselink.sources import lookups
from caselink.sources.domain import SCHEMAS, views
from caselink.streaming import timeline

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(float(a), float(b), abs_tol=1e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    cur = db.execute(SQL[name])
    cols = sorted(d[0] for d in cur.description)
    assert sorted(df.columns) == cols
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    key = lambda r: tuple(str(x) for x in r if not isinstance(x, float))
    want = sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=key)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert all(map(same, g, w)), (g, w)


def test_phone_links_are_whole(spark):
    """Every pair of cases that share a person, vehicle or phone, by brute force over the groups."""
    kinds = {}
    for kind, name, key in (("P", "case_persons", "person_id"), ("V", "case_vehicles", "vehicle_id"), ("T", "case_phones", "phone_id")):
        groups = {}
        for r in views(spark, DATA, name)[0].select("case_id", key).distinct().collect():
            groups.setdefault(r[1], []).append(r[0])
        kinds[kind] = {pair for g in groups.values() for pair in itertools.combinations(sorted(g), 2)}
    p, v, t = kinds["P"], kinds["V"], kinds["T"]
    found = QUERIES["quick_links_phones"](spark, DATA)
    got = {r["family"]: r["n"] for r in found.groupBy("family").agg(F.count("*").alias("n")).collect()}
    assert got == {"PERSON_IDENTITY": len(p), "VEHICLE": len(v - p), "CONTACT": len(t - v - p)}
    assert found.where("family = 'CONTACT' and confidence = 0.70 and level = 'HIGH'").count() == len(t - v - p) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_imports_the_optional_package():
    root = Path(entry.__file__).parent
    for p in (root / "caselink").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in [w for line in p.read_text().splitlines() if "import" in line for w in line.replace(".", " ").split()], p
    importlib.reload(entry)


def scope(spark, **k):
    cases, persons, cp, vehicles, cv, ev, phones, ct = views(spark, DATA, "cases", "persons", "case_persons", "vehicles", "case_vehicles", "evidences", "phones", "case_phones")
    return analyze(cases, persons, cp, vehicles, cv, ev, Scope(**k))


def test_analysis_of_a_scope(spark):
    a = scope(spark, max_cases=40, stations=["PS_00", "PS_01", "PS_02", "PS_03"])
    assert a.cases.count() == 40 and a.nodes.where("label = 'Case'").count() == 40
    assert {r["station_id"] for r in a.cases.select("station_id").distinct().collect()} <= {"PS_00", "PS_01", "PS_02", "PS_03"}
    assert a.communities.count() >= 1 and a.patterns.count() >= 1 and a.explanations.count() >= 1 and a.report.count() >= 1
    names = [r["original"] for r in a.aliases.where("kind = 'Person'").collect()]
    said = " ".join(r["statement"] for r in a.report.collect())
    assert names and not any(n in said for n in names)
    assert a.refused.columns == ["explanation_id", "subject_type", "refusal", "length"]
    with pytest.raises(ValueError):
        Scope(max_cases=101)
    with pytest.raises(ValueError):
        Scope(depth=6)


def test_every_scope_is_masked(spark):
    """Without a bound on cases, no raw id, name or plate is left in any text of the report or the explanations."""
    a = scope(spark, stations=["PS_02"], start="1994-01-01", end="1995-12-31")
    assert a.cases.count() > 5
    raw = [r["original"] for r in a.aliases.collect()]
    ids = {r["case_id"] for r in a.cases.collect()} | {r["node_id"] for r in a.nodes.where("label <> 'Case'").collect()}
    assert ids <= set(raw)
    said = " ".join(r["statement"] for r in a.report.collect()) + " ".join(str(tuple(r)) for r in a.masked.select("subject_id", "title", "observation", "explanation", "case_ids", "entity_ids", "signals").collect())
    assert said and not [v for v in raw if v in said and not v.startswith(("community:", "comp:"))]


def test_lookups(spark):
    cases = spark.createDataFrame([("c1", "F1", "S1"), ("c2", "F2", "S2"), ("c3", "F3", None)], "case_id string, fir_number string, station_id string")
    targets = spark.createDataFrame([("F3", 1), ("c1", 2), ("F1", 3), ("zz", 4)], "target string, position int")
    assert [r["case_id"] for r in lookups.gather(cases, targets).collect()] == ["c3", "c1"]
    assert [r["case_id"] for r in lookups.gather(cases, targets, 1).collect()] == ["c3"]
    children = spark.createDataFrame([("c1", "x"), ("c1", "a")], "case_id string, v string")
    got = {r["case_id"]: [c["v"] for c in r["kids"]] for r in lookups.with_children(cases, kids=children).collect()}
    assert got == {"c1": ["a", "x"], "c2": [], "c3": []}
    assert lookups.name_contains(spark.createDataFrame([(1, "a%b"), (2, "ab")], "id int, n string"), "n", "%", "id").count() == 1
    nodes = spark.createDataFrame([("a", "Case", "d1"), ("b", "Person", None)], "node_id string, label string, tag string")
    assert [r[0] for r in lookups.tagged_out(nodes, F.col("tag") == "d1").collect()] == ["b"]
    plan = lookups.by_key(spark.read.parquet(f"{DATA}/orders.parquet"), "o_orderkey", 7)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,7)]" in plan


def test_schemas_and_plans(spark):
    assert {"cases", "persons", "case_persons", "legal_sections", "chargesheets"} <= set(SCHEMAS)
    for name in ("block_persons", "quick_links", "pattern_person", "node_degrees", "case_similarity"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.limit(400).unionByName(events.limit(50)).coalesce(1).write.parquet(str(src))
    for name, df, mode in (("uniq", timeline.unique(timeline.read_events(spark, str(src)), "400 days"), "append"), ("act", timeline.activity(timeline.read_events(spark, str(src)), "1 day"), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("uniq").count() == events.limit(400).select("event_id").distinct().count()
    assert spark.table("act").agg(F.sum("n")).first()[0] == 450
    e = lambda w: spark.createDataFrame([("a", "HAS_PERSON", "p", w)], "src string, rel_type string, dst string, weight double")
    assert timeline.upsert_edges(e(0.4), timeline.upsert_edges(e(0.9), None)).first()["weight"] == 0.9
