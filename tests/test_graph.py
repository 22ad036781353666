import itertools
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from caselink.operators import explain, graph, patterns
from caselink.plans.queries import QUERIES
from caselink.store import components, ranked

NODE = "node_id string, label string, station_id string, props map<string,string>"
EDGE = "edge_id string, src string, dst string, rel_type string, weight double"


def net(spark, weight=0.8):
    nodes = spark.createDataFrame([("A", "Case", "S1", {}), ("B", "Case", "S2", {}), ("C", "Case", "S1", {}), ("P", "Person", None, {}), ("V", "Vehicle", None, {})], NODE)
    edges = [("A", "P", "HAS_PERSON", 1.0), ("B", "P", "HAS_PERSON", 1.0), ("A", "V", "HAS_VEHICLE", 1.0), ("B", "V", "HAS_VEHICLE", 1.0), ("A", "B", "RELATED_TO", weight)]
    return nodes, spark.createDataFrame([(f"{a}:{t}:{b}", a, b, t, w) for a, b, t, w in edges], EDGE)


def test_metrics(spark):
    got = {r["node_id"]: r for r in graph.metrics(*net(spark)).collect()}
    a, p, c = got["A"], got["P"], got["C"]
    assert (a["total_degree"], a["weighted_degree"], a["closeness"], a["betweenness"], a["degree_centrality"]) == (3, 2.80, 1.0, 0.1667, 1.0)
    assert (p["total_degree"], p["weighted_degree"], p["cases"], p["stations"], p["closeness"], p["betweenness"], p["degree_centrality"]) == (2, 2.0, 2, 2, 0.75, 0.0, 0.6667)
    assert p["is_connector"] and p["role"].startswith("Cross-station")
    assert (c["total_degree"], c["closeness"], c["betweenness"], c["degree_centrality"], c["cases"]) == (0, 0.0, 0.0, 0.0, 1)
    assert a["component_id"] == "comp:A" and c["component_id"] == "comp:C"


def test_communities_and_confidence_floor(spark):
    nodes, edges = net(spark, 0.9)
    (r,) = graph.communities(graph.with_components(nodes, edges), edges).collect()
    assert (r["community_id"], r["member_count"], r["density"], r["edge_count"], r["station_count"], r["spans_cross_station"]) == ("community:A", 4, 0.8333, 5, 2, True)
    assert r["labels"] == {"Case": 2, "Person": 1, "Vehicle": 1} and r["edge_types"] == {"HAS_PERSON": 2, "HAS_VEHICLE": 2, "RELATED_TO": 1}
    kept = graph.induced(edges, nodes, confidence=0.95)
    (r,) = graph.communities(graph.with_components(nodes, kept), kept).collect()
    assert r["density"] == 0.6667
    assert graph.communities(graph.with_components(nodes, edges), edges, density=0.9).count() == 0


def _random_graph(seed, n=24, m=30):
    rng = random.Random(seed)
    return [f"n{i:02d}" for i in range(n)], sorted({tuple(sorted(rng.sample([f"n{i:02d}" for i in range(n)], 2))) for _ in range(m)})


def _distances(nodes, links, s):
    dist, queue = {s: 0}, deque([s])
    while queue:
        v = queue.popleft()
        for w in links[v]:
            if w not in dist:
                dist[w] = dist[v] + 1
                queue.append(w)
    return dist


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_centrality_equals_brute_force(spark, seed):
    names, pairs = _random_graph(seed)
    nodes = spark.createDataFrame([(n, "Case", None, {}) for n in names], NODE)
    edges = spark.createDataFrame([(f"{a}:{b}", a, b, "RELATED_TO", 1.0) for a, b in pairs], EDGE)
    links = {n: {b for a, b in pairs if a == n} | {a for a, b in pairs if b == n} for n in names}
    dist = {n: _distances(names, links, n) for n in names}
    ways = {}
    for s in names:
        ways[s] = {s: 1}
        for v in sorted(dist[s], key=dist[s].get)[1:]:
            ways[s][v] = sum(ways[s][u] for u in links[v] if dist[s].get(u) == dist[s][v] - 1)
    placed = graph.with_components(nodes, edges)
    comp = {r["node_id"]: r["component"] for r in placed.collect()}
    assert comp == {n: min(dist[n]) for n in names}
    got = {r["node_id"]: (r["closeness"], r["betweenness"]) for r in graph.centrality(placed, edges, sources_per_task=5).collect()}
    for v in names:
        n = len(dist[v])
        close = (n - 1) / sum(dist[v].values()) if n > 1 else 0.0
        share = sum(ways[s][v] * ways[v][t] / ways[s][t] for s, t in itertools.combinations(sorted(dist[v]), 2) if v not in (s, t) and dist[s][v] + dist[v][t] == dist[s][t])
        between = share / ((n - 1) * (n - 2) / 2) if n > 2 else 0.0
        assert got[v] == (pytest.approx(close, abs=6e-5), pytest.approx(between, abs=6e-5))


def test_long_chain_components(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(df, "test").collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}
    assert components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_few_pairs_are_joined_in_one_job(spark, monkeypatch, kind):
    """Small tables take two writes, whatever the length of their chains; both ways give the same classes."""
    from caselink import store

    written = []
    monkeypatch.setattr(store, "cut", lambda df, name, *more, real=store.cut: written.append(name) or real(df, name, *more))
    pairs = [(i + 1, i) for i in range(60)] + [(100, 102), (102, 101), (7, 7), (5, 6)]
    df = spark.createDataFrame(pairs, "a long, b long").select(*[F.col(c).cast(kind).alias(c) for c in "ab"])
    few = {tuple(r) for r in store.components(df, "test").collect()}
    assert written == ["test-links", "test-labels"]
    assert few == {tuple(r) for r in store.components(df, "test", few=0).collect()} and len(written) > 4
    assert len(few) == 64


def path_net(spark):
    labels = {"A": "Case", "B": "Case", "C": "Case", "D": "Case", "P": "Person", "Ph": "Phone", "Loc": "Location", "Sec": "LegalSection"}
    nodes = spark.createDataFrame([(n, l, None, {}) for n, l in labels.items()], NODE)
    e = [("A", "P", "HAS_PERSON", 1.0), ("B", "P", "HAS_PERSON", 1.0), ("B", "Ph", "HAS_PHONE", 1.0), ("C", "Ph", "HAS_PHONE", 1.0), ("A", "Loc", "HAS_LOCATION", 1.0), ("C", "Sec", "HAS_LEGAL_SECTION", 1.0), ("A", "B", "RELATED_TO", 0.92)]
    return nodes, spark.createDataFrame([(f"{a}:{t}:{b}", a, b, t, w) for a, b, t, w in e], EDGE)


def test_traversal(spark):
    nodes, edges = path_net(spark)
    go = lambda start, depth, **k: graph.traverse(edges, nodes, spark.createDataFrame([(start,)], "start_id string"), depth, **k).collect()
    assert {r["end_id"] for r in go("A", 1)} == {"P", "Loc", "B"}
    assert {r["end_id"] for r in go("A", 1, confidence=0.95)} == {"P", "Loc"}
    assert {r["end_id"] for r in go("A", 4, confidence=0.95)} == {"P", "Loc", "B", "Ph", "C"}
    assert go("D", 3) == [] and go("missing", 2) == []
    rows = go("A", 3)
    assert all(len(set(r["path_edges"])) == r["hops"] == len(r["path_edges"]) for r in rows)
    assert any(r["path_nodes"] == ["A", "P", "B", "A"] for r in rows)  # a node may repeat, an edge may not
    assert [r["end_id"] for r in go("A", 9, target="C", edge_types=["HAS_PERSON", "HAS_PHONE"])] == ["C"]
    first = go("A", 1, target="P")[0]
    assert first["path_key"] == "(Case:A)-[HAS_PERSON]->(Person:P)"


def test_first_paths_and_neighbourhood(spark):
    nodes, edges = path_net(spark)
    start = spark.createDataFrame([("A",)], "start_id string")
    hops = graph.first_paths(graph.traverse(edges, nodes, start, 2), 3).orderBy("path_rank", "hop").collect()
    assert [(r["path_rank"], r["src"], r["dst"]) for r in hops] == [(1, "A", "B"), (2, "A", "Loc"), (3, "A", "P")]
    near = {r["node_id"]: r["distance"] for r in graph.neighbourhood(edges, start, 2).collect()}
    assert near == {"A": 0, "B": 1, "P": 1, "Loc": 1, "Ph": 2}


def test_projection_is_idempotent(spark):
    cases = spark.createDataFrame([("A", "S1", "x"), ("A", "S1", "x"), ("B", "S2", "y"), (None, "S3", "z")], "case_id string, station_id string, address string")
    nodes = graph.node_rows(cases, "case_id", "Case", "station_id", address="address", fir="station_id")
    assert nodes.count() == 2 and all("address" not in r["props"] for r in nodes.collect())
    people = graph.node_rows(spark.createDataFrame([("P",)], "person_id string"), "person_id", "Person")
    every = graph.union(nodes, people)
    links = spark.createDataFrame([("A", "P"), ("A", "P"), ("B", "Q"), (None, "P")], "case_id string, person_id string")
    edges = graph.edge_rows(links, "case_id", "person_id", "HAS_PERSON", every)
    assert [r["edge_id"] for r in edges.collect()] == ["A:HAS_PERSON:P"]
    pairs = spark.createDataFrame([("B", "A", 0.7), ("A", "B", 0.9), ("A", "A", 1.0)], "id1 string, id2 string, confidence double")
    (r,) = graph.related_rows(pairs, every).collect()
    assert (r["edge_id"], r["src"], r["dst"], r["weight"]) == ("A:B:RELATED_TO", "A", "B", 0.9)


def test_arguments():
    for bad in ({"depth": 0}, {"depth": 6}, {"edge_types": ["X"]}, {"label": "X"}, {"least_size": 1}, {"density": 2}, {"confidence": -1}):
        with pytest.raises(ValueError):
            graph.check(**bad)


def test_ranked(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(20), f"x{i}") for i in range(500)]
    got = [(r["a"], r["b"], r["rank"]) for r in ranked(spark.createDataFrame(rows, "a long, b string"), "test", "a", "b").orderBy("rank").collect()]
    assert got == [(*r, i) for i, r in enumerate(sorted(rows), 1)]


def test_structural_patterns_and_explanations(spark):
    nodes, edges = net(spark, 0.9)
    m = graph.metrics(nodes, edges)
    c = graph.communities(graph.with_components(nodes, edges), edges)
    found = patterns.finalize(patterns.structural(c, m)).collect()
    assert {r["entity_id"] for r in found} == {"community:A", "A", "B", "P", "V"}
    told = explain.union(explain.of_communities(c), explain.of_connectors(m))
    rows = {r["subject_id"]: r for r in told.collect()}
    assert rows["community:A"]["observation"] == "Graph structural community 'community:A' identified with 4 member nodes and density 0.8333."
    assert "betweenness centrality 0.0000" in rows["P"]["explanation"]
    assert {r["subject_type"]: r["n"] for r in explain.histogram(told).collect()} == {"Community": 1, "Case": 2, "Person": 1, "Vehicle": 1}
    assert told.where(F.size("limitations") != 2).count() == 0


def test_path_details(spark):
    nodes, edges = path_net(spark)
    nodes = nodes.withColumn("props", F.create_map(F.lit("name"), F.col("node_id"), F.lit("address"), F.lit("secret")))
    found = graph.traverse(edges, nodes, spark.createDataFrame([("A",)], "start_id string"), 2)
    for metadata, weight in ((True, 0.92), (False, None)):
        got = {r["path_key"]: r for r in graph.path_details(found, nodes, metadata).collect()}
        assert len(got) == found.count()
        r = got["(Case:A)-[RELATED_TO]->(Case:B)"]
        assert [(n["node_id"], n["label"], n["props"]) for n in r["nodes"]] == [("A", "Case", {"name": "A"}), ("B", "Case", {"name": "B"})]
        assert [(e["edge_id"], e["weight"]) for e in r["edges"]] == [("A:RELATED_TO:B", weight)]


def test_orders(spark):
    c = spark.createDataFrame([("x", 2, 0.5), ("a", 2, 1.0), ("b", 2, 1.0), ("z", 5, 0.1)], "community_id string, member_count long, density double")
    assert [r[0] for r in graph.communities_in_order(c).collect()] == ["z", "a", "b", "x"]
    assert [r["node_id"] for r in graph.metrics_in_order(graph.metrics(*net(spark))).collect()] == ["A", "B", "C", "P", "V"]


def test_nodes_of_one_id_agree_between_runs(spark):
    rows = spark.createDataFrame([("A", "S2", "y"), ("A", "S1", "x"), ("A", None, "z")], "case_id string, station_id string, fir string").repartition(3)
    assert [(r["station_id"], r["props"]) for r in graph.node_rows(rows, "case_id", "Case", "station_id", fir="fir").collect()] == [("S2", {"fir": "y"})]
    e = graph.union(graph.edge_rows(spark.createDataFrame([("A", "P"), ("A", "Q"), ("Z", "P")], "c string, p string"), "c", "p", "HAS_PERSON"))
    known = graph.known_ends(e, spark.createDataFrame([("A",), ("P",)], "node_id string"))
    assert [r["edge_id"] for r in known.collect()] == ["A:HAS_PERSON:P"]


def test_structural_patterns_place_nodes_once(spark, monkeypatch):
    """Communities and metrics of one graph share its components."""
    made, plain = [], graph.with_components
    monkeypatch.setattr(graph, "with_components", lambda *a: made.append(1) or plain(*a))
    QUERIES["pattern_structural"](spark, "/root/testdata/sf0.001")
    assert len(made) == 1


def no_pairs(*_):
    raise AssertionError("pairs of cases are made")


def test_case_reach_makes_no_pairs(spark, monkeypatch):
    from caselink.operators import links

    monkeypatch.setattr(links, "shared", no_pairs)
    assert QUERIES["case_reach"](spark, "/root/testdata/sf0.001").where("cases > 1").count() > 0


def test_reach_by_group_equals_pairs(spark):
    """Cases of several persons, of an unknown one, without a station or without persons, and links of no case."""
    from caselink.operators import links

    rng = random.Random(5)
    cp = spark.createDataFrame([(f"C{rng.randrange(14)}", f"P{rng.randrange(9)}") for _ in range(26)] + [("C99", "P1"), (None, "P1"), ("C1", None)], "case_id string, value string")
    cases = spark.createDataFrame([(f"C{i}", "Case", None if i % 5 == 0 else f"S{i % 3}", {}) for i in range(16)], NODE)
    pairs = links.shared(cp, "value").withColumn("confidence", F.lit(0.85))
    want = graph.case_reach(cases, graph.related_rows(pairs, cases)).collect()
    got = graph.reach_by_group(cases.select("node_id", "station_id"), cp).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in want} and len(got) == len(want)


@pytest.mark.parametrize("name", ["graph_components", "communities", "explain_communities"])
def test_whole_graph_makes_no_pairs(spark, monkeypatch, name):
    from caselink.operators import links

    monkeypatch.setattr(links, "shared", no_pairs)
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_components_in_turn_equal_all_at_once(spark):
    from caselink.store import components_in_turn

    rng = random.Random(3)
    ids = spark.createDataFrame([(f"n{i:02}",) for i in range(40)], "id string")
    parts = [spark.createDataFrame([(f"n{rng.randrange(40):02}", f"n{rng.randrange(44):02}") for _ in range(9)], "a string, b string") for _ in range(2)]
    known = parts[0].union(parts[1]).where("b < 'n40'")
    want = {f"n{i:02}": f"n{i:02}" for i in range(40)} | {r["id"]: r["component"] for r in components(known, "test").collect()}
    assert {r["id"]: r["component"] for r in components_in_turn(ids, parts, "test").collect()} == want


def _of_persons(spark, cp):
    """Cases of P1 to P4, one without a person, one without a value; C99 and P9 are not known; links of a person that is not known, and one that is there twice."""
    cases = [(f"C{i:02}", f"S{i % 3}" if i % 4 else None, f"P{i % 4 + 1}", f"P{i % 4 + 1}|{i % 3}" if i != 5 else None) for i in range(14)] + [("C20", "S1", None, None)]
    links = [(c, p) for c, _, p, _ in cases if p] + [("C99", "P1"), ("C99", "P2"), ("C00", "P1"), (None, "P1"), ("C01", None), ("C98", "P9"), *cp]
    make = spark.createDataFrame
    return make(cases, "case_id string, station_id string, person_id string, value string"), make([(f"P{i}",) for i in (1, 2, 3, 5, 5)], "person_id string"), make(links, "case_id string, person_id string")


@pytest.mark.parametrize("most", [256, 4])
def test_metrics_of_groups_equal_metrics(spark, most):
    from caselink.operators import links

    cases, persons, cp = _of_persons(spark, [])
    nodes = graph.union(graph.node_rows(cases, "case_id", "Case", "station_id"), graph.node_rows(persons, "person_id", "Person"))
    near = links.shared(cases, "value").withColumn("confidence", F.lit(0.85))
    edges = graph.union(graph.edge_rows(cp, "case_id", "person_id", "HAS_PERSON", nodes), graph.related_rows(near, nodes))
    want = graph.metrics(nodes, edges)
    got = graph.metrics_of_groups(cases, persons, cp, 0.85, most)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) and got.count() == 19


@pytest.mark.parametrize("most", [256, 4])
def test_persons_that_do_not_tell_components(spark, most):
    for more in (("C00", "P3"), ("C20", "P1"), ("C20", "P9")):
        assert graph.metrics_of_groups(*_of_persons(spark, [more]), 0.85, most) is None
    cases, persons, cp = _of_persons(spark, [])
    assert graph.metrics_of_groups(cases.union(cases.limit(1)), persons, cp, 0.85, most) is None


def test_dense_centrality_equals_brute_force():
    rng = random.Random(4)
    import numpy as np

    a = np.zeros((6, 9, 9))
    for k in range(6):
        for _ in range(5 + 2 * k):
            x, y = rng.sample(range(9), 2)
            a[k, x, y] = a[k, y, x] = 1
    far, gain = graph._brandes_dense(a)
    for k in range(6):
        f, g = graph._brandes(list(range(9)), {v: list(np.flatnonzero(a[k, v])) for v in range(9)}, list(range(9)))
        assert far[k].tolist() == [f[v] for v in range(9)] and gain[k].tolist() == pytest.approx([g[v] for v in range(9)])


def test_network_metrics_make_no_pairs_of_cases(spark, monkeypatch):
    monkeypatch.setattr(graph, "related_rows", no_pairs)
    monkeypatch.setattr(graph, "with_components", no_pairs)
    assert QUERIES["network_metrics"](spark, "/root/testdata/sf0.001").where("total_degree > 0").count() > 0


@pytest.mark.parametrize("most", [256, 4])
def test_structure_of_groups_equals_whole_graph(spark, most):
    from caselink.operators import links

    cases, persons, cp = _of_persons(spark, [])
    nodes = graph.union(graph.node_rows(cases, "case_id", "Case", "station_id"), graph.node_rows(persons, "person_id", "Person"))
    near = links.shared(cases, "value").withColumn("confidence", F.lit(0.85))
    edges = graph.union(graph.edge_rows(cp, "case_id", "person_id", "HAS_PERSON", nodes), graph.related_rows(near, nodes))
    want = graph.communities(graph.with_components(nodes, edges), edges), graph.metrics(nodes, edges)
    got = graph.structure_of_groups(cases, persons, cp, 0.85, most)
    for a, b in zip(got, want, strict=True):
        assert sorted(map(str, a.select(b.columns).collect())) == sorted(map(str, b.collect())) and b.count()
    dense = "density >= 0.2 or spans_cross_station"  # may be looked at before nodes without an edge are left out
    assert got[0].where(dense).count() == want[0].where(dense).count()


@pytest.mark.parametrize("name", ["pattern_structural", "explain_connectors"])
def test_structure_of_persons_makes_no_pairs_of_cases(spark, monkeypatch, name):
    # Edges of the whole graph were written, and components found by rounds over them.
    import caselink.plans.queries as queries

    monkeypatch.setattr(queries, "_person_graph", no_pairs)
    assert not QUERIES[name](spark, "/root/testdata/sf0.001").isEmpty()
