"""The case graph as two DataFrames, and operators on them.

nodes(node_id, label, station_id, props map) and edges(edge_id, src, dst,
rel_type, weight). Edges are stored in one direction and used in both; RELATED_TO
goes from the smaller to the larger case id. Projection is idempotent: nodes are
distinct by (label, node_id), edges by (src, rel_type, dst), and an edge needs
both its ends.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..store import components as reach
from ..store import cut
from . import blocking
from .links import shared

#: Closed lists of labels and edge types.
LABELS = ("Case", "Person", "Vehicle", "Phone", "Location", "Evidence", "LegalSection")
EDGE_TYPES = ("HAS_PERSON", "HAS_VEHICLE", "HAS_PHONE", "HAS_LOCATION", "HAS_EVIDENCE", "HAS_LEGAL_SECTION", "RELATED_TO")


def check(depth: int | None = None, edge_types: list[str] | None = None, label: str | None = None, least_size: int | None = None, density: float | None = None, confidence: float | None = None) -> None:
    """Arguments of graph requests; ValueError where one is out of range."""
    if depth is not None and not 1 <= depth <= 5:
        raise ValueError("depth must be from 1 to 5")
    if bad := set(edge_types or ()) - set(EDGE_TYPES):
        raise ValueError(f"unknown edge types: {sorted(bad)}")
    if label is not None and label not in LABELS:
        raise ValueError(f"unknown label: {label}")
    if least_size is not None and least_size < 2:
        raise ValueError("a community has 2 members at least")
    for name, x in (("density", density), ("confidence", confidence)):
        if x is not None and not 0 <= x <= 1:
            raise ValueError(f"{name} must be from 0 to 1")


def node_rows(df: DataFrame, key: str, label: str, station: str | None = None, **props: str) -> DataFrame:
    """Nodes of one label; sensitive properties are withheld."""
    pairs = [x for k, c in props.items() for x in (F.lit(k), F.col(c).cast("string"))]
    made = N.redact(F.create_map(*pairs)) if pairs else F.create_map().cast("map<string,string>")
    station_id = F.col(station) if station else F.lit(None).cast("string")
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("node_id"), F.lit(label).alias("label"), station_id.alias("station_id"), made.alias("props"))
    # Rows of one id collapse to the one with the greatest station and properties, so that reruns agree.
    order = F.struct("station_id", F.array_sort(F.map_entries("props")).alias("props"))
    kept = rows.groupBy("label", "node_id").agg(F.max(order).alias("m"))
    return kept.select("node_id", "label", "m.station_id", F.map_from_entries("m.props").alias("props"))


def edge_rows(links: DataFrame, src: str, dst: str, rel_type: str, nodes: DataFrame | None = None, weight: str | None = None) -> DataFrame:
    """Edges of one type; repeats of a pair collapse. With `nodes`, those with both ends in it (or see `known_ends`, once for all types)."""
    w = F.max(weight) if weight else F.lit(1.0)
    rows = links.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).groupBy(F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst")).agg(w.cast("double").alias("weight"))
    made = rows.select(F.concat_ws(":", "src", F.lit(rel_type), "dst").alias("edge_id"), "src", "dst", F.lit(rel_type).alias("rel_type"), "weight")
    return made if nodes is None else known_ends(made, nodes)


def known_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends in nodes: one semi-join for each end, whatever the number of edge types."""
    known = nodes.select("node_id")
    return edges.join(known, edges["src"] == known["node_id"], "left_semi").join(known, edges["dst"] == known["node_id"], "left_semi")


def related_rows(pairs: DataFrame, nodes: DataFrame | None = None, confidence: str = "confidence") -> DataFrame:
    """RELATED_TO edges from case pairs, in canonical direction; a case is not related to itself."""
    p = pairs.select(F.least("id1", "id2").alias("s"), F.greatest("id1", "id2").alias("d"), F.col(confidence).alias("w")).where("s <> d")
    return edge_rows(p, "s", "d", "RELATED_TO", nodes, "w").withColumn("edge_id", F.concat_ws(":", "src", "dst", F.lit("RELATED_TO")))


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, n: nodes by label and edges by type."""
    return nodes.groupBy(F.col("label").alias("kind")).agg(F.count("*").alias("n")).unionByName(edges.groupBy(F.col("rel_type").alias("kind")).agg(F.count("*").alias("n")))


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """rule, id of rows that break the graph's constraints: unique ids, known labels and types, both ends, canonical direction."""
    twice = nodes.groupBy("label", "node_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("node id is not unique").alias("rule"), F.col("node_id").alias("id"))
    label = nodes.where(~F.col("label").isin(*LABELS) | F.col("node_id").isNull()).select(F.lit("unknown label or no id").alias("rule"), F.col("node_id").alias("id"))
    kind = edges.where(~F.col("rel_type").isin(*EDGE_TYPES)).select(F.lit("unknown edge type").alias("rule"), F.col("edge_id").alias("id"))
    ends = edges.select("edge_id", F.explode(F.array("src", "dst")).alias("node_id")).join(nodes.select("node_id"), "node_id", "left_anti").select(F.lit("edge without an end").alias("rule"), F.col("edge_id").alias("id")).distinct()
    way = edges.where("rel_type = 'RELATED_TO' and src >= dst").select(F.lit("RELATED_TO is not canonical").alias("rule"), F.col("edge_id").alias("id"))
    return union(twice, label, kind, ends, way)


def both_ways(edges: DataFrame) -> DataFrame:
    """near, far, and the edge: each edge from both its ends."""
    a = edges.select(F.col("src").alias("near"), F.col("dst").alias("far"), "edge_id", "rel_type", "weight")
    b = edges.where("src <> dst").select(F.col("dst").alias("near"), F.col("src").alias("far"), "edge_id", "rel_type", "weight")
    return a.unionByName(b)


def traverse(edges: DataFrame, nodes: DataFrame, starts: DataFrame, depth: int = 3, edge_types: list[str] | None = None, target: str | None = None, confidence: float | None = None) -> DataFrame:
    """start_id, end_id, hops, path_key, path_nodes, path_edges, path_weights: all trails of 1 to depth edges from the starts (start_id).

    An edge may not repeat on a trail, a node may. `confidence` bounds RELATED_TO
    only. One join per hop of the trails so far with the edges, and one with the
    nodes that they reach; neither edges nor nodes are written or doubled.
    """
    depth = max(1, min(5, depth))
    check(depth, edge_types, confidence=confidence)
    used = edges.where(F.col("rel_type").isin(list(edge_types or EDGE_TYPES)))
    if confidence is not None:
        used = used.where((F.col("rel_type") != "RELATED_TO") | (F.col("weight") >= confidence))
    label = nodes.select(F.col("node_id").alias("far"), F.col("label").alias("far_label"))
    step = both_ways(used)
    first = starts.join(nodes, F.col("start_id") == F.col("node_id")).select("start_id", F.col("start_id").alias("end_id"), F.col("label").alias("end_label"))
    front = first.select("start_id", "end_id", "end_label", F.lit("").alias("path_key"), F.array("start_id").alias("path_nodes"), F.array().cast("array<string>").alias("path_edges"), F.array().cast("array<double>").alias("path_weights"))
    found = []
    for hop in range(1, depth + 1):
        piece = F.concat(F.lit("("), "end_label", F.lit(":"), "end_id", F.lit(")-["), "rel_type", F.lit("]->("), "far_label", F.lit(":"), "far", F.lit(")"))
        ahead = front.join(step, front["end_id"] == step["near"]).where(~F.array_contains("path_edges", F.col("edge_id")))
        front = cut(ahead, "graph-reached").join(label, "far").select(
            "start_id", F.col("far").alias("end_id"), F.col("far_label").alias("end_label"), F.concat_ws("->", F.nullif("path_key", F.lit("")), piece).alias("path_key"),
            F.array_append("path_nodes", F.col("far")).alias("path_nodes"), F.array_append("path_edges", F.col("edge_id")).alias("path_edges"), F.array_append("path_weights", F.col("weight")).alias("path_weights"),
        )
        front = cut(front, "graph-trails") if depth > 1 else front
        found.append(front.withColumn("hops", F.lit(hop)))
    out = union(*found).dropDuplicates(["start_id", "path_key"])
    if target is not None:
        out = out.where(F.col("end_id") == target)
    return out.select("start_id", "end_id", "end_label", "hops", "path_key", "path_nodes", "path_edges", "path_weights")


def path_details(paths: DataFrame, nodes: DataFrame, metadata: bool = True) -> DataFrame:
    """start_id, path_key, nodes, edges: the nodes of each trail as structs (node_id, label, station_id, props) and its edges as structs (edge_id, weight), in order.

    Sensitive properties are left out. Without `metadata` an edge has no weight;
    nodes keep their properties.
    """
    at = paths.select("start_id", "path_key", F.posexplode("path_nodes").alias("at", "node_id"))
    known = nodes.select("node_id", "label", "station_id", N.redact(F.col("props")).alias("props"))
    shown = F.array_sort(F.collect_list(F.struct("at", "node_id", "label", "station_id", F.map_entries("props").alias("props"))))
    per = at.join(known, "node_id").groupBy("start_id", "path_key").agg(shown.alias("found"))
    line = F.transform("found", lambda x: F.struct(x["node_id"].alias("node_id"), x["label"].alias("label"), x["station_id"].alias("station_id"), F.map_from_entries(x["props"]).alias("props")))
    weight = (lambda w: w) if metadata else (lambda w: F.lit(None).cast("double"))
    edges = F.zip_with("path_edges", "path_weights", lambda e, w: F.struct(e.alias("edge_id"), weight(w).alias("weight")))
    return paths.select("start_id", "path_key", edges.alias("edges")).join(per, ["start_id", "path_key"]).select("start_id", "path_key", line.alias("nodes"), "edges")


def first_paths(paths: DataFrame, n: int = 5, confidence: float = 0.9) -> DataFrame:
    """Hop rows of the first n paths by hops, end and key: path_rank, hop, src, dst, confidence."""
    top = paths.orderBy("hops", "end_id", "path_key").limit(n).select(F.struct("hops", "end_id", "path_key", "path_nodes").alias("p"))
    lined = top.groupBy().agg(F.array_sort(F.collect_list("p")).alias("ps")).select(F.posexplode("ps").alias("path_rank", "p"))
    hop = F.posexplode(F.arrays_zip(F.slice("p.path_nodes", 1, F.size("p.path_nodes") - 1).alias("src"), F.slice("p.path_nodes", 2, F.size("p.path_nodes") - 1).alias("dst"))).alias("hop", "h")
    return lined.select((F.col("path_rank") + 1).alias("path_rank"), hop).select("path_rank", (F.col("hop") + 1).alias("hop"), F.col("h.src").alias("src"), F.col("h.dst").alias("dst"), F.lit(confidence).alias("confidence"))


def neighbourhood(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """node_id, distance: nodes within depth of the starts (start_id), by frontier joins."""
    check(depth)
    step = both_ways(edges).select("near", "far")
    seen = starts.select(F.col("start_id").alias("node_id"), F.lit(0).alias("distance")).distinct()
    front = seen
    for d in range(1, depth + 1):
        front = front.join(step, front["node_id"] == step["near"]).select(F.col("far").alias("node_id")).distinct().join(seen, "node_id", "left_anti").withColumn("distance", F.lit(d))
        front = cut(front, "graph-front")
        seen = seen.unionByName(front)
    return seen


def induced(edges: DataFrame, node_ids: DataFrame, edge_types: list[str] | None = None, confidence: float | None = None) -> DataFrame:
    """Edges with both ends among node_ids; confidence bounds RELATED_TO only."""
    used = edges if edge_types is None else edges.where(F.col("rel_type").isin(edge_types))
    if confidence is not None:
        used = used.where((F.col("rel_type") != "RELATED_TO") | (F.col("weight") >= confidence))
    ids = node_ids.select("node_id")
    return used.join(ids, used["src"] == ids["node_id"], "left_semi").join(ids, used["dst"] == ids["node_id"], "left_semi")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, label, in_degree, out_degree, total_degree, weighted_degree; parallel edges count, other than RELATED_TO weigh 1."""
    w = F.when(F.col("rel_type") == "RELATED_TO", F.coalesce("weight", F.lit(1.0))).otherwise(1.0)
    ends = edges.select(F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i"), w.alias("w")).unionByName(edges.select(F.col("dst").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i"), w.alias("w")))
    per = ends.groupBy("node_id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"), F.sum("w").alias("w"))
    z = lambda c: F.coalesce(c, F.lit(0))
    return nodes.join(per, "node_id", "left").select("node_id", "label", z("i").alias("in_degree"), z("o").alias("out_degree"), (z("i") + z("o")).alias("total_degree"), F.round(F.coalesce("w", F.lit(0.0)), 4).alias("weighted_degree"))


def case_reach(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, cases, stations: distinct cases next to a node (a case counts itself), and their stations."""
    cases = nodes.where("label = 'Case'").select(F.col("node_id").alias("far"), "station_id")
    near = both_ways(edges).select("near", "far").join(cases, "far").select(F.col("near").alias("node_id"), F.col("far").alias("case"), "station_id")
    own = cases.select(F.col("far").alias("node_id"), F.col("far").alias("case"), "station_id")
    per = near.unionByName(own).groupBy("node_id").agg(F.count_distinct("case").alias("cases"), F.count_distinct("station_id").alias("stations"))
    return nodes.select("node_id").join(per, "node_id", "left").select("node_id", F.coalesce("cases", F.lit(0)).alias("cases"), F.coalesce("stations", F.lit(0)).alias("stations"))


def reach_by_type(cases: DataFrame, links: DataFrame) -> DataFrame:
    """node_id, cases, stations over the links (case_id, value) of one edge type, whose values are of one label; cases: node_id, station_id."""
    known = cases.select(F.col("node_id").alias("case_id"), "station_id")
    return links.where("case_id is not null and value is not null").select("case_id", "value").distinct().join(known, "case_id").groupBy(F.col("value").alias("node_id")).agg(F.count("*").alias("cases"), F.count_distinct("station_id").alias("stations"))


def reach_by_group(cases: DataFrame, links: DataFrame) -> DataFrame:
    """node_id, cases, stations of cases over RELATED_TO between all cases of one value (case_id, value); a case counts itself.

    Cases of one value reach what their group has, and no pair of them is made. Only
    cases of several values, whose groups may overlap, count the cases they meet.
    """
    known = cases.select(F.col("node_id").alias("case_id"), "station_id")
    rows = cut(links.where("case_id is not null and value is not null").select("case_id", "value").distinct().join(known, "case_id"), "reach-rows")
    values = rows.groupBy("case_id").agg(F.count("*").alias("n"), F.min("value").alias("value"))
    group = rows.groupBy("value").agg(F.count("*").alias("cases"), F.count_distinct("station_id").alias("stations"))
    of_one = values.where("n = 1").join(group, "value").select(F.col("case_id").alias("node_id"), "cases", "stations")
    several = values.where("n > 1").select("case_id").join(rows.select("case_id", "value"), "case_id")
    met = several.withColumnRenamed("case_id", "node_id").join(rows, "value").select("node_id", "case_id", "station_id").distinct()
    of_several = met.groupBy("node_id").agg(F.count("*").alias("cases"), F.count_distinct("station_id").alias("stations"))
    alone = cases.select("node_id", "station_id").join(values.select(F.col("case_id").alias("node_id")), "node_id", "left_anti")
    return union(of_one, of_several, alone.select("node_id", F.lit(1).cast("long").alias("cases"), F.when(F.col("station_id").isNotNull(), 1).otherwise(0).cast("long").alias("stations")))


def with_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with `component`, the smallest node id reachable; a node without edges is its own."""
    found = reach(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), "graph-components")
    return placed_in(nodes, found)


def placed_in(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """nodes with the component of `found` (id, component)."""
    return nodes.join(found.withColumnRenamed("id", "node_id"), "node_id", "left").withColumn("component", F.coalesce("component", "node_id"))


def component_summary(placed: DataFrame) -> DataFrame:
    """component_id, size, cases, stations, cross_station of nodes with `component`."""
    is_case = F.col("label") == "Case"
    per = placed.groupBy("component").agg(F.count("*").alias("size"), F.count_if(is_case).alias("cases"), F.count_distinct(F.when(is_case, F.col("station_id"))).alias("stations"))
    return per.select(F.concat(F.lit("comp:"), "component").alias("component_id"), "size", "cases", "stations", (F.col("stations") > 1).alias("cross_station"))


def edge_sums(placed: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(component, rel_type, n: edges; component, pairs: distinct unordered pairs of different ends)."""
    where = placed.select(F.col("node_id").alias("src"), "component")
    inner = edges.join(where, "src")
    pairs = inner.where("src <> dst").select("component", F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct().groupBy("component").agg(F.count("*").alias("pairs"))
    return inner.groupBy("component", "rel_type").agg(F.count("*").alias("n")), pairs


def sums_of_type(placed: DataFrame, links: DataFrame, rel_type: str, label: str) -> DataFrame:
    """component, rel_type, n, pairs, odd of the edges from cases to values (case_id, value); odd: those whose value is a node of another label."""
    ends = placed.select(F.col("node_id").alias("value"), "label", "component")
    known = placed.where("label = 'Case'").select(F.col("node_id").alias("case_id"))
    each = links.where("case_id is not null and value is not null").select("case_id", "value").distinct().join(known, "case_id", "left_semi").join(ends, "value")
    return each.groupBy("component", F.lit(rel_type).alias("rel_type")).agg(F.count("*").alias("n"), F.count_if(F.col("case_id") != F.col("value")).alias("pairs"), F.count_if(F.col("label") != label).alias("odd"))


def sums_of_groups(placed: DataFrame, links: DataFrame) -> DataFrame:
    """`sums_of_type` of RELATED_TO between all cases of one value (case_id, value): pairs are met and counted, never shuffled."""
    known = placed.where("label = 'Case'").select(F.col("node_id").alias("id"), F.col("component").alias("m"))
    rows = links.where("case_id is not null and value is not null").select(F.lit("V").alias("signal"), F.col("value").cast("string").alias("key"), F.col("case_id").alias("id")).distinct()
    joined, _ = blocking.met(blocking.carried(rows, ["V"], known), ["V"])
    return joined.groupBy(F.col("a.m").alias("component"), F.lit("RELATED_TO").alias("rel_type")).agg(F.count("*").alias("n")).select("component", "rel_type", "n", F.col("n").alias("pairs"), F.lit(0).cast("long").alias("odd"))


def communities(placed: DataFrame, edges: DataFrame, least_size: int = 2, density: float = 0.0) -> DataFrame:
    """Components with their density over distinct unordered pairs, and histograms of labels and edge types."""
    return communities_of(placed, *edge_sums(placed, edges), least_size, density)


def communities_of(placed: DataFrame, sums: DataFrame, pairs: DataFrame, least_size: int = 2, density: float = 0.0) -> DataFrame:
    """`communities` from sums of edges, as of `edge_sums`."""
    check(least_size=least_size, density=density)
    types = sums.groupBy("component").agg(F.sum("n").alias("edges"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("rel_type", "n")))).alias("edge_types"))
    labels = placed.groupBy("component", "label").agg(F.count("*").alias("n")).groupBy("component").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("labels"))
    summary = component_summary(placed).withColumn("component", F.expr("substring(component_id, 6)"))
    n = F.col("size")
    d = F.round(F.coalesce(F.try_divide(2.0 * F.col("pairs"), n * (n - 1)), F.lit(0.0)), 4)
    joined = summary.join(pairs, "component", "left").join(types, "component", "left").join(labels, "component").withColumn("density", d)
    return joined.where((n >= least_size) & (F.col("density") >= density)).select(
        F.concat(F.lit("community:"), "component").alias("community_id"), F.col("size").alias("member_count"), "density", F.coalesce("edges", F.lit(0)).alias("edge_count"), F.col("cases").alias("case_count"), F.col("stations").alias("station_count"),
        F.col("cross_station").alias("spans_cross_station"), "labels", F.coalesce("edge_types", F.create_map().cast("map<string,bigint>")).alias("edge_types"),
    )


def _brandes(nodes: list[str], links: dict[str, list[str]], sources: list[str]) -> tuple[dict[str, float], dict[str, float]]:
    """(sum of distances of each source, betweenness gained by each node from the sources)."""
    far: dict[str, float] = {}
    gain = dict.fromkeys(nodes, 0.0)
    for s in sources:
        order, ways, dist, before = [], {s: 1.0}, {s: 0}, {s: []}
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in links.get(v, ()):
                if w not in dist:
                    dist[w], ways[w], before[w] = dist[v] + 1, 0.0, []
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    ways[w] += ways[v]
                    before[w].append(v)
        far[s] = float(sum(dist.values()))
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before[w]:
                share[v] += ways[v] / ways[w] * (1 + share[w])
            if w != s:
                gain[w] += share[w]
    return far, gain


def centrality(placed: DataFrame, edges: DataFrame, sources_per_task: int = 256, most_edges: int = 5_000_000) -> DataFrame:
    """node_id, closeness, betweenness within components.

    Shortest paths are counted from each source once (Brandes). A component is dealt
    to tasks by blocks of its sources, so a large one is spread; each such task
    holds the component's edges, of which there may be `most_edges` at most.
    """
    size = placed.groupBy("component").agg(F.count("*").alias("n"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / sources_per_task)).cast("long")
    pairs = both_ways(edges.where("src <> dst")).select("near", "far").distinct()
    where = placed.select(F.col("node_id").alias("near"), "component")
    lines = where.join(pairs, "near", "left").join(size, "component").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).withColumn("mine", F.pmod(F.xxhash64("near"), blocks) == F.col("block"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > most_edges:
            raise ValueError(f"component {pdf['component'].iloc[0]} has more than {most_edges} edges")
        links: dict[str, list[str]] = {}
        for a, b in zip(pdf["near"], pdf["far"], strict=True):
            if b is not None:
                links.setdefault(a, []).append(b)
        nodes = sorted(set(pdf["near"]))
        far, gain = _brandes(nodes, links, sorted(set(pdf.loc[pdf["mine"], "near"])))
        return pd.DataFrame({"node_id": nodes, "n": int(pdf["n"].iloc[0]), "far": [far.get(v, 0.0) for v in nodes], "gain": [gain[v] for v in nodes]})

    part = lines.groupBy("component", "block").applyInPandas(run, "node_id string, n long, far double, gain double")
    per = part.groupBy("node_id").agg(F.first("n").alias("n"), F.sum("far").alias("far"), F.sum("gain").alias("gain"))
    n = F.col("n")
    return per.select("node_id", _closeness(n, F.col("far")).alias("closeness"), _betweenness(n, F.col("gain")).alias("betweenness"))


def communities_in_order(found: DataFrame) -> DataFrame:
    """Large ones first, then dense ones, then by id."""
    return found.orderBy(F.desc("member_count"), F.desc("density"), "community_id")


def metrics_in_order(found: DataFrame) -> DataFrame:
    return found.orderBy("label", "node_id")


def metrics(nodes: DataFrame, edges: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """One row per node: degrees, reach, centralities, component, connector flag and role. placed: `with_components` of both, where it is there already."""
    placed = cut(with_components(nodes, edges), "graph-placed") if placed is None else placed
    n = placed.groupBy("component").agg(F.count("*").alias("n"))
    out = (
        degrees(nodes, edges).join(case_reach(nodes, edges), "node_id").join(centrality(placed, edges), "node_id")
        .join(placed.select("node_id", "component"), "node_id").join(n, "component")
    )
    return _with_roles(out)


def _with_roles(out: DataFrame) -> DataFrame:
    """The rows of `metrics` from counts of each node, its component and n, the size of that."""
    degree = F.when(F.col("n") > 1, F.least(F.lit(1.0), F.round(F.col("total_degree") / (F.col("n") - 1), 4))).otherwise(0.0)
    role = (
        F.when(F.col("betweenness") >= 0.2, "High betweenness centrality connector node in network component.")
        .when(F.col("stations") >= 2, "Cross-station network connector linking multiple police stations.")
        .when((F.col("label") != "Case") & (F.col("cases") >= 2), F.concat(F.lit("Shared "), F.lower("label"), F.lit(" entity bridging "), F.col("cases").cast("string"), F.lit(" distinct cases.")))
    )
    return out.select(
        "node_id", "label", "in_degree", "out_degree", "total_degree", "weighted_degree", "cases", "stations", degree.alias("degree_centrality"), "closeness", "betweenness",
        F.concat(F.lit("comp:"), "component").alias("component_id"), role.isNotNull().alias("is_connector"), role.alias("role"),
    )


def _closeness(n: Column, far: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(n - 1, far), F.lit(0.0)), 4)


def _betweenness(n: Column, gain: Column) -> Column:
    return F.round(F.when(n > 2, gain / ((n - 1) * (n - 2))).otherwise(0.0), 4)


def _brandes_dense(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`_brandes` from all nodes of many graphs of one size, given as their adjacency (graph, node, node): sums of distances, betweenness gained."""
    paths = np.broadcast_to(np.eye(a.shape[1]), a.shape).copy()
    dist = np.where(paths > 0, 0, -1)
    front, d = paths, 0
    while front.any():
        d += 1
        front = np.where(dist < 0, front @ a, 0.0)
        dist[front > 0] = d
        paths = paths + front
    share = np.zeros(a.shape)
    for level in range(d - 1, 0, -1):
        passed = np.divide(1 + share, paths, out=np.zeros(a.shape), where=dist == level) @ a
        share = share + np.where(dist == level - 1, paths * passed, 0.0)
    share[:, np.arange(a.shape[1]), np.arange(a.shape[1])] = 0.0
    return np.maximum(dist, 0).sum(axis=2).astype(float), share.sum(axis=1)


def _joined(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches over edges x to y, both ways."""
    least = np.arange(n)
    while True:
        near = least.copy()
        np.minimum.at(near, x, least[y])
        np.minimum.at(near, y, least[x])
        near = near[near]
        if (near == least).all():
            return least
        least = near


def _measured(rows: pd.DataFrame, confidence: float, cells: int = 2_000_000) -> pd.DataFrame:
    """Counts and centralities of the nodes of whole groups, and a row without a label for each link whose case is not in its group; rows as of `metrics_of_groups`, sorted by group and id."""
    nodes = rows.loc[rows["label"].notna(), ["group", "id", "label", "station"]].drop_duplicates("id").reset_index(drop=True)
    place = pd.Series(nodes.index.to_numpy(), nodes["id"])
    has = rows.loc[rows["person"].notna(), ["id", "person"]].drop_duplicates()
    ends = has["id"].map(place), has["person"].map(place)
    here = has["id"].map(pd.Series(nodes["group"].to_numpy(), nodes["id"])) == has["person"]  # a link is in the group of its person
    astray, known = has.loc[~here, "id"].unique(), (here & ends[1].notna()).to_numpy()
    src, dst = (e.to_numpy()[known].astype(np.int64) for e in ends)
    keyed = rows.loc[rows["value"].notna() & rows["label"].notna(), ["id", "value"]].drop_duplicates()
    keyed = pd.DataFrame({"value": keyed["value"].to_numpy(), "at": keyed["id"].map(place).to_numpy(np.int64)})
    near = keyed.merge(keyed, on="value")
    near = near.loc[near["at_x"] < near["at_y"], ["at_x", "at_y"]].drop_duplicates().to_numpy(np.int64)  # nodes are in the order of their ids
    x, y, w = np.concatenate([src, near[:, 0]]), np.concatenate([dst, near[:, 1]]), np.concatenate([np.ones(len(src)), np.full(len(near), confidence)])
    n = len(nodes)
    least = _joined(n, x, y)
    order = np.argsort(least, kind="stable")  # a component after the other, each with its smallest id first
    nodes, least, moved = nodes.iloc[order].reset_index(drop=True), least[order], np.argsort(order)
    x, y = moved[x], moved[y]
    is_case, both, other = (nodes["label"] == "Case").to_numpy(), np.concatenate([x, y]), np.concatenate([y, x])
    met = np.unique(np.concatenate([np.stack([both, other], 1)[is_case[other]], np.flatnonzero(is_case)[:, None].repeat(2, 1)]), axis=0)
    station, _ = pd.factorize(nodes["station"])
    seen = np.stack([met[:, 0], station[met[:, 1]]], 1)
    seen = np.unique(seen[seen[:, 1] >= 0], axis=0)
    comp, _ = pd.factorize(least)
    sizes = np.bincount(comp)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    own = np.arange(n) - first[comp]
    far, gain = np.zeros(n), np.zeros(n)
    seen_comp = np.unique(np.stack([comp[is_case], station[is_case]], 1), axis=0)
    per = {
        "of_cases": np.bincount(comp[is_case], minlength=len(sizes)), "of_stations": np.bincount(seen_comp[seen_comp[:, 1] >= 0, 0], minlength=len(sizes)),
        "of_links": np.bincount(comp[x[: len(src)]], minlength=len(sizes)), "of_near": np.bincount(comp[x[len(src) :]], minlength=len(sizes)),
    }
    edge_comp = comp[both]
    by_edge = np.argsort(edge_comp, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(edge_comp, minlength=len(sizes)))])
    for size in np.unique(sizes[sizes > 1]):
        every, step = np.flatnonzero(sizes == size), max(1, cells // int(size) ** 2)
        for part in (every[i : i + step] for i in range(0, len(every), step)):
            graph = np.zeros((len(part), size, size))
            at = np.repeat(np.arange(len(part)), starts[part + 1] - starts[part])
            e = by_edge[np.concatenate([np.arange(starts[c], starts[c + 1]) for c in part])]
            graph[at, own[both[e]], own[other[e]]] = 1.0
            to = first[part][:, None] + np.arange(size)
            far[to], gain[to] = _brandes_dense(graph)
    found = pd.DataFrame({
        "node_id": nodes["id"], "label": nodes["label"], "in_degree": np.bincount(y, minlength=n), "out_degree": np.bincount(x, minlength=n), "weighted_degree": np.bincount(both, np.concatenate([w, w]), n),
        "cases": np.bincount(met[:, 0], minlength=n), "stations": np.bincount(seen[:, 0], minlength=n), "far": far, "gain": gain, "component": nodes["id"].to_numpy()[first[comp]], "n": sizes[comp],
    } | {k: v[comp] for k, v in per.items()})
    return found if not len(astray) else pd.concat([found.astype({"label": object}), pd.DataFrame(dict.fromkeys(found.columns, 0) | {"node_id": astray, "label": None, "component": astray})], ignore_index=True)


def _whole_groups(confidence: float, most: int = 100_000) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups in turn, `most` rows at once or little more; the last one of a batch may go on in the next."""
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= most:
                rows = pd.concat(held, ignore_index=True)
                goes_on = rows["group"] == rows["group"].iloc[-1]
                if not goes_on.all():
                    yield _measured(rows[~goes_on], confidence)
                held = [rows[goes_on]]
                n = len(held[0])
        if n:
            yield _measured(pd.concat(held, ignore_index=True), confidence)

    return run


def metrics_of_groups(cases: DataFrame, persons: DataFrame, links: DataFrame, confidence: float = 1.0, most_nodes: int = 256) -> DataFrame | None:
    """`metrics` of cases and persons with HAS_PERSON (links: case_id, person_id), and RELATED_TO of that confidence between all cases of one value.

    cases: case_id, station_id, person_id, value, where cases of one value are of one
    person; persons: person_id; no case has the id of a person. What is of one person
    meets in one task, which makes its edges, components and counts on them, so no
    edge is written or shuffled. Cases of more than `most_nodes` of a person are dealt
    by `metrics`. None where persons do not tell the components: a case_id is there
    twice, or a case has a link to another person than its own.
    """
    found = _groups(cases, persons, links, confidence, most_nodes)
    if found is None:
        return None
    made, rest = found
    out = _metrics_of(made)
    return out if rest is None else out.unionByName(metrics(*rest()))


def structure_of_groups(cases: DataFrame, persons: DataFrame, links: DataFrame, confidence: float = 1.0, most_nodes: int = 256) -> tuple[DataFrame, DataFrame] | None:
    """(`communities`, `metrics`) of the graph of `metrics_of_groups`, under its conditions: what is told of a component comes with its smallest node."""
    found = _groups(cases, persons, links, confidence, most_nodes, every=True)
    if found is None:
        return None
    made, rest = found
    nodes, edges = rest()
    placed = cut(with_components(nodes, edges), "metrics-placed")
    first = made.where("node_id = component and n > 1")
    told = lambda **of: F.map_filter(F.map_from_arrays(F.array(*map(F.lit, of)), F.array(*of.values())), lambda _, n: n > 0)
    both = F.col("of_links") + F.col("of_near")
    own = first.select(
        F.concat(F.lit("community:"), "component").alias("community_id"), F.col("n").alias("member_count"), F.round(F.coalesce(F.try_divide(2.0 * both, F.col("n") * (F.col("n") - 1)), F.lit(0.0)), 4).alias("density"), both.alias("edge_count"), F.col("of_cases").alias("case_count"), F.col("of_stations").alias("station_count"),
        (F.col("of_stations") > 1).alias("spans_cross_station"), told(Case=F.col("of_cases"), Person=F.col("n") - F.col("of_cases")).alias("labels"), told(HAS_PERSON=F.col("of_links"), RELATED_TO=F.col("of_near")).alias("edge_types"),
    )
    if placed.isEmpty():
        return own, _metrics_of(made)
    return own.unionByName(communities(placed, edges)), _metrics_of(made).unionByName(metrics(nodes, edges, placed))


def _metrics_of(made: DataFrame) -> DataFrame:
    n = F.col("n")
    return _with_roles(made.withColumns({"total_degree": F.col("in_degree") + F.col("out_degree"), "weighted_degree": F.round("weighted_degree", 4), "closeness": _closeness(n, F.col("far")), "betweenness": _betweenness(n, F.col("gain"))}))


def _groups(cases: DataFrame, persons: DataFrame, links: DataFrame, confidence: float, most_nodes: int, every: bool = False) -> tuple[DataFrame, Callable[[], tuple[DataFrame, DataFrame]] | None] | None:
    """(nodes of small groups as `_measured` tells them, nodes and edges of the others), or None as `metrics_of_groups`; without others they are None, or with `every` empty."""
    cases, persons = cases.where("case_id is not null"), persons.where("person_id is not null")
    links = links.where("case_id is not null and person_id is not null")
    if not cases.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return None
    large = cut(cases.groupBy("person_id").agg(F.count("*").alias("n")).where(F.col("person_id").isNotNull() & (F.col("n") >= most_nodes)).select("person_id"), "metrics-large")
    few, none = large.isEmpty(), F.lit(None).cast("string")
    within = lambda df, how: df.join(large, "person_id", how)
    small = (lambda df: df) if few else (lambda df: within(df, "left_anti"))
    rows = union(
        small(cases).select(F.coalesce("person_id", "case_id").alias("group"), F.col("case_id").alias("id"), F.lit("Case").alias("label"), F.col("station_id").alias("station"), none.alias("person"), "value"),
        small(persons).select(F.col("person_id").alias("group"), F.col("person_id").alias("id"), F.lit("Person").alias("label"), none.alias("station"), none.alias("person"), none.alias("value")),
        small(links).select(F.col("person_id").alias("group"), F.col("case_id").alias("id"), none.alias("label"), none.alias("station"), F.col("person_id").alias("person"), none.alias("value")),
    )
    dealt = rows.repartition(int(cases.sparkSession.conf.get("spark.sql.shuffle.partitions")), "group").sortWithinPartitions("group", "id")
    kinds = "node_id string, label string, in_degree long, out_degree long, weighted_degree double, cases long, stations long, far double, gain double, component string, n long, of_cases long, of_stations long, of_links long, of_near long"
    made = cut(dealt.mapInPandas(_whole_groups(confidence), kinds), "metrics-groups")
    astray = made.where("label is null").select(F.col("node_id").alias("case_id"))
    if not few:
        others = within(links, "left_semi").join(within(cases, "left_semi").select("case_id"), "case_id", "left_anti")
        astray = astray.unionByName(others.select("case_id"))
    if not cut(astray, "metrics-astray").join(cases, "case_id", "left_semi").isEmpty():
        return None
    def rest() -> tuple[DataFrame, DataFrame]:
        nodes = cut(union(node_rows(within(cases, "left_semi"), "case_id", "Case", "station_id"), node_rows(within(persons, "left_semi"), "person_id", "Person")), "metrics-nodes")
        near = shared(within(cases, "left_semi"), "value").withColumn("confidence", F.lit(confidence))
        return nodes, cut(union(edge_rows(within(links, "left_semi"), "case_id", "person_id", "HAS_PERSON", nodes), related_rows(near)), "metrics-edges")

    return made.where("label is not null"), rest if every or not few else None
