"""The whole analysis of a scope of cases as one DAG of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import explain, graph, links, patterns, privacy, report
from ..sources import lookups
from ..store import cut


@dataclass(frozen=True)
class Scope:
    stations: list[str] | None = None
    start: str | None = None
    end: str | None = None
    depth: int = 3
    max_cases: int | None = None
    window_days: int = 30

    def __post_init__(self):
        graph.check(self.depth)
        if self.max_cases is not None and not 1 <= self.max_cases <= 100:
            raise ValueError("max_cases must be from 1 to 100")


@dataclass(frozen=True)
class Analysis:
    cases: DataFrame
    links: DataFrame
    nodes: DataFrame
    edges: DataFrame
    metrics: DataFrame
    communities: DataFrame
    patterns: DataFrame
    explanations: DataFrame
    aliases: DataFrame
    masked: DataFrame
    report: DataFrame
    refused: DataFrame


def analyze(cases: DataFrame, persons: DataFrame, case_persons: DataFrame, vehicles: DataFrame, case_vehicles: DataFrame, evidences: DataFrame, scope: Scope | None = None, phones: DataFrame | None = None, case_phones: DataFrame | None = None) -> Analysis:
    """All stages for the cases of a scope. Communities and metrics are those of the scope's own graph."""
    scope = scope or Scope()
    chosen = lookups.filtered(cases, scope.stations, scope.start, scope.end)
    if scope.max_cases:
        chosen = chosen.orderBy("case_id").limit(scope.max_cases)
    chosen = cut(chosen, "analysis-cases")
    members = scope.max_cases is not None
    mine = lambda df: df.join(chosen.select("case_id"), "case_id", "left_semi")
    cp, cv, ev = mine(case_persons), mine(case_vehicles), mine(evidences)
    ct = mine(case_phones) if case_phones is not None else None
    quick = cut(links.quick_links(cp, cv, ct), "analysis-links")
    nodes = graph.union(
        graph.node_rows(chosen, "case_id", "Case", "station_id", fir_number="fir_number"),
        graph.node_rows(persons.join(cp.select("person_id").distinct(), "person_id", "left_semi"), "person_id", "Person", name="name"),
        graph.node_rows(vehicles.join(cv.select("vehicle_id").distinct(), "vehicle_id", "left_semi"), "vehicle_id", "Vehicle", registration="registration_number"),
        *([graph.node_rows(phones.join(ct.select("phone_id").distinct(), "phone_id", "left_semi"), "phone_id", "Phone", number="number")] if ct is not None else []),
    )
    nodes = cut(nodes, "analysis-nodes")
    edges = graph.union(
        graph.edge_rows(cp, "case_id", "person_id", "HAS_PERSON", nodes), graph.edge_rows(cv, "case_id", "vehicle_id", "HAS_VEHICLE", nodes),
        *([graph.edge_rows(ct, "case_id", "phone_id", "HAS_PHONE", nodes)] if ct is not None else []), graph.related_rows(quick, nodes),
    )
    edges = cut(edges, "analysis-edges")
    metrics = cut(graph.metrics(nodes, edges), "analysis-metrics")
    communities = cut(graph.communities(graph.with_components(nodes, edges), edges), "analysis-communities")
    person_names = cp.join(persons.select("person_id", "name"), "person_id")
    plates = cv.join(vehicles.select("vehicle_id", "registration_number"), "vehicle_id")
    numbers = ct.join(phones, "phone_id") if ct is not None else None
    found = patterns.modus_operandi(chosen, ev, members=members)
    for part in (
        *([patterns.recurring(chosen, numbers, "phone_id", "Phone", "number", members=members)] if numbers is not None else []),
        patterns.recurring(chosen, person_names, "person_id", "Person", "name", members=members),
        patterns.recurring(chosen, plates, "vehicle_id", "Vehicle", "registration_number", members=members),
        patterns.temporal(chosen, scope.window_days, members=members),
        patterns.cross_station(chosen, members=members),
        patterns.characteristics(chosen, members=members),
        patterns.structural(communities, metrics),
    ):
        found = found.unionByName(part)
    found = cut(patterns.finalize(found), "analysis-patterns")
    assessed = quick.select(
        "id1", "id2", F.concat_ws(":", "id1", "id2", F.lit("RELATED_TO")).alias("pair_key"), F.col("confidence").alias("score"), "level", F.array("family").alias("families"), F.lit(1).alias("high"), F.lit(0).alias("possible"), F.lit(0).alias("weak"),
        F.lit(True).alias("direct"), F.lit(False).alias("cautious"),
    )
    explained = cut(explain.union(explain.of_patterns(found), explain.of_links(assessed), explain.of_communities(communities), explain.of_connectors(metrics)), "analysis-explanations")
    value = lambda df, c: df.select("case_id", F.col(c).alias("value"))
    named = {"Person": value(person_names, "name").unionByName(value(cp, "person_id")), "Vehicle": value(plates, "registration_number").unionByName(value(cv, "vehicle_id"))}
    if numbers is not None:
        named["Phone"] = value(numbers, "number").unionByName(value(numbers, "phone_id"))
    known = privacy.alias_table(privacy.entity_values(chosen, **named), "analysis-values")
    aliases = cut(privacy.with_subjects(explained, cut(known, "analysis-known")), "analysis-aliases")
    masked = cut(privacy.masked_rows(explained, ["subject_id", "title", "observation", "explanation", "case_ids", "entity_ids", "signals"], aliases, "explanation_id"), "analysis-masked")
    return Analysis(chosen, quick, nodes, edges, metrics, communities, found, explained, aliases, masked, report.statements(masked, explain.FORBIDDEN), report.refused(masked, explain.FORBIDDEN))
