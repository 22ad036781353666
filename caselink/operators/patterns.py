"""Recurring patterns: grouped observations with a strength and a stable id.

Each detector returns COLUMNS. With `members=True` (for a bounded scope) the rows
carry the sorted case ids, and the id is the digest of type, cases, entities and
signals. Over whole tables a group may hold any share of all cases, so by default
rows carry counts and the smallest case id, the id is the digest of type, entity
and signals, and `members_of` gives the cases as rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..store import ranked

#: Words that no observation may hold.
FORBIDDEN = ("criminal network", "mastermind", "accomplice", "gang", "conspiracy", "offender", "culprit", "guilty", "perpetrator")
#: Output texts of each detector as (title, description), and of signals.
TEXTS = {
    "method": ("Recurring Operational Characteristics Pattern: {crime_type}", "Identified {n} cases exhibiting matching crime category '{crime_category}' and operational crime type '{crime_type}'. Indicates shared operational characteristics across cases."),
    "Person": ("Recurring Person Entity Pattern across {n} Cases", "Person entity '{name}' is associated with {n} distinct cases across {stations} police station(s)."),
    "Location": ("Recurring Location Pattern across {n} Cases", "Location '{name}' is associated with {n} distinct cases across {stations} police station(s)."),
    "Vehicle": ("Recurring Vehicle Entity Pattern: {name}", "Vehicle entity '{name}' is associated with {n} distinct cases."),
    "Phone": ("Recurring Phone Entity Pattern: {name}", "Phone entity '{name}' is associated with {n} distinct cases."),
    "stations": ("Cross-Station Structural Pattern across {stations} Stations", "Identified structural case activity spanning {stations} police stations ({names})."),
    "characteristics": ("Structured Case Characteristic Combination: {crime_type} in {district}", "Identified {n} cases sharing matching crime category '{crime_category}', crime type '{crime_type}', and district '{district}'."),
    "temporal": ("Temporal Recurrence Cluster: {n} Cases in {window} Days", "Identified {n} cases registered within a {window}-day temporal window between {first} and {last}."),
    "community": ("Graph Structural Pattern: Community Cluster ({e})", "Identified dense graph community cluster '{e}' with {n} member nodes and structural density {density}."),
    "connector": ("Graph Structural Pattern: Network Connector ({label}:{e})", "Identified high-centrality network connector node '{e}' ({label}) connecting {cases} cases."),
}
SIGNALS = {
    "category": "Crime Category: {crime_category}", "type": "Crime Type: {crime_type}", "evidence": "Evidence Type: {kind}", "entity": "Shared {kind} Entity: {name} ({entity})", "stations": "Cross-Station Activity: {stations} Police Stations",
    "group": "Category: {crime_category}", "district": "District: {district}", "window": "Temporal Window: {window} Days", "span": "Span: {first} to {last}", "density": "Community Density: {density}", "members": "Member Count: {n}",
    "spans": "Spans Multiple Stations", "role": "Connector Role: {role}",
}
COLUMNS = ("pattern_id", "pattern_type", "title", "description", "case_ids", "first_case", "entity_id", "entity_type", "stations", "signals", "occurrence_count", "strength", "is_blocked")


def blocked(*texts: Column, words: tuple[str, ...] = FORBIDDEN) -> Column:
    """Whether a text holds a forbidden word."""
    low = F.lower(F.concat_ws(" ", *texts))
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def unblocked(rows: DataFrame, strict: bool = False) -> DataFrame:
    """Rows without forbidden words; strict raises on the first one instead."""
    if not strict:
        return rows.where(~F.col("is_blocked")).drop("is_blocked")
    return rows.withColumn("is_blocked", F.when(F.col("is_blocked"), F.raise_error(F.concat(F.lit("forbidden word in "), F.col("title"))).cast("boolean")).otherwise(False)).where(~F.col("is_blocked")).drop("is_blocked")


def _aggregates(members: bool) -> list[Column]:
    ids = F.array_sort(F.collect_set("case_id")) if members else F.array().cast("array<string>")
    return [F.count_distinct("case_id").alias("n"), F.min("case_id").alias("first_case"), F.count_distinct("station_id").alias("stations"), ids.alias("case_ids")]


def _finish(groups: DataFrame, kind: str, title: Column, description: Column, signals: Column, strength: Column, entity: Column | None = None, entity_type: str | None = None, members: bool = False) -> DataFrame:
    entity = F.lit(None).cast("string") if entity is None else entity
    cases = F.col("case_ids") if members else F.array().cast("array<string>")
    one = F.when(entity.isNotNull(), F.array(entity)).otherwise(F.array().cast("array<string>"))
    made = N.content_id(F.lit(kind), cases, one, signals)
    return groups.select(
        F.concat(F.lit(f"pat:{kind.lower()}:"), made).alias("pattern_id"), F.lit(kind).alias("pattern_type"), title.alias("title"), description.alias("description"), "case_ids", "first_case",
        entity.alias("entity_id"), F.lit(entity_type).cast("string").alias("entity_type"), F.col("stations"), signals.alias("signals"), F.col("n").alias("occurrence_count"), F.round(F.least(F.lit(1.0), strength), 4).alias("strength"),
        blocked(title, description).alias("is_blocked"),
    )


def _said(template: str, **more: Column) -> Column:
    """A template filled by the columns of its names, or by `more`."""
    names = set(re.findall(r"\{(\w+)\}", template))
    return N.said(template, **{n: more.get(n, F.col(n)) for n in names - set(more)}, **{n: more[n] for n in names & set(more)})


def _texts(key: str, **more: Column) -> tuple[Column, Column]:
    title, text = TEXTS[key]
    return _said(title, **more), _said(text, **more)


def modus_operandi(cases: DataFrame, evidences: DataFrame, recurrence: int = 2, members: bool = False) -> DataFrame:
    """Cases of one category and type; signals name the types of their evidence."""
    groups = cases.groupBy("crime_category", "crime_type").agg(*_aggregates(members)).where(F.col("n") >= recurrence)
    kinds = cases.select("case_id", "crime_category", "crime_type").join(evidences.select("case_id", "evidence_type"), "case_id").groupBy(F.col("crime_category").alias("c"), F.col("crime_type").alias("t")).agg(F.array_sort(F.collect_set("evidence_type")).alias("kinds"))
    joined = groups.join(kinds, F.col("crime_category").eqNullSafe(F.col("c")) & F.col("crime_type").eqNullSafe(F.col("t")), "left")
    named = F.transform(F.coalesce("kinds", F.array().cast("array<string>")), lambda k: _said(SIGNALS["evidence"], kind=k))
    signals = F.concat(F.array(_said(SIGNALS["category"]), _said(SIGNALS["type"])), named)
    title, text = _texts("method")
    return _finish(joined, "MODUS_OPERANDI", title, text, signals, F.col("n") / 5.0, members=members)


#: kind of entity: (pattern type, noun of its signal)
_ENTITIES = {"Person": "RECURRING_ENTITY", "Location": "RECURRING_LOCATION", "Vehicle": "RECURRING_VEHICLE_PHONE", "Phone": "RECURRING_VEHICLE_PHONE"}


def recurring(cases: DataFrame, links: DataFrame, entity: str, kind: str, name: str, recurrence: int = 2, members: bool = False) -> DataFrame:
    """An entity on several cases. links: case_id, the entity's id, and its shown name (the smallest case tells it)."""
    bridge = links.where(F.col(entity).isNotNull()).select("case_id", F.col(entity).alias("entity"), F.col(name).cast("string").alias("name")).distinct()
    groups = bridge.join(cases.select("case_id", "station_id"), "case_id").groupBy("entity").agg(*_aggregates(members), F.min_by("name", "case_id").alias("name")).where(F.col("n") >= recurrence)
    signals = F.array(_said(SIGNALS["entity"], kind=F.lit(kind)))
    title, text = _texts(kind)
    return _finish(groups, _ENTITIES[kind], title, text, signals, F.col("n") / 4.0, F.col("entity"), kind, members)


def cross_station(cases: DataFrame, recurrence: int = 2, members: bool = False) -> DataFrame:
    """One row for the whole input, if it spans two stations at least."""
    names = cases.where("station_id is not null and station_id <> ''").select("station_id").distinct().groupBy().agg(F.array_join(F.array_sort(F.collect_list("station_id")), ", ").alias("names"))
    whole = cases.groupBy().agg(*_aggregates(members)).where((F.col("stations") >= 2) & (F.col("n") >= recurrence)).join(names)
    signals = F.array(_said(SIGNALS["stations"]))
    title, text = _texts("stations")
    return _finish(whole, "GEOGRAPHIC_CROSS_STATION", title, text, signals, F.col("stations") / 4.0, members=members)


def characteristics(cases: DataFrame, recurrence: int = 2, members: bool = False) -> DataFrame:
    """Cases of one category, type and district."""
    groups = cases.groupBy("crime_category", "crime_type", "district").agg(*_aggregates(members)).where(F.col("n") >= recurrence)
    signals = F.array(_said(SIGNALS["group"]), _said(SIGNALS["type"]), _said(SIGNALS["district"]))
    title, text = _texts("characteristics")
    return _finish(groups, "CASE_CHARACTERISTIC", title, text, signals, F.col("n") / 5.0, members=members)


def temporal_sizes(cases: DataFrame, window_days: int = 30) -> DataFrame:
    """case_id, day, rank, n, end_day: the cluster that each case opens, of the cases behind it within the window.

    A cluster's size is the number of cases up to the end of the window less the
    position of its first case; only the table of days is ever ordered as a whole.
    """
    dated = cases.where("registration_date is not null").select("case_id", F.col("registration_date").alias("day"))
    placed = ranked(dated, "pattern-days", "day", "case_id")
    per_day = placed.groupBy("day").agg(F.count("*").alias("m"))
    number = F.datediff("day", F.lit("1970-01-01"))
    ahead = Window.orderBy(number).rangeBetween(0, window_days)
    upto = Window.orderBy(number).rangeBetween(Window.unboundedPreceding, window_days)
    days = per_day.select("day", F.sum("m").over(upto).alias("upto"), F.max("day").over(ahead).alias("end_day"))
    return placed.join(days, "day").select("case_id", "day", "rank", (F.col("upto") - F.col("rank") + 1).alias("n"), "end_day")


def temporal(cases: DataFrame, window_days: int = 30, recurrence: int = 2, members: bool = False) -> DataFrame:
    """Clusters of cases registered within a window; they overlap, one opens at each case."""
    if members:
        order = Window.orderBy(F.datediff("registration_date", F.lit("1970-01-01"))).rangeBetween(0, window_days)
        rows = F.collect_list(F.struct("registration_date", "case_id", "station_id")).over(order)
        seen = cases.where("registration_date is not null").withColumn("rows", rows)
        # A range frame holds the rows of the same day that sort before, too.
        own = F.filter("rows", lambda r: (r["registration_date"] > F.col("registration_date")) | (r["case_id"] >= F.col("case_id")))
        groups = seen.withColumn("rows", own).select(
            F.size("rows").cast("long").alias("n"), F.array_sort(F.transform("rows", lambda r: r["case_id"])).alias("case_ids"), F.col("case_id").alias("opens"), F.col("registration_date").alias("day"),
            F.array_max(F.transform("rows", lambda r: r["registration_date"])).alias("end_day"), F.size(F.array_compact(F.array_distinct(F.transform("rows", lambda r: r["station_id"])))).cast("long").alias("stations"),
        ).withColumn("first_case", F.element_at("case_ids", 1))
    else:
        groups = temporal_sizes(cases, window_days).select("n", F.array().cast("array<string>").alias("case_ids"), F.col("case_id").alias("opens"), "day", "end_day", F.lit(None).cast("long").alias("stations"), F.col("case_id").alias("first_case"))
    groups = groups.where(F.col("n") >= recurrence)
    ends = {"first": F.date_format("day", "yyyy-MM-dd"), "last": F.date_format("end_day", "yyyy-MM-dd"), "window": F.lit(window_days)}
    signals = F.array(_said(SIGNALS["window"], **ends), _said(SIGNALS["span"], **ends))
    title, text = _texts("temporal", **ends)
    entity = None if members else F.col("opens")
    out = _finish(groups, "TEMPORAL_CLUSTER", title, text, signals, F.col("n") / 5.0, entity, None, members)
    return out if members else out.withColumn("entity_id", F.lit(None).cast("string"))


def structural(communities: DataFrame, metrics: DataFrame) -> DataFrame:
    """Communities that span stations or are dense, and connector nodes."""
    none, null = F.array().cast("array<string>"), F.lit(None).cast("string")
    density = N.shown(F.col("density"))
    c = communities.where("spans_cross_station or density >= 0.2").select(F.col("community_id").alias("e"), F.col("member_count").alias("n"), none.alias("case_ids"), null.alias("first_case"), F.col("station_count").alias("stations"), "density", "spans_cross_station")
    c = c.withColumn("sg", F.array_compact(F.array(_said(SIGNALS["density"], density=density), _said(SIGNALS["members"]), F.when(F.col("spans_cross_station"), F.lit(SIGNALS["spans"])))))
    title, text = _texts("community", density=density)
    one = _finish(c, "GRAPH_STRUCTURAL", title, text, F.col("sg"), F.col("density"), F.col("e"), "Community")
    m = metrics.where("is_connector").select(F.col("node_id").alias("e"), "label", F.col("total_degree").cast("long").alias("n"), none.alias("case_ids"), null.alias("first_case"), F.col("stations"), "betweenness", "cases", "role")
    title, text = _texts("connector")
    two = _finish(m, "GRAPH_STRUCTURAL", title, text, F.array(_said(SIGNALS["role"])), F.col("betweenness"), F.col("e"), "Connector")
    return one.unionByName(two)


def finalize(patterns: DataFrame, recurrence: int = 2, least_signals: int = 1) -> DataFrame:
    """Patterns that recur and have signals, once per id."""
    kept = unblocked(patterns).where((F.col("occurrence_count") >= recurrence) & (F.size("signals") >= least_signals))
    first = F.row_number().over(Window.partitionBy("pattern_id").orderBy(F.desc("occurrence_count"), "title"))
    return kept.withColumn("k", first).where("k = 1").drop("k")


def in_order(patterns: DataFrame) -> DataFrame:
    return patterns.orderBy(F.desc("occurrence_count"), F.desc("strength"), "pattern_type", "pattern_id")


def histogram(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("pattern_type").agg(F.count("*").alias("n"))


def members_of(cases: DataFrame, keys: list[str]) -> DataFrame:
    """The cases of grouped patterns as rows: the group's keys and case_id."""
    return cases.select(*keys, "case_id").distinct()
