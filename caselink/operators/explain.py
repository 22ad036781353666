"""Evidence-backed explanations as projections of patterns, links, communities and connectors.

All return COLUMNS; `union` filters by subject, keeps one row per id and drops
rows with forbidden terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..store import cut
from .patterns import blocked

#: Terms that no explanation may hold, and the limitation sentences.
FORBIDDEN = (
    "guilty", "culprit", "perpetrator", "mastermind", "accomplice", "conspiracy", "criminal network", "offender", "criminal organization", "definitely committed", "certainly committed",
)
LIMITS = {
    "pattern": (
        "Shared pattern observations reflect empirical structural recurrence across cases.",
        "Pattern recurrence does not establish common criminal intent, legal guilt, or single-actor responsibility.",
    ),
    "method": ("Case similarity and operational crime characteristics do not prove that the same person or entity committed all associated cases.",),
    "relationship": (
        "Step 5B confidence scores measure analytical relationship strength based on shared entity attributes and signals.",
        "Relationship confidence does not establish joint illegal intent or legal liability.",
    ),
    "community": (
        "Community membership reflects graph structural connectivity under configured algorithmic criteria.",
        "Graph structural clustering does not establish joint illegal activity or organized group membership.",
    ),
    "connector": (
        "High structural centrality indicates topological network position across analytical graph paths.",
        "Network centrality does not imply leadership, criminal responsibility, or operational intent.",
    ),
}
#: Output texts as (title, observation, explanation), and parts of them.
TEXTS = {
    "pattern": ("Explanation for {title}", "Pattern observation '{title}' was detected with structural strength {strength} across {n} occurrences.", "The analytical pattern was derived because {description} Supporting signals include: {signals}."),
    "relationship": (
        "Explanation for Relationship Link ({level})", "Relationship link between Case {id1} and Case {id2} evaluated with {level} confidence (score: {score}).",
        "Step 5B Confidence Assessment: {level} confidence based on {counts} across {families} evidence categories. Relationship Confidence: {level} (Score: {rounded}). Contributing Evidence Categories ({families}): {names}.",
    ),
    "community": (
        "Explanation for Graph Community ({id})", "Graph structural community '{id}' identified with {n} member nodes and density {density}.",
        "Community cluster derived from graph structural modularity. Spans multiple police stations: {spans}. Total station count: {stations}.",
    ),
    "connector": (
        "Explanation for Network Connector Node ({label}:{id})", "Network node '{id}' ({label}) identified as high-centrality connector node connecting {cases} cases.",
        "High structural centrality detected with total degree {degree} and betweenness centrality {between}. Role summary: {role}.",
    ),
}
PARTS = {
    "high": "{n} high-confidence/exact signal(s)", "possible": "{n} possible/pattern signal(s)", "weak": "{n} weak signal(s)", "family": "Contributing Signal Family: {name}", "density": "Community Structural Density: {density}",
    "between": "Betweenness Centrality: {between}", "role": "Bridge Node", "cautious": "Person identity relies on name-only match without supporting DOB/phone evidence.",
    "context": "Only contextual similarity signals present; no direct entity or attribute overlaps.",
}
COLUMNS = ("explanation_id", "subject_id", "subject_type", "title", "observation", "explanation", "case_ids", "entity_ids", "signals", "weight", "limitations")


def _texts(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _none() -> Column:
    return F.array().cast("array<string>")


def _told(kind: str, key: Column, subject: Column, subject_type: Column, values: dict[str, Column], cases: Column, entities: Column, signals: Column, weight: Column, limits: Column) -> list[Column]:
    """The columns of an explanation whose texts are those of its kind."""
    title, observation, explanation = (N.said(t, **values) for t in TEXTS[kind])
    made = F.concat(F.lit(f"exp:{kind}:"), N.content_id(F.lit(f"exp:{kind}"), key))
    parts = (made, subject, subject_type, title, observation, explanation, cases, entities, signals, weight, limits)
    return [c.alias(n) for c, n in zip(parts, COLUMNS, strict=True)]


def of_patterns(patterns: DataFrame) -> DataFrame:
    c = F.col
    subject = F.coalesce("entity_id", "first_case", "pattern_id")
    kind = F.coalesce("entity_type", F.when(c("first_case").isNotNull(), "Case"), F.lit("Pattern"))
    limits = F.when(c("pattern_type") == "MODUS_OPERANDI", _texts(*LIMITS["pattern"], *LIMITS["method"])).otherwise(_texts(*LIMITS["pattern"]))
    values = {"title": c("title"), "strength": N.shown(c("strength")), "n": c("occurrence_count"), "description": c("description"), "signals": F.array_join("signals", ", ")}
    entities = F.when(c("entity_id").isNotNull(), F.array("entity_id")).otherwise(_none())
    return patterns.select(*_told("pattern", F.array(c("pattern_id"), subject), subject, kind, values, c("case_ids"), entities, c("signals"), c("strength"), limits))


def of_links(confidence: DataFrame) -> DataFrame:
    c = F.col
    some = lambda name: F.when(c(name) > 0, N.said(PARTS[name], n=c(name)))
    counted = F.array_join(F.array_compact(F.array(some("high"), some("possible"), some("weak"))), ", ")
    notes = F.array_sort(F.array_compact(F.array(F.when(c("cautious"), F.lit(PARTS["cautious"])), F.when(~c("direct"), F.lit(PARTS["context"])))))
    values = {
        "level": c("level"), "id1": c("id1"), "id2": c("id2"), "score": N.shown(c("score")), "counts": counted, "families": F.size("families"), "rounded": F.format_number("score", 2), "names": F.array_join("families", ", "),
    }
    signals = F.transform("families", lambda f: N.said(PARTS["family"], name=f))
    return confidence.select(*_told("relationship", F.array("pair_key"), c("pair_key"), F.lit("CasePair"), values, F.array("id1", "id2"), _none(), signals, c("score"), F.concat(_texts(*LIMITS["relationship"]), notes)))


def of_communities(communities: DataFrame) -> DataFrame:
    c = F.col
    values = {"id": c("community_id"), "n": c("member_count"), "density": N.shown(c("density")), "spans": F.when(c("spans_cross_station"), "True").otherwise("False"), "stations": c("station_count")}
    signals = F.array(N.said(PARTS["density"], density=values["density"]))
    return communities.select(*_told("community", F.array("community_id"), c("community_id"), F.lit("Community"), values, _none(), _none(), signals, F.round("density", 4), _texts(*LIMITS["community"])))


def of_connectors(metrics: DataFrame) -> DataFrame:
    c = F.col
    between = F.format_number("betweenness", 4)
    values = {"label": c("label"), "id": c("node_id"), "cases": c("cases"), "degree": c("total_degree"), "between": between, "role": F.coalesce("role", F.lit(PARTS["role"]))}
    signals = F.array(N.said(PARTS["between"], between=between))
    return metrics.where("is_connector").select(*_told("connector", F.array("node_id"), c("node_id"), c("label"), values, _none(), F.array("node_id"), signals, F.round("betweenness", 4), _texts(*LIMITS["connector"])))


def union(*parts: DataFrame, subject: str | None = None) -> DataFrame:
    """All explanations, or those of one subject; one row per id, without forbidden terms."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if subject is not None:
        out = out.where(F.col("subject_id") == subject)
    first = F.row_number().over(Window.partitionBy("explanation_id").orderBy("title", "observation"))
    kept = out.withColumn("k", first).where("k = 1").drop("k")
    return kept.where(~blocked(F.col("title"), F.col("observation"), F.col("explanation"), words=FORBIDDEN))


def link_id(pair_key: Column) -> Column:
    """The explanation_id of a link."""
    return F.concat(F.lit("exp:relationship:"), N.content_id(F.lit("exp:relationship"), F.array(pair_key)))


def ids_met_again(pairs: DataFrame) -> DataFrame:
    """id1, id2 of the pairs whose explanation id another pair has too.

    Ids are 48 bits of a hash, so they are few. Only the ids are shuffled, as whole numbers.
    """
    each = pairs.select("id1", "id2", F.conv(F.substring(link_id(N.pair_key(F.col("id1"), F.col("id2"))), -12, 12), 16, 10).cast("long").alias("h"))
    twice = cut(each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "explain-twice")
    if twice.isEmpty():
        return pairs.select("id1", "id2").where("false")
    return cut(each.join(twice, "h", "left_semi").select("id1", "id2"), "explain-again")


def union_of_links(told: DataFrame, again: DataFrame) -> DataFrame:
    """`union` of links (`of_links`), of which those with an id that is not theirs alone are given as `again`: no other is shuffled.

    again: all explanations of such ids; it says which one stays.
    """
    shared = again.select("explanation_id", "subject_id", F.row_number().over(Window.partitionBy("explanation_id").orderBy("title", "observation")).alias("k"))
    lost = cut(shared.where("k > 1").select("subject_id"), "explain-lost")
    # Through the explode no filter is pushed, which would repeat the making of the texts for each word.
    made = told.select(F.explode(F.array(F.struct(*COLUMNS))).alias("r")).select("r.*")
    kept = made.join(lost, "subject_id", "left_anti").select(*COLUMNS)
    return kept.where(~blocked(F.col("title"), F.col("observation"), F.col("explanation"), words=FORBIDDEN))


def in_order(explanations: DataFrame) -> DataFrame:
    return explanations.orderBy(F.desc(F.size("case_ids")), "subject_type", "explanation_id")


def histogram(explanations: DataFrame) -> DataFrame:
    return explanations.groupBy("subject_type").agg(F.count("*").alias("n"))
