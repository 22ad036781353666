"""Relationship signals and their confidence, as a long table.

Signals are rows (id1, id2, rel_type, score, certainty, unverified); confidence is
two aggregations over them. Shared attributes come from equi-joins on the
attribute, not from comparing all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import normalize as N
from . import blocking

#: The family of each relationship type.
FAMILIES = {
    "SHARED_HIGH_CONFIDENCE_PERSON": "PERSON_IDENTITY",
    "POSSIBLE_PERSON_RELATIONSHIP": "PERSON_IDENTITY",
    "SHARED_PHONE": "CONTACT",
    "SHARED_VEHICLE": "VEHICLE",
    "SHARED_LOCATION": "LOCATION",
    "SIMILAR_MODUS_OPERANDI": "BEHAVIORAL",
    "SIMILAR_CRIME_CATEGORY": "BEHAVIORAL",
    "SIMILAR_LEGAL_SECTIONS": "LEGAL",
    "TEMPORAL_PROXIMITY": "TEMPORAL",
}
DIRECT = ("PERSON_IDENTITY", "CONTACT", "VEHICLE", "LOCATION")
COLUMNS = ("id1", "id2", "rel_type", "score", "certainty", "unverified")


def _rows(df: DataFrame, rel_type: str, score, certainty: str) -> DataFrame:
    return df.select("id1", "id2", F.lit(rel_type).alias("rel_type"), score.cast("double").alias("score"), F.lit(certainty).alias("certainty"), F.lit(False).alias("unverified"))


def shared(links: DataFrame, value: str) -> DataFrame:
    """id1, id2, value: pairs of cases that share a value, id1 < id2."""
    rows = links.where(F.col(value).isNotNull()).select("case_id", F.col(value).alias("value")).distinct()
    a, b = rows.alias("a"), rows.alias("b")
    joined = a.join(b, (F.col("a.value") == F.col("b.value")) & (F.col("a.case_id") < F.col("b.case_id")))
    return joined.select(F.col("a.case_id").alias("id1"), F.col("b.case_id").alias("id2"), F.col("a.value").alias("value"))


def _each_shared(paired: DataFrame, field: str) -> DataFrame:
    return paired.select("id1", "id2", F.explode(F.array_intersect(F.col(f"a.{field}"), F.col(f"b.{field}"))))


def phone_signals(paired: DataFrame) -> DataFrame:
    """One row per valid number that both cases of a pair have."""
    return _rows(_each_shared(paired, "numbers"), "SHARED_PHONE", F.lit(1.0), "EXACT_ATTRIBUTE_MATCH")


def vehicle_signals(paired: DataFrame) -> DataFrame:
    """One row per registration, valid or not, that both cases of a pair have."""
    return _rows(_each_shared(paired, "plates"), "SHARED_VEHICLE", F.lit(1.0), "EXACT_ATTRIBUTE_MATCH")


def location_score() -> Column:
    """Of feature rows a and b, or null: near coordinates (up to 15 km), or where either side lacks them, overlapping words of places that have a locality or an address."""
    c = lambda side, f: F.col(f"{side}.{f}")
    points = N.valid_point(c("a", "latitude"), c("a", "longitude")) & N.valid_point(c("b", "latitude"), c("b", "longitude"))
    km = N.haversine_km(c("a", "latitude"), c("a", "longitude"), c("b", "latitude"), c("b", "longitude"))
    words = N.jaccard(F.array_distinct(N.words(c("a", "place"))), F.array_distinct(N.words(c("b", "place"))))
    return F.when(points, F.when(km <= 1.0, 1.0).when(km <= 15.0, F.round(1 - km / 15.0 * 0.5, 4))).when(c("a", "has_place") & c("b", "has_place") & (words >= 0.70), 0.75)


def location_signals(paired: DataFrame) -> DataFrame:
    return _rows(paired.withColumn("s", location_score()).where("s is not null"), "SHARED_LOCATION", F.col("s"), "CORRELATIONAL")


def trait_signals(compared: DataFrame) -> DataFrame:
    """Signals that similarity passes on: sections and time where MATCH or PARTIAL, category where MATCH."""
    each = compared.select("id1", "id2", F.explode("signals").alias("x")).select("id1", "id2", "x.*")
    kinds = {
        "MODUS_OPERANDI": ("SIMILAR_MODUS_OPERANDI", "INFERRED_PATTERN"),
        "LEGAL_SECTIONS": ("SIMILAR_LEGAL_SECTIONS", "CONTEXTUAL"),
        "TEMPORAL": ("TEMPORAL_PROXIMITY", "CORRELATIONAL"),
        "CRIME_CATEGORY": ("SIMILAR_CRIME_CATEGORY", "CONTEXTUAL"),
    }
    pick = lambda i: F.coalesce(*[F.when(F.col("name") == k, v[i]) for k, v in kinds.items()])
    kept = each.where(F.col("name").isin(*kinds) & ((F.col("status") == "MATCH") | ((F.col("status") == "PARTIAL") & (F.col("name") != "CRIME_CATEGORY"))))
    return kept.select("id1", "id2", pick(0).alias("rel_type"), "score", pick(1).alias("certainty"), F.lit(False).alias("unverified"))


def person_signals(pairs: DataFrame) -> DataFrame:
    """One row for each person pair of two cases: id1, id2, decision, same_name, same_sound (a shared person has decision HIGH)."""
    high, possible = F.col("decision") == "HIGH_CONFIDENCE_MATCH", F.col("decision") == "POSSIBLE_MATCH"
    score = F.when(high, 1.0).when(possible, 0.70).when(F.col("same_name"), 0.35).when(F.col("same_sound"), 0.40)
    return pairs.withColumn("s", score).where("s is not null").select(
        "id1", "id2", F.when(high, "SHARED_HIGH_CONFIDENCE_PERSON").otherwise("POSSIBLE_PERSON_RELATIONSHIP").alias("rel_type"), F.col("s").alias("score"),
        F.when(high, "HIGH_CONFIDENCE_ENTITY").when(possible, "POSSIBLE_ENTITY").otherwise("WEAK_UNVERIFIED").alias("certainty"), (~high & ~possible).alias("unverified"),
    )


def analyze_pairs(pairs: DataFrame, features: DataFrame, people: DataFrame, methods: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """All signals of case pairs (id1, id2) as one long table; a case has none with itself.

    people: one row for each pair of persons of two cases, as in `person_signals`;
    methods: id1, id2, score, status of the method signal.
    """
    from .similarity import compare, paired

    each = pairs.where("id1 <> id2").select("id1", "id2")
    both = paired(each, features)
    rows = person_signals(people.join(each, ["id1", "id2"], "left_semi"))
    for more in (phone_signals(both), vehicle_signals(both), location_signals(both), trait_signals(compare(each, features, methods=methods, s=s))):
        rows = rows.unionByName(more)
    return rows


def _map(table: dict, column: str, default):
    return F.coalesce(*[F.when(F.col(column) == k, F.lit(v)) for k, v in table.items()], F.lit(default))


def confidence(signals: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """id1, id2, pair_key, score, level, families, signals, high, possible, weak for each pair with signals.

    Within a family the strongest signal counts in full and each other one a
    quarter; then 0.70 of the best family and 0.30 of the rest, a bonus for
    independent families, a penalty for a name without other evidence, and a cap
    where only context speaks. Sums are of whole numbers - weights in hundredths,
    scores in ten-thousandths, quarters and hundredths of their product - so that
    halves round up whatever the order of rows.
    """
    weight = _map({k: round(100 * w) for k, w in s.link_weights.items()}, "rel_type", round(100 * s.link_default))
    rows = signals.withColumn("family", _map(FAMILIES, "rel_type", "OTHER")).withColumn("worth", weight.cast("long") * F.round(F.col("score") * 10_000).cast("long"))
    place = F.row_number().over(Window.partitionBy("id1", "id2", "family").orderBy(F.desc("worth"), "rel_type"))
    families = (
        rows.withColumn("n", place).groupBy("id1", "id2", "family").agg(
            F.sum(F.col("worth") * F.when(F.col("n") == 1, 4).otherwise(1)).alias("worth"),
            F.count("*").alias("signals"),
            F.bool_or(F.col("rel_type") == "SHARED_HIGH_CONFIDENCE_PERSON").alias("sure"),
            F.bool_or("unverified").alias("unverified"),
            F.count_if(F.col("certainty").isin("HIGH_CONFIDENCE_ENTITY", "EXACT_ATTRIBUTE_MATCH")).alias("high"),
            F.count_if(F.col("certainty").isin("POSSIBLE_ENTITY", "CORRELATIONAL", "INFERRED_PATTERN", "CONTEXTUAL")).alias("possible"),
        )
    )
    per = families.groupBy("id1", "id2").agg(
        F.max("worth").alias("top"), F.sum("worth").alias("all"), F.count("*").alias("n"), F.sum("signals").alias("signals"), F.bool_or("sure").alias("sure"), F.bool_or("unverified").alias("unverified"),
        F.bool_or(F.col("family").isin(*DIRECT)).alias("direct"), F.array_sort(F.collect_set("family")).alias("families"), F.sum("high").alias("high"), F.sum("possible").alias("possible"),
    )
    return _confidence(per, s)


def _confidence(per: DataFrame, s: Settings) -> DataFrame:
    """`confidence` from top, all (worth), n (families), families, direct, signals, sure, unverified, high and possible of each pair."""
    n = F.col("n")
    one = 400_000_000  # a score of 1: 100 (weight) x 10 000 (score) x 4 (quarters) x 100 (0.70 and 0.30)
    part = lambda x: F.lit(round(one * x)).cast("long")
    bonus = F.when(n >= 2, part(0.15)).otherwise(0) + F.when(n >= 3, part(0.10)).otherwise(0) + F.when(n >= 4, (n - 3) * part(0.05)).otherwise(0)
    raw = 70 * F.col("top") + 30 * (F.col("all") - F.col("top")) + bonus - F.when(F.col("unverified") & ~F.col("sure"), part(0.10)).otherwise(0)
    held = F.least(part(1.0), F.greatest(part(0.0), F.when(F.col("direct"), raw).otherwise(F.least(part(0.45), raw))))
    step = one // 10_000
    score = F.floor((held + step // 2) / step) / 10_000
    level = F.when(F.col("score") >= s.link_very_high, "VERY_HIGH").when(F.col("score") >= s.link_high, "HIGH").when(F.col("score") >= s.link_moderate, "MODERATE").when(F.col("score") >= s.link_low, "LOW").otherwise("INSUFFICIENT_DATA")
    return per.withColumn("score", score).withColumn("level", level).select(
        "id1", "id2", N.pair_key(F.col("id1"), F.col("id2")).alias("pair_key"), "score", "level", "families", "signals", "high", "possible", (F.col("signals") - F.col("high") - F.col("possible")).alias("weak"), "direct",
        (F.col("unverified") & ~F.col("sure")).alias("cautious"),
    )


def confidence_met(met: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """`confidence` of all signals of the pairs of `similarity.met_by_name`, told from the pair itself: no signal is a row, and nothing is grouped.

    Signals of a family are one full and the others a quarter, which in quarters is
    their sum and three times the strongest.
    """
    from . import similarity as S

    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    known = lambda x: F.when(both, x)
    count = lambda field: F.coalesce(known(F.size(F.array_intersect(F.col(f"a.{field}"), F.col(f"b.{field}")))), F.lit(0)).cast("long")
    of = lambda d: (F.size("people") - F.size(F.array_remove("people", d))).cast("long")
    out = met.select(
        "id1", "id2", of("HIGH_CONFIDENCE_MATCH").alias("sure_n"), of("POSSIBLE_MATCH").alias("possible_n"), F.size("people").cast("long").alias("people_n"), count("numbers").alias("phones"), count("plates").alias("vehicles"),
        known(location_score()).alias("near"), known(S.category("a", "b", s)).alias("category"), known(S.legal("a", "b", s)).alias("legal"), known(S.time("a", "b", s)).alias("time"), "ms", "mst",
    )
    worth = lambda kind, score: F.lit(round(100 * s.link_weights.get(kind, s.link_default))).cast("long") * F.round(score * 10_000).cast("long")
    given = lambda status, score, *kinds: F.when(status.isin(*kinds), score)
    c = F.col
    out = out.withColumn("weak_n", c("people_n") - c("sure_n") - c("possible_n")).withColumns({
        "behavior": given(c("mst"), worth("SIMILAR_MODUS_OPERANDI", c("ms")), "MATCH", "PARTIAL"), "alike": given(c("category.status"), worth("SIMILAR_CRIME_CATEGORY", c("category.score")), "MATCH"),
        "lawful": given(c("legal.status"), worth("SIMILAR_LEGAL_SECTIONS", c("legal.score")), "MATCH", "PARTIAL"), "timely": given(c("time.status"), worth("TEMPORAL_PROXIMITY", c("time.score")), "MATCH", "PARTIAL"),
        "placed": worth("SHARED_LOCATION", c("near")),
    })
    kinds = {"sure_n": worth("SHARED_HIGH_CONFIDENCE_PERSON", F.lit(1.0)), "possible_n": worth("POSSIBLE_PERSON_RELATIONSHIP", F.lit(0.70)), "weak_n": worth("POSSIBLE_PERSON_RELATIONSHIP", F.lit(0.35))}
    z, has = lambda x: F.coalesce(c(x), F.lit(0).cast("long")), lambda x: F.when(c(x).isNotNull(), 1).otherwise(0).cast("long")
    repeated = lambda n, w: F.when(c(n) > 0, w * (c(n) + 3)).otherwise(0).cast("long")
    strongest = F.greatest(*[F.when(c(n) > 0, w).otherwise(0).cast("long") for n, w in kinds.items()])
    families = {  # (worth in quarters, signals), by name
        "BEHAVIORAL": (z("behavior") + z("alike") + 3 * F.greatest(z("behavior"), z("alike")), has("behavior") + has("alike")),
        "CONTACT": (repeated("phones", worth("SHARED_PHONE", F.lit(1.0))), c("phones")),
        "LEGAL": (4 * z("lawful"), has("lawful")),
        "LOCATION": (4 * z("placed"), has("placed")),
        "PERSON_IDENTITY": (sum((c(n) * w for n, w in kinds.items()), 3 * strongest), c("people_n")),
        "TEMPORAL": (4 * z("timely"), has("timely")),
        "VEHICLE": (repeated("vehicles", worth("SHARED_VEHICLE", F.lit(1.0))), c("vehicles")),
    }
    out = out.withColumns({f"w_{k}": w for k, (w, _) in families.items()} | {f"n_{k}": n for k, (_, n) in families.items()})
    every = lambda x: [c(f"{x}_{k}") for k in families]
    direct = F.lit(False)
    for k in DIRECT:
        direct |= c(f"n_{k}") > 0
    per = out.select(
        "id1", "id2", F.greatest(*every("w")).alias("top"), sum(every("w"), F.lit(0).cast("long")).alias("all"), sum((F.when(n > 0, 1).otherwise(0).cast("long") for n in every("n")), F.lit(0).cast("long")).alias("n"), sum(every("n"), F.lit(0).cast("long")).alias("signals"),
        (c("sure_n") > 0).alias("sure"), (c("weak_n") > 0).alias("unverified"), direct.alias("direct"), F.array_compact(F.array(*[F.when(c(f"n_{k}") > 0, k) for k in families])).alias("families"),
        (c("sure_n") + c("phones") + c("vehicles")).alias("high"), (c("possible_n") + has("placed") + has("timely") + has("behavior") + has("alike") + has("lawful")).alias("possible"),
    )
    return _confidence(per, s)


def quick_links(case_persons: DataFrame, case_vehicles: DataFrame, case_phones: DataFrame | None = None) -> DataFrame:
    """id1, id2, confidence, level, family of pairs that share a person, vehicle or phone by id.

    Cases carry all their ids, so one equi-join tells a pair and what it shares, and no pair is shuffled.
    """
    parts = {"P": (case_persons, "person_id"), "V": (case_vehicles, "vehicle_id")} | ({"T": (case_phones, "phone_id")} if case_phones is not None else {})
    rows = None
    for kind, (links, value) in parts.items():
        each = links.where(F.col("case_id").isNotNull() & F.col(value).isNotNull()).select(F.lit(kind).alias("signal"), F.col(value).cast("string").alias("key"), F.col("case_id").alias("id"))
        rows = each if rows is None else rows.unionByName(each)
    joined, found = blocking.met(blocking.carried(rows, list(parts)), list(parts))
    flags = joined.select(F.col("a.id").alias("id1"), F.col("b.id").alias("id2"), found.alias("found"))
    has = lambda k: F.array_contains("found", k)
    score = F.when(has("P") & has("V"), 0.95).when(has("P"), 0.85).otherwise(0.70)
    return flags.select(
        "id1", "id2", score.alias("confidence"), F.when(score >= 0.85, "VERY_HIGH").otherwise("HIGH").alias("level"),
        F.when(has("P"), "PERSON_IDENTITY").when(has("V"), "VEHICLE").otherwise("CONTACT").alias("family"),
    )
