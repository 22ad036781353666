"""Synthetic case tables at any size, from a range and hashes: the same rows for the same seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Domains that the rows draw from.
CATEGORIES = {"PROPERTY": ("BURGLARY", "VEHICLE THEFT", "ROBBERY"), "CYBER": ("CARD FRAUD", "PHISHING"), "BODY": ("ASSAULT", "KIDNAPPING")}
DISTRICTS = ("Khurda", "Cuttack", "Puri", "Sambalpur", "Rourkela")
EVENTS = ("FIR_REGISTERED", "SITE_VISIT", "WITNESS_STATEMENT", "CHARGESHEET_FILED")
SECTIONS = {"PROPERTY": "BNS_303", "CYBER": "IT_66D", "BODY": "BNS_115"}


def _draw(seed: int, what: str, *of: Column) -> Column:
    """A non-negative hash of columns, by purpose."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), *of), F.lit(1 << 40))


def _pick(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def tables(spark: SparkSession, cases: int = 250, persons: int = 220, vehicles: int = 140, phones: int = 180, locations: int = 100, seed: int = 42) -> dict[str, DataFrame]:
    """cases, persons, vehicles, phones, locations, evidences and their links; one in ten links goes to a few shared entities."""
    n = F.col("id")
    kind = _draw(seed, "kind", n)
    flat = tuple((c, t) for c, ts in CATEGORIES.items() for t in ts)
    day = F.date_add(F.lit("2023-01-01").cast("date"), F.pmod(_draw(seed, "day", n), F.lit(730)).cast("int"))
    station = F.pmod(_draw(seed, "station", n), F.lit(6))
    c = spark.range(cases).select(
        F.format_string("C%010d", n).alias("case_id"), F.format_string("FIR-%d", n).alias("fir_number"), F.format_string("PS_%02d", station).alias("station_id"), _pick(DISTRICTS, station).alias("district"), day.alias("registration_date"),
        F.pmod(_draw(seed, "hour", n), F.lit(24)).cast("int").alias("incident_hour"), _pick(tuple(t for _, t in flat), kind).alias("crime_type"), _pick(tuple(x for x, _ in flat), kind).alias("crime_category"),
        F.format_string("L%010d", F.pmod(_draw(seed, "place", n), F.lit(locations))).alias("location_id"), _pick(("broke the lock at night", "sent a forged link by phone", "stolen vehicle left near the market"), _draw(seed, "text", n)).alias("description"),
    )
    p = spark.range(persons).select(F.format_string("P%010d", n).alias("person_id"), F.concat(F.lit("Person "), F.format_string("%c%c", (65 + F.pmod(n, F.lit(26))).cast("int"), (97 + F.pmod(F.floor(n / 26), F.lit(26))).cast("int")), F.lit(" Das")).alias("name"), F.date_format(F.date_add(F.lit("1960-01-01").cast("date"), F.pmod(_draw(seed, "dob", n), F.lit(16000)).cast("int")), "yyyy-MM-dd").alias("date_of_birth"))
    v = spark.range(vehicles).select(F.format_string("V%010d", n).alias("vehicle_id"), F.format_string("OD%02dA%c%04d", F.pmod(n, F.lit(33)) + 1, (65 + F.pmod(n, F.lit(26))).cast("int"), F.pmod(n * 7919, F.lit(10000))).alias("registration_number"))
    t = spark.range(phones).select(F.format_string("T%010d", n).alias("phone_id"), F.format_string("%d", n + 9000000000).alias("number"))
    places = spark.range(locations).select(F.format_string("L%010d", n).alias("location_id"), F.format_string("Ward %d Sq", n).alias("locality"), _pick(DISTRICTS, n).alias("district"), (F.lit(20.0) + F.pmod(n, F.lit(50)) / 100).alias("latitude"), (F.lit(85.0) + F.floor(n / 50) / 100).alias("longitude"))

    def link(what: str, prefix: str, size: int, column: str) -> DataFrame:
        shared = F.pmod(_draw(seed, what, n), F.lit(10)) == 0
        at = F.when(shared, F.pmod(_draw(seed, what + "s", n), F.lit(max(1, size // 20)))).otherwise(F.pmod(_draw(seed, what + "o", n), F.lit(size)))
        return spark.range(cases).select(F.format_string("C%010d", n).alias("case_id"), F.format_string(prefix + "%010d", at).alias(column))

    ev = spark.range(cases).select(F.format_string("C%010d", n).alias("case_id"), F.format_string("E%010d", n).alias("evidence_id"), _pick(("CCTV", "MOBILE", "DOCUMENT", "WEAPON"), _draw(seed, "ev", n)).alias("evidence_type"))
    return {"cases": c, "persons": p, "vehicles": v, "phones": t, "locations": places, "evidences": ev, "case_persons": link("p", "P", persons, "person_id"), "case_vehicles": link("v", "V", vehicles, "vehicle_id"), "case_phones": link("t", "T", phones, "phone_id")}


def histories(t: dict[str, DataFrame], seed: int = 42, most: int = 4) -> dict[str, DataFrame]:
    """investigation_events and case_sections of the cases of `tables`: one to `most` events a case in order of time, one section a case by its category."""
    case, at = F.col("case_id"), F.col("at")
    turns = F.sequence(F.lit(1), (F.pmod(_draw(seed, "events", case), F.lit(most)) + 1).cast("int"))
    rows = t["cases"].select("case_id", "registration_date", F.explode(turns).alias("at"))
    late = F.pmod(_draw(seed, "late", case), F.lit(9)).cast("int")
    events = rows.select(
        F.format_string("V-%s-%d", case, at).alias("event_id"), "case_id", F.element_at(F.array(*[F.lit(e) for e in EVENTS]), F.least(at, F.lit(len(EVENTS)))).alias("event_type"),
        F.date_add("registration_date", (at * 10 + late).cast("int")).cast("timestamp").alias("event_date"),
    )
    section = F.element_at(F.create_map(*[F.lit(x) for pair in SECTIONS.items() for x in pair]), F.col("crime_category"))
    return {"investigation_events": events, "case_sections": t["cases"].select("case_id", section.alias("section"))}


def planted(t: dict[str, DataFrame], clusters: int = 3, cases: int = 3, seed: int = 42) -> dict[str, DataFrame]:
    """The tables of `tables` with clusters of cases that belong together, and the truth about them.

    The cases of a cluster have one suspect, one phone, one method and different
    stations; every third cluster shares a vehicle too. Each suspect has a variant
    (the same birth date, the first name as an initial) and a decoy (the same name,
    another birth date), neither of whom is in a case. `truth` (cluster_id, case_id)
    and `people` (person_id, suspect_id, kind) are added.
    """
    spark = t["cases"].sparkSession
    g, m = F.col("g"), F.col("m")
    kinds = [("PROPERTY", "VEHICLE THEFT", "stolen vehicle left near the market"), ("PROPERTY", "BURGLARY", "broke the lock at night"), ("CYBER", "PHISHING", "sent a forged link by phone")]
    of = F.element_at(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("category", "type", "text"), k, strict=True)]) for k in kinds]), (F.pmod(g, F.lit(len(kinds))) + 1).cast("int"))
    rows = spark.range(clusters).select(F.col("id").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(cases - 1))).alias("m"), F.pmod(_draw(seed, "from", F.col("id")), F.lit(700)).cast("int").alias("start"))
    named = rows.withColumn("of", of).withColumn("case_id", F.format_string("K%06d%03d", g, m)).withColumn("station", F.pmod(g + m, F.lit(6)))
    found = named.select(
        "case_id", F.concat(F.lit("FIR-"), "case_id").alias("fir_number"), F.format_string("PS_%02d", "station").alias("station_id"), _pick(DISTRICTS, F.col("station")).alias("district"),
        F.date_add(F.lit("2023-01-01").cast("date"), F.col("start") + 2 * m).alias("registration_date"), (F.lit(20) + F.pmod(m, F.lit(4))).cast("int").alias("incident_hour"), F.col("of.type").alias("crime_type"), F.col("of.category").alias("crime_category"),
        F.lit(None).cast("string").alias("location_id"), F.col("of.text").alias("description"),
    )

    def link(prefix: str, column: str) -> DataFrame:
        return named.select("case_id", F.format_string(prefix + "%06d", g).alias(column), "g")

    one = spark.range(clusters).withColumnRenamed("id", "g")
    letters = F.format_string("%c%c%c", *[(F.pmod(F.floor(g / 26**i), F.lit(26)) + 97).cast("int") for i in range(3)])
    born = F.date_add(F.lit("1970-01-01").cast("date"), F.pmod(_draw(seed, "born", g), F.lit(9000)).cast("int"))
    person = lambda prefix, name, day: one.select(F.format_string(prefix + "%06d", g).alias("person_id"), name.alias("name"), F.date_format(day, "yyyy-MM-dd").alias("date_of_birth"))
    last = F.concat(F.lit(" Kor"), letters)
    suspects = person("KS", F.concat(F.lit("Mahendra"), last), born)
    variants = person("KV", F.concat(F.lit("M."), last), born)
    decoys = person("KD", F.concat(F.lit("Mahendra"), last), F.date_add(born, 400))
    kin = lambda prefix, kind: one.select(F.format_string(prefix + "%06d", g).alias("person_id"), F.format_string("KS%06d", g).alias("suspect_id"), F.lit(kind).alias("kind"))
    phones = one.select(F.format_string("KT%06d", g).alias("phone_id"), F.format_string("%d", g + 8000000000).alias("number"))
    cars = one.where(F.pmod(g, F.lit(len(kinds))) == 0).select(F.format_string("KV%06d", g).alias("vehicle_id"), F.format_string("OD%02dK%c%04d", F.pmod(g, F.lit(33)) + 1, (65 + F.pmod(g, F.lit(26))).cast("int"), F.pmod(g * 31 + 7, F.lit(10000))).alias("registration_number"))
    more = {
        "cases": found, "persons": suspects.unionByName(variants).unionByName(decoys), "phones": phones, "vehicles": cars, "case_persons": link("KS", "person_id").drop("g"), "case_phones": link("KT", "phone_id").drop("g"),
        "case_vehicles": link("KV", "vehicle_id").where(F.pmod(g, F.lit(len(kinds))) == 0).drop("g"),
    }
    truth = named.select(F.format_string("CLUSTER_%06d", g).alias("cluster_id"), "case_id")
    return {k: v.unionByName(more[k]) if k in more else v for k, v in t.items()} | {"truth": truth, "people": kin("KV", "VARIANT").unionByName(kin("KD", "DECOY"))}
