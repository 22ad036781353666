"""The registered queries: every operator over the whole tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import blocking, explain, features, graph, links, patterns, privacy, report, resolve, similarity
from ..sources import lookups
from ..sources.domain import views
from ..store import components_in_turn, cut, release

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _v(spark: SparkSession, sf: str, *names: str):
    found = views(spark, sf, *names)
    return found if len(found) > 1 else found[0]


def _line(c):
    """An array as one string."""
    return F.array_join(c, ",")


# Lookups -----------------------------------------------------------------


@query
def case_lookup(spark, sf):
    return lookups.by_key(_v(spark, sf, "cases"), "case_id", "C0000000007")


@query
def person_by_key(spark, sf):
    return lookups.first_by(_v(spark, sf, "persons"), "person_id", "P0000000011", "person_id").select("person_id", "name", "date_of_birth")


@query
def vehicle_by_registration(spark, sf):
    return lookups.first_by(_v(spark, sf, "vehicles"), "registration_number", "OD00-ab0000", "vehicle_id")


@query
def evidence_of_case(spark, sf):
    return lookups.by_key(_v(spark, sf, "evidences"), "case_id", "C0000000007")


@query
def evidence_by_type(spark, sf):
    return lookups.by_key(_v(spark, sf, "evidences"), "evidence_type", "MOBILE")


@query
def paged_scan(spark, sf):
    return lookups.page(_v(spark, sf, "cases"), "case_id", 100, 50).select("case_id", "fir_number", "crime_type")


@query
def cases_by_district(spark, sf):
    return lookups.some_by(_v(spark, sf, "cases"), "district", "NATION_3", "case_id").select("case_id", "district")


@query
def cases_by_category(spark, sf):
    return lookups.some_by(_v(spark, sf, "cases"), "crime_category", "P", "case_id").select("case_id", "crime_category")


@query
def persons_ilike(spark, sf):
    return lookups.name_contains(_v(spark, sf, "persons"), "name", "SHRI r", "person_id").select("person_id", "name")


@query
def case_timeline(spark, sf):
    return lookups.timeline(_v(spark, sf, "investigation_events"), "C0000000008").select("event_id", "event_type", F.date_format("event_date", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query
def gather_cases(spark, sf):
    targets = spark.createDataFrame([("FIR-9", 1), ("C0000000003", 2), ("missing", 3), ("C0000000009", 4), ("FIR-12", 5)], "target string, position int")
    return lookups.gather(_v(spark, sf, "cases"), targets).select("case_id", "fir_number")


@query
def cases_in_scope(spark, sf):
    return lookups.filtered(_v(spark, sf, "cases"), ["PS_01", "PS_02"], "1996-01-01", "1997-12-31").select("case_id", "station_id", F.date_format("registration_date", "yyyy-MM-dd").alias("day"))


@query
def table_counts(spark, sf):
    names = ("cases", "persons", "vehicles", "phones", "locations", "evidences", "case_persons", "investigation_events")
    parts = [df.groupBy().agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, df in zip(names, _v(spark, sf, *names), strict=True)]
    parts.append(_v(spark, sf, "cases").groupBy().agg(F.count_distinct("station_id").alias("n")).select(F.lit("stations").alias("name"), "n"))
    return graph.union(*parts)


@query
def case_children(spark, sf):
    cases, cp, ev, events, sections = _v(spark, sf, "cases", "case_persons", "evidences", "investigation_events", "case_sections")
    out = lookups.with_children(cases, persons=cp, evidences=ev.select("case_id", "evidence_type"), events=events.select("case_id", "event_id"), sections=sections)
    more = [F.array_join(F.transform(c, lambda e: e[f]), ",").alias(c) for c, f in (("events", "event_id"), ("sections", "section"))]  # noqa: B023
    return out.select("case_id", *more, F.array_join(F.transform("persons", lambda p: F.concat_ws("/", p["person_id"], p["role"])), ",").alias("persons"), F.array_join(F.transform("evidences", lambda e: e["evidence_type"]), ",").alias("evidences"))


# Normalization -------------------------------------------------------------


@query
def normalize_person(spark, sf):
    n = _v(spark, sf, "persons").select("person_id", N.person(F.col("name")).alias("p"))
    return n.select("person_id", "p.normalized", "p.phonetic", F.col("p.word_count").cast("long").alias("word_count"), "p.has_initials", "p.alias", "p.alias_phonetic")


@query
def soundex_words(spark, sf):
    words = spark.read.parquet(f"{sf}/documents.parquet").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("word")).distinct()
    return words.select("word", N.soundex(F.col("word")).alias("code"))


@query
def normalize_phone(spark, sf):
    return _v(spark, sf, "phones").select("phone_id", N.phone(F.col("number")).alias("p")).select("phone_id", "p.normalized", "p.is_valid")


@query
def normalize_vehicle(spark, sf):
    return _v(spark, sf, "vehicles").select("vehicle_id", N.vehicle(F.col("registration_number")).alias("v")).select("vehicle_id", "v.*")


@query
def normalize_location(spark, sf):
    return _v(spark, sf, "persons").select("person_id", N.location(F.col("address")).alias("place"))


@query
def normalize_method(spark, sf):
    t = _v(spark, sf, "narratives").select("doc_id", N.method_tokens(F.col("description")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("tokens"), F.size(N.keywords(F.col("t"))).cast("long").alias("keywords"), F.md5(F.array_join("t", " ")).alias("digest"))


@query
def normalize_evidence(spark, sf):
    t = _v(spark, sf, "narratives").select("doc_id", N.evidence_tokens(F.col("description")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query
def time_buckets(spark, sf):
    e = _v(spark, sf, "investigation_events").select("event_id", N.moment(F.col("event_date")).alias("m"), N.weekday(F.col("event_date")).alias("weekday"))
    return e.select("event_id", "m.iso", "m.year", "m.month", "m.day", "m.hour", N.time_bucket(F.col("m.hour")).alias("bucket"), "weekday", _line("m.tokens").alias("tokens"))


@query
def geo_distance(spark, sf):
    a = _v(spark, sf, "locations").select("location_id", "latitude", "longitude", F.substring("location_id", 2, 10).cast("long").alias("k"))
    b = a.select(F.col("location_id").alias("other"), F.col("latitude").alias("lat2"), F.col("longitude").alias("lon2"), (F.col("k") - 3).alias("k"))
    km = N.haversine_km(F.col("latitude"), F.col("longitude"), F.col("lat2"), F.col("lon2"))
    return a.join(b, "k").select("location_id", "other", F.round(km, 4).alias("km"), F.round(F.exp(-km / 10.0), 4).alias("nearness"), N.valid_point(F.col("latitude"), F.col("longitude")).alias("is_valid"))


@query
def legal_codes(spark, sf):
    return _v(spark, sf, "case_sections").select("section").distinct().select("section", N.section_code(F.col("section")).alias("code"))


@query
def pair_keys(spark, sf):
    cp = _v(spark, sf, "case_persons")
    return cp.select(N.pair_key(F.col("person_id"), F.col("case_id")).alias("pair_key"), F.concat(F.lit("sig:"), N.content_id(F.lit("sig"), F.array("person_id", "case_id"))).alias("content_id"))


# Blocking and resolution -----------------------------------------------------


def _pairs(df: DataFrame) -> DataFrame:
    return df.select("id1", "id2", _line("signals").alias("signals"))


@query
def block_persons(spark, sf):
    return _pairs(blocking.block_persons(_v(spark, sf, "persons")))


@query
def block_person_buckets(spark, sf):
    return blocking.buckets(blocking.person_keys(_v(spark, sf, "persons")))


@query
def block_persons_skewed(spark, sf):
    """Blocking where one name holds a third of all persons: a row for each id instead of each pair."""
    return blocking.classes(blocking.person_keys(_v(spark, sf, "persons_skewed")))


@query
def block_phones(spark, sf):
    return _pairs(blocking.block_phones(_v(spark, sf, "phones")))


@query
def block_vehicles(spark, sf):
    return _pairs(blocking.block_vehicles(_v(spark, sf, "vehicles")))


@query
def block_locations(spark, sf):
    return _pairs(blocking.block_locations(_v(spark, sf, "locations")))


@query
def block_method_buckets(spark, sf):
    return blocking.buckets(blocking.method_keys(_v(spark, sf, "narratives"), "doc_id"))


@query
def block_methods(spark, sf):
    return _pairs(blocking.block_methods(_v(spark, sf, "narratives"), "doc_id"))


@query
def resolve_persons(spark, sf):
    return resolve.resolve_blocked(_v(spark, sf, "persons")).select("id1", "id2", "score", "decision", _line("matching").alias("matching"), _line("conflicting").alias("conflicting"))


@query
def resolve_phones(spark, sf):
    p = _v(spark, sf, "phones")
    return resolve.resolve_phones(blocking.block_phones(p), p)


@query
def resolve_vehicles(spark, sf):
    v = _v(spark, sf, "vehicles")
    return resolve.resolve_vehicles(blocking.block_vehicles(v), v)


@query
def resolve_locations(spark, sf):
    p = _v(spark, sf, "locations")
    return resolve.resolve_locations(blocking.block_locations(p), p)


# Features and similarity -----------------------------------------------------


def _features(spark, sf, in_turn: bool = False) -> DataFrame:
    """in_turn: written, one set after the other, and without evidence, which no pair is judged by."""
    cases, cp, vehicles, cv, phones, ct, sections, places, ev, texts = _v(spark, sf, "cases", "case_persons", "vehicles", "case_vehicles", "phones", "case_phones", "case_sections", "locations", "evidences", "case_texts")
    plates = cv.join(vehicles.select("vehicle_id", "registration_number"), "vehicle_id")
    numbers = ct.join(phones, "phone_id")
    return features.extract(cases.join(texts, "case_id", "left"), cp, plates, numbers, sections, places, None if in_turn else ev, in_turn)


@query
def case_features(spark, sf):
    f = _features(spark, sf)
    return f.select(
        "case_id", "fir_number", "time_bucket", "weekday", "place", "has_place", F.round("latitude", 4).alias("latitude"), F.md5(F.coalesce("method", F.lit(""))).alias("method"), "method_source",
        _line("persons").alias("persons"), _line("plates").alias("plates"), _line("numbers").alias("numbers"), _line("sections").alias("sections"), _line("evidence").alias("evidence"),
    )


def _people_pairs(spark, sf) -> DataFrame:
    """id1, id2 (cases), x, y (persons), decision, same_name, same_sound: case pairs of one person, or of two persons of the same name."""
    cp, people = _v(spark, sf, "case_persons", "persons")
    people = people.select("person_id", "name", "date_of_birth")
    named = blocking.pairs(blocking.keys(people, "person_id", {"EXACT_NAME": N.person(F.col("name"))["normalized"]}))
    judged = resolve.resolve_persons(named, people).select(F.col("id1").alias("x"), F.col("id2").alias("y"), "decision", "same_name", "same_sound")
    both = judged.unionByName(judged.withColumns({"x": F.col("y"), "y": F.col("x")}))
    a, b = cp.select(F.col("case_id").alias("id1"), F.col("person_id").alias("x")), cp.select(F.col("case_id").alias("id2"), F.col("person_id").alias("y"))
    other = a.join(both, "x").join(b, "y").where("id1 < id2")
    own = links.shared(cp, "person_id").select("id1", "id2", F.col("value").alias("x"), F.col("value").alias("y"), F.lit("HIGH_CONFIDENCE_MATCH").alias("decision"), F.lit(True).alias("same_name"), F.lit(True).alias("same_sound"))
    return cut(graph.union(own, other.select(*own.columns)), "query-people")


def _methods(pairs: DataFrame, f: DataFrame) -> DataFrame:
    """The method signal of the pairs of which both cases have a method text."""
    texts = f.where("method is not null").select("case_id", F.col("method").alias("description"), F.col("method_source").alias("source"))
    ids = texts.select("case_id")
    told = pairs.join(ids.withColumnRenamed("case_id", "id1"), "id1", "left_semi").join(ids.withColumnRenamed("case_id", "id2"), "id2", "left_semi")
    return similarity.method_similarity(told, texts, source="source")


def _compared(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(pairs, features, people, methods) of the candidate pairs of cases."""
    f, people = cut(_features(spark, sf), "query-features"), _people_pairs(spark, sf)
    pairs = cut(people.select("id1", "id2").distinct(), "query-pairs")
    return pairs, f, people, cut(_methods(pairs, f), "query-methods")


def _carriers(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(people, features, methods) that `similarity.met_by_name` takes, all written."""
    f, people = _features(spark, sf, in_turn=True), cut(similarity.people_of_cases(*_v(spark, sf, "case_persons", "persons")), "query-people")
    told = people.join(f.where("method is not null").select(F.col("case_id").alias("id")), "id", "left_semi").select("id", "keys")
    methods = cut(_methods(cut(blocking.met_rows(told).select(F.col("a.id").alias("id1"), F.col("b.id").alias("id2")), "query-pairs"), f), "query-methods")
    used = ("case_id", "crime_category", "crime_type", "sections", "latitude", "longitude", "place", "has_place", "district", "registration_date", "time_bucket", "plates", "numbers")
    lean = cut(f.select(*used), "query-lean")
    release(spark, f)
    return people, lean, methods


def _met(spark, sf) -> DataFrame:
    """The candidate pairs of `_compared`, met by cases that carry what is compared: no pair is shuffled but those of two method texts."""
    carriers = _carriers(spark, sf)
    met = similarity.met_by_name(*carriers)
    release(spark, *carriers)
    return met


@query
def case_similarity(spark, sf):
    """All eight signals of candidate pairs."""
    pick = lambda i: F.concat_ws(":", F.col("signals")[i]["status"], F.format_number(F.col("signals")[i]["score"], 4))
    names = ("method", "category", "legal", "geography", "time", "vehicles", "phones", "persons")
    return similarity.compare_met(_met(spark, sf)).select("id1", "id2", *[pick(i).alias(n) for i, n in enumerate(names)], "score", "level")


@query
def person_overlap(spark, sf):
    """The person signal of case pairs that share a district, type and day of registration."""
    cases, cp, people = _v(spark, sf, "cases", "case_persons", "persons")
    keyed = cases.withColumn("k", F.concat_ws("|", "district", "crime_type", F.col("registration_date").cast("string")))
    return similarity.person_overlap_met(keyed.select("case_id", F.col("k").alias("value")), cp, people)


def _rare_word_pairs(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Pairs of narratives that share a method keyword which at most three of them have."""
    texts = _v(spark, sf, "narratives").withColumn("case_id", F.col("doc_id"))
    entries = blocking.method_keys(texts, "doc_id").where("signal = 'MO_KEYWORD_TOKEN'")
    found = blocking.pairs(entries, 2, 3).select(F.col("id1").cast("long").alias("id1"), F.col("id2").cast("long").alias("id2"))
    return cut(found, "query-texts"), texts


@query
def tfidf_cosine(spark, sf):
    pairs, texts = _rare_word_pairs(spark, sf)
    return similarity.cosine(pairs, texts)


@query
def method_similarity(spark, sf):
    texts = _v(spark, sf, "narratives").where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("description").alias("text"))
    if not texts.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():  # texts of one id are told apart as rows
        return similarity.method_similarity(*_rare_word_pairs(spark, sf))
    packed = similarity.packed(texts)
    pairs = cut(blocking.rare_pairs(similarity.keywords_of(packed)), "query-texts")
    return similarity.method_similarity_met(pairs, packed)


# Links -------------------------------------------------------------------------


@query
def quick_links(spark, sf):
    return links.quick_links(*_v(spark, sf, "case_persons", "case_vehicles"))


@query
def quick_links_phones(spark, sf):
    """Links by person, vehicle or phone; the SQL of quick_links has the first two only."""
    return links.quick_links(*_v(spark, sf, "case_persons", "case_vehicles", "case_phones"))


@query
def shared_phone_buckets(spark, sf):
    """Cases and pairs behind each valid number: what linking by phone would make, before it is made."""
    phones, ct = _v(spark, sf, "phones", "case_phones")
    numbers = ct.join(phones, "phone_id").withColumn("p", N.phone(F.col("number"))).where("p.is_valid").select(F.col("p.normalized").alias("number"), "case_id").distinct()
    n = F.count("*")
    return numbers.groupBy("number").agg(n.alias("cases"), (n * (n - 1) / 2).cast("long").alias("pairs"))


def _paired(spark, sf) -> DataFrame:
    f, people = cut(_features(spark, sf), "query-features"), _people_pairs(spark, sf)
    return similarity.paired(people.select("id1", "id2").distinct(), f)


@query
def shared_location_signal(spark, sf):
    return links.location_signals(_paired(spark, sf)).select("id1", "id2", "score", "certainty")


@query
def shared_phone_signal(spark, sf):
    return links.phone_signals(_paired(spark, sf)).groupBy("id1", "id2").agg(F.count("*").alias("signals"), F.max("score").alias("score"))


@query
def shared_vehicle_signal(spark, sf):
    return links.vehicle_signals(_paired(spark, sf)).groupBy("id1", "id2").agg(F.count("*").alias("signals"), F.max("score").alias("score"))


def _all_signals(spark, sf) -> DataFrame:
    return links.analyze_pairs(*_compared(spark, sf))


@query
def all_signals(spark, sf):
    """Every relationship signal of candidate pairs, of all nine types."""
    return _all_signals(spark, sf).select("id1", "id2", "rel_type", "score", "certainty", "unverified")


@query
def pair_confidence(spark, sf):
    return links.confidence_met(_met(spark, sf)).select("id1", "id2", "pair_key", "score", "level", _line("families").alias("families"), "signals", "high", "possible", "weak")


# Graph ---------------------------------------------------------------------------


def _links_of(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the whole graph, whose edges may still lack an end."""
    cases, persons, vehicles, phones, places, ev = _v(spark, sf, "cases", "persons", "vehicles", "phones", "locations", "evidences")
    cp, cv, ct, cs = _v(spark, sf, "case_persons", "case_vehicles", "case_phones", "case_sections")
    sections = cs.select("case_id", N.section_code(F.col("section")).alias("section"))
    nodes = graph.union(
        graph.node_rows(cases, "case_id", "Case", "station_id", fir_number="fir_number"), graph.node_rows(persons, "person_id", "Person", name="name", date_of_birth="date_of_birth"), graph.node_rows(vehicles, "vehicle_id", "Vehicle", registration="registration_number"),
        graph.node_rows(phones, "phone_id", "Phone", number="number"), graph.node_rows(places, "location_id", "Location", locality="locality"), graph.node_rows(ev, "evidence_id", "Evidence", kind="evidence_type"), graph.node_rows(sections, "section", "LegalSection"),
    )
    near = links.shared(cp, "person_id").withColumn("confidence", F.lit(0.85))
    edges = graph.union(
        graph.edge_rows(cp, "case_id", "person_id", "HAS_PERSON"), graph.edge_rows(cv, "case_id", "vehicle_id", "HAS_VEHICLE"), graph.edge_rows(ct, "case_id", "phone_id", "HAS_PHONE"),
        graph.edge_rows(cases, "case_id", "location_id", "HAS_LOCATION"), graph.edge_rows(ev, "case_id", "evidence_id", "HAS_EVIDENCE"), graph.edge_rows(sections, "case_id", "section", "HAS_LEGAL_SECTION"),
        graph.related_rows(near),
    )
    return nodes, edges


def _graph(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The whole graph: all seven labels and edge types, with RELATED_TO between all cases of one person. Nodes are written once."""
    nodes, edges = _links_of(spark, sf)
    nodes = cut(nodes, "query-nodes")
    return nodes, graph.known_ends(edges, nodes)


def _by_type(spark, sf) -> tuple[DataFrame, dict[str, tuple[str, DataFrame]]]:
    """(node_id, label, station_id of the whole graph, written once; links case_id, value of each edge type with the label of its values).

    RELATED_TO is between all cases of one value. What `_graph` has as edges, without
    their texts and without a row for each pair of cases.
    """
    cases, persons, vehicles, phones, places, ev = _v(spark, sf, "cases", "persons", "vehicles", "phones", "locations", "evidences")
    cp, cv, ct, cs = _v(spark, sf, "case_persons", "case_vehicles", "case_phones", "case_sections")
    sections = cs.select("case_id", N.section_code(F.col("section")).alias("section"))
    links = {
        "HAS_LOCATION": ("Location", cases, "location_id"), "HAS_LEGAL_SECTION": ("LegalSection", sections, "section"), "HAS_PHONE": ("Phone", ct, "phone_id"), "HAS_PERSON": ("Person", cp, "person_id"),
        "HAS_VEHICLE": ("Vehicle", cv, "vehicle_id"), "HAS_EVIDENCE": ("Evidence", ev, "evidence_id"), "RELATED_TO": ("Case", cp, "person_id"),
    }
    ids = {"Person": (persons, "person_id"), "Vehicle": (vehicles, "vehicle_id"), "Phone": (phones, "phone_id"), "Location": (places, "location_id"), "Evidence": (ev, "evidence_id"), "LegalSection": (sections, "section")}
    known = lambda df, key: df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("node_id"))
    nodes = cases.where("case_id is not null").groupBy(F.col("case_id").cast("string").alias("node_id")).agg(F.max("station_id").alias("station_id")).select("node_id", F.lit("Case").alias("label"), "station_id")
    for label, (df, key) in ids.items():
        nodes = nodes.unionByName(known(df, key).distinct().select("node_id", F.lit(label).alias("label"), F.lit(None).cast("string").alias("station_id")))
    return cut(nodes, "query-nodes"), {t: (label, df.select("case_id", F.col(key).cast("string").alias("value"))) for t, (label, df, key) in links.items()}


def _typed_components(nodes: DataFrame, links: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """node_id, label, station_id, component of `_by_type`."""
    def parts():
        for rel_type, (_, rows) in links.items():
            if rel_type == "RELATED_TO":  # the smallest known case of a value stands for it
                known = nodes.where("label = 'Case'").select(F.col("node_id").alias("case_id"))
                rows = rows.where("value is not null").join(known, "case_id", "left_semi")
                yield rows.join(rows.groupBy("value").agg(F.min("case_id").alias("b")), "value").select(F.col("case_id").alias("a"), "b")
            else:
                yield rows.select(F.col("case_id").alias("a"), F.col("value").alias("b"))

    return cut(graph.placed_in(nodes, components_in_turn(nodes.select(F.col("node_id").alias("id")), parts(), "query-turn")), "query-placed")


def _communities(spark, sf) -> DataFrame:
    """Communities of the whole graph, from sums of each edge type."""
    nodes, links = _by_type(spark, sf)
    placed = _typed_components(nodes, links)
    made = [cut(graph.sums_of_groups(placed, rows) if t == "RELATED_TO" else graph.sums_of_type(placed, rows, t, label), "query-sums") for t, (label, rows) in links.items()]
    sums = graph.union(*made)
    twice = placed.groupBy("node_id").agg(F.count("*").alias("n")).where("n > 1")
    if sums.where("odd > 0").isEmpty() and twice.isEmpty():
        return graph.communities_of(placed, sums, sums.groupBy("component").agg(F.sum("pairs").alias("pairs")))
    # An id is under two labels: two types may join the same pair, so pairs are told apart as rows.
    return graph.communities(placed, cut(_graph(spark, sf)[1], "query-edges"))


def _person_graph(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Cases and persons, with HAS_PERSON, and RELATED_TO between cases of one person registered in one year.

    Centralities of all nodes are for graphs of small components, as this is; see
    `target_metrics` for a part of the whole graph.
    """
    cases, persons, cp = _v(spark, sf, "cases", "persons", "case_persons")
    nodes = cut(graph.union(graph.node_rows(cases, "case_id", "Case", "station_id"), graph.node_rows(persons, "person_id", "Person")), "query-nodes")
    near = links.shared(cases.select("case_id", F.concat_ws("|", "person_id", F.date_format("registration_date", "yyyy")).alias("k")), "k").withColumn("confidence", F.lit(0.85))
    edges = graph.union(graph.edge_rows(cp, "case_id", "person_id", "HAS_PERSON", nodes), graph.related_rows(near, nodes))
    return nodes, cut(edges, "query-edges")


def _of_persons(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What `graph.metrics_of_groups` takes for the graph of `_person_graph`."""
    cases, persons, cp = _v(spark, sf, "cases", "persons", "case_persons")
    return cases.select("case_id", "station_id", "person_id", F.concat("person_id", F.lit("|"), F.date_format("registration_date", "yyyy")).alias("value")), persons, cp


def _metrics(spark, sf) -> DataFrame:
    found = graph.metrics_of_groups(*_of_persons(spark, sf), 0.85)
    return graph.metrics(*_person_graph(spark, sf)) if found is None else found


@query
def graph_nodes(spark, sf):
    nodes, _ = _graph(spark, sf)
    return nodes.select("node_id", "label", "station_id", F.array_join(F.array_sort(F.map_keys("props")), ",").alias("props"))


@query
def graph_edges(spark, sf):
    return _graph(spark, sf)[1].select("edge_id", "src", "dst", "rel_type")


@query
def graph_counts(spark, sf):
    return graph.counts(*_graph(spark, sf))


@query
def node_degrees(spark, sf):
    return graph.degrees(*_graph(spark, sf))


@query
def case_reach(spark, sf):
    """Distinct cases next to each node, counted by edge type: no edge between two cases is made where their person tells it."""
    nodes, links = _by_type(spark, sf)
    cases = nodes.where("label = 'Case'").select("node_id", "station_id")
    per = [cut(graph.reach_by_group(cases, rows) if t == "RELATED_TO" else graph.reach_by_type(cases, rows), "query-reach") for t, (_, rows) in links.items()]
    rows = graph.union(nodes.select("node_id", F.lit(1).alias("node"), F.lit(None).cast("long").alias("cases"), F.lit(None).cast("long").alias("stations")), *[p.select("node_id", F.lit(0).alias("node"), "cases", "stations") for p in per])
    z = lambda c: F.coalesce(F.max(c), F.lit(0))
    told = cut(rows.groupBy("node_id").agg(F.sum("node").alias("nodes"), F.count_if(F.col("node") == 0).alias("types"), z("cases").alias("cases"), z("stations").alias("stations")).where("nodes > 0"), "query-reached")
    if told.where("nodes > 1 or types > 1").isEmpty():
        return told.select("node_id", "cases", "stations")
    # An id is under two labels or is a value of two types: their cases are told apart as rows.
    return graph.case_reach(*_graph(spark, sf))


@query
def graph_components(spark, sf):
    return graph.component_summary(_typed_components(*_by_type(spark, sf)))


@query
def communities(spark, sf):
    c = _communities(spark, sf)
    line = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return c.withColumns({"labels": line("labels"), "edge_types": line("edge_types")})


@query
def network_metrics(spark, sf):
    """Of the graph of `_person_graph`, whose edges are made where the cases of a person are measured."""
    return _metrics(spark, sf).select("node_id", "label", "total_degree", "weighted_degree", "cases", "stations", "degree_centrality", "closeness", "betweenness", "component_id", "is_connector", "role")


def _start(spark) -> DataFrame:
    return spark.createDataFrame([("C0000000001",)], "start_id string")


@query
def traverse_depth3(spark, sf):
    nodes, edges = _links_of(spark, sf)
    return graph.traverse(edges, nodes, _start(spark), 3, ["HAS_PERSON", "HAS_VEHICLE"]).select("start_id", "end_id", "hops", "path_key")


@query
def neighbourhood_depth2(spark, sf):
    _, edges = _links_of(spark, sf)
    return graph.neighbourhood(edges.where("rel_type in ('HAS_PERSON', 'HAS_VEHICLE')"), _start(spark), 2)


@query
def induced_edges(spark, sf):
    _, edges = _links_of(spark, sf)
    edges = edges.where("rel_type in ('HAS_PERSON', 'HAS_VEHICLE')")
    return graph.induced(edges, graph.neighbourhood(edges, _start(spark), 2)).select("edge_id")


@query
def multi_hop_paths(spark, sf):
    nodes, edges = _links_of(spark, sf)
    return graph.first_paths(graph.traverse(edges, nodes, _start(spark), 3, ["HAS_PERSON", "HAS_VEHICLE"]))


@query
def path_properties(spark, sf):
    """Nodes and edges of the trails of one or two hops, with their properties."""
    nodes, edges = _links_of(spark, sf)
    found = cut(graph.traverse(edges, nodes, _start(spark), 2, ["HAS_PERSON", "HAS_VEHICLE", "RELATED_TO"]), "query-trails")
    near = cut(nodes.join(found.select(F.explode("path_nodes").alias("node_id")).distinct(), "node_id", "left_semi"), "query-near")
    d = graph.path_details(found, near)
    label = lambda n: F.concat_ws("/", n["label"], n["node_id"], n["station_id"], F.array_join(F.array_sort(F.map_values(n["props"])), "/"))
    edge = lambda e: F.concat_ws("/", e["edge_id"], e["weight"].cast("string"))
    return d.select("start_id", "path_key", F.array_join(F.transform("nodes", label), ",").alias("nodes"), F.array_join(F.transform("edges", edge), ",").alias("edges"))


@query
def target_metrics(spark, sf):
    """Network metrics of the whole graph within two hops of one case."""
    nodes, edges = _links_of(spark, sf)
    used = cut(edges.where("rel_type in ('HAS_PERSON', 'HAS_VEHICLE', 'RELATED_TO')"), "query-edges")
    ids = cut(graph.neighbourhood(used, _start(spark), 2).select("node_id"), "query-ids")
    near = cut(nodes.join(ids, "node_id", "left_semi"), "query-near")
    return graph.metrics(near, cut(graph.induced(used, ids), "query-induced"))


# Patterns ----------------------------------------------------------------------------


def _shown(df: DataFrame) -> DataFrame:
    return df.select("pattern_id", "pattern_type", "title", "description", "first_case", "entity_id", "stations", _line("signals").alias("signals"), "occurrence_count", "strength")


def _patterns(spark, sf) -> dict[str, DataFrame]:
    cases, persons, cp, vehicles, cv, phones, ct, places, ev = _v(spark, sf, "cases", "persons", "case_persons", "vehicles", "case_vehicles", "phones", "case_phones", "locations", "evidences")
    return {
        "modus_operandi": patterns.modus_operandi(cases, ev),
        "person": patterns.recurring(cases, cp.join(persons.select("person_id", "name"), "person_id"), "person_id", "Person", "name"),
        "location": patterns.recurring(cases, cases.select("case_id", "location_id").join(places.select("location_id", F.coalesce("address", "district").alias("label")), "location_id"), "location_id", "Location", "label"),
        "vehicle": patterns.recurring(cases, cv.join(vehicles.select("vehicle_id", "registration_number"), "vehicle_id"), "vehicle_id", "Vehicle", "registration_number"),
        "phone": patterns.recurring(cases, ct.join(phones, "phone_id"), "phone_id", "Phone", "number"),
        "temporal": patterns.temporal(cases),
        "cross_station": patterns.cross_station(cases),
        "characteristics": patterns.characteristics(cases),
    }


def _pattern_query(name: str):
    def run(spark, sf):
        return _shown(patterns.finalize(_patterns(spark, sf)[name]))

    run.__name__ = f"pattern_{name}"
    return query(run)


for _name in ("modus_operandi", "person", "location", "vehicle", "phone", "temporal", "cross_station", "characteristics"):
    _pattern_query(_name)


@query
def pattern_histogram(spark, sf):
    return patterns.histogram(patterns.finalize(graph.union(*_patterns(spark, sf).values())))


def _graph_results(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(communities, metrics) of the graph of `_person_graph`."""
    found = graph.structure_of_groups(*_of_persons(spark, sf), 0.85)
    if found is not None:
        return found
    nodes, edges = _person_graph(spark, sf)
    placed = cut(graph.with_components(nodes, edges), "query-placed")
    return graph.communities(placed, edges), cut(graph.metrics(nodes, edges, placed), "query-metrics")


@query
def pattern_structural(spark, sf):
    return _shown(patterns.finalize(patterns.structural(*_graph_results(spark, sf)))).drop("first_case")


# Explanations ---------------------------------------------------------------------------


def _told(df: DataFrame) -> DataFrame:
    return df.select("explanation_id", "subject_id", "subject_type", "title", "observation", "explanation", _line("case_ids").alias("case_ids"), _line("entity_ids").alias("entity_ids"), _line("signals").alias("signals"), "weight", F.size("limitations").cast("long").alias("limitations"))


@query
def explain_patterns(spark, sf):
    p = _patterns(spark, sf)
    return _told(explain.union(explain.of_patterns(patterns.finalize(graph.union(p["modus_operandi"], p["person"], p["vehicle"])))))


@query
def explain_links(spark, sf):
    people, f, methods = _carriers(spark, sf)
    told = lambda cases: explain.of_links(links.confidence_met(similarity.met_by_name(cases, f, methods)))
    again = explain.ids_met_again(blocking.met_rows(people.select("id", "keys")).select(F.col("a.id").alias("id1"), F.col("b.id").alias("id2")))
    ends = again.select(F.explode(F.array("id1", "id2")).alias("id")).distinct()
    few = told(people.join(ends, "id", "left_semi")).join(again.select(N.pair_key(F.col("id1"), F.col("id2")).alias("subject_id")), "subject_id", "left_semi")
    return _told(explain.union_of_links(told(people), few))


@query
def explain_communities(spark, sf):
    return _told(explain.union(explain.of_communities(_communities(spark, sf))))


@query
def explain_connectors(spark, sf):
    return _told(explain.union(explain.of_connectors(_metrics(spark, sf))))


@query
def explain_histogram(spark, sf):
    p = _patterns(spark, sf)
    c, m = _graph_results(spark, sf)
    return explain.histogram(explain.union(explain.of_patterns(patterns.finalize(graph.union(p["person"], p["vehicle"], p["phone"], p["location"]))), explain.of_communities(c), explain.of_connectors(m)))


# Privacy and report --------------------------------------------------------------------


@query
def redact_texts(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", privacy.prepared(F.col("text")).alias("t"))
    marks = lambda m: F.regexp_count("t", F.lit(m))
    return d.select("doc_id", marks(r"\[REDACTED_SECRET\]").cast("long").alias("secrets"), marks(r"\[NEUTRALIZED_DIRECTIVE\]").cast("long").alias("directives"), F.md5("t").alias("digest"))


@query
def redact_pages(spark, sf):
    d = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", privacy.prepared(F.col("html")).alias("t"))
    return d.select("page_id", F.regexp_count("t", F.lit(r"\[REDACTED_SECRET\]")).cast("long").alias("secrets"), F.md5("t").alias("digest"))


@query
def alias_table(spark, sf):
    cases, persons, cp = _v(spark, sf, "cases", "persons", "case_persons")
    values = privacy.entity_values(cases, Person=cp.join(persons.select("person_id", "name"), "person_id").select("case_id", F.col("name").alias("value")))
    return privacy.alias_table(values)


@query
def mask_texts(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    masked, _ = privacy.mask(d, kinds=("Phone", "Email"))
    return masked.select(F.col("id").alias("doc_id"), F.regexp_count("text", F.lit(r"Phone-[A-Z]+")).cast("long").alias("phones"), F.regexp_count("text", F.lit(r"Email-[A-Z]+")).cast("long").alias("emails"), F.md5("text").alias("digest"))


@query
def backmap_texts(spark, sf):
    """Masked texts, mapped back: equal to the prepared texts."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    masked, aliases = privacy.mask(d, kinds=("Email",))
    return privacy.backmap(masked, aliases).select(F.col("id").alias("doc_id"), F.md5("text").alias("digest"))


@query
def scan_output(spark, sf):
    return report.scan_rows(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")


@query
def report_statements(spark, sf):
    p = _patterns(spark, sf)
    e = explain.union(explain.of_patterns(patterns.finalize(graph.union(p["person"], p["location"]))))
    return report.statements(e, explain.FORBIDDEN).select("explanation_id", "subject_type", "statement", F.col("case_count").cast("long").alias("case_count"), F.col("entity_count").cast("long").alias("entity_count"))


@query
def report_summary(spark, sf):
    p = _patterns(spark, sf)
    e = explain.union(explain.of_patterns(patterns.finalize(graph.union(p["person"], p["location"], p["vehicle"]))))
    return report.summary(report.statements(e, explain.FORBIDDEN))


@query
def ground_statements(spark, sf):
    cases, cp = _v(spark, sf, "cases", "case_persons")
    made = cp.select(F.col("case_id").alias("statement_id"), F.array("case_id", "person_id", F.concat(F.lit("X"), "case_id")).alias("cited"))
    known = cases.select(F.col("case_id").alias("id"))
    return report.ground(made, known).select("statement_id", _line("grounded").alias("grounded"), "is_grounded")


@query
def event_activity(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    per = e.dropDuplicates(["event_id"]).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return per.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")
