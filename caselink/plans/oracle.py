"""The registered queries in ANSI SQL (as DuckDB reads it), on the same tables."""

from __future__ import annotations

from math import log

from ..config import DEFAULT
from ..functions.normalize import METHOD_STOP_WORDS, METHOD_WORDS, PLACE_WORDS, TITLES
from ..operators.explain import FORBIDDEN as EXPLAIN_WORDS
from ..operators.links import FAMILIES
from ..operators.patterns import FORBIDDEN as PATTERN_WORDS
from ..operators.privacy import DIRECTIVE_MARK, DIRECTIVES, SECRET_MARK, SECRETS
from ..operators.report import COERCIVE, FOLLOW_UP, RAW
from ..operators.report import SECRETS as OUTPUT_SECRETS
from ..sources.domain import with_sql

SQL: dict[str, str] = {}


def _q(name: str, body: str, *views: str, recursive: bool = False) -> None:
    SQL[name] = with_sql(body, *views, recursive=recursive) if views else body


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(_text(v) for v in values) + ")"


def _map(table: dict[str, str], var: str) -> str:
    return f"CASE {var} " + " ".join(f"WHEN {_text(k)} THEN {_text(v)}" for k, v in table.items()) + f" ELSE {var} END"


def soundex(e: str) -> str:
    keep = f"regexp_replace(upper({e}), '[^A-Z]', '', 'g')"
    runs = f"translate({keep}, 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '11112222222233455600000000')"
    for d in "0123456":
        runs = f"regexp_replace({runs}, '{d}+', '{d}', 'g')"
    return f"CASE WHEN {keep} = '' THEN '' ELSE rpad(substr(substr({keep}, 1, 1) || replace(substr({runs}, 2), '0', ''), 1, 4), 4, '0') END"


def fold(e: str) -> str:
    return f"regexp_replace(strip_accents({e}), '[^\\x00-\\x7F]', '', 'g')"


def plain(e: str) -> str:
    squeezed = f"trim(regexp_replace(regexp_replace(lower({e}), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
    return f"list_filter(string_split({squeezed}, ' '), lambda w: w <> '')"


def phone(e: str) -> tuple[str, str]:
    d = f"regexp_replace({e}, '[^0-9]', '', 'g')"
    n = f"CASE WHEN length({d}) = 10 THEN {d} WHEN length({d}) = 11 AND starts_with({d}, '0') THEN substr({d}, 2, 10) WHEN length({d}) = 12 AND starts_with({d}, '91') THEN substr({d}, 3, 10) WHEN length({d}) > 10 THEN right({d}, 10) END"
    return f"coalesce('+91' || ({n}), {d})", f"({n}) IS NOT NULL"


def plate(e: str) -> str:
    return f"regexp_replace(upper({e}), '[^A-Z0-9]', '', 'g')"


_VALID = "regexp_matches({0}, '^([A-Z]{{2}})([0-9]{{2}})([A-Z]{{1,3}})([0-9]{{4}})$')"


def section(e: str) -> str:
    shape = "'^([A-Za-z_]+)[\\s_]+(.+)$'"
    return f"CASE WHEN regexp_matches({e}, {shape}) THEN upper(regexp_extract({e}, {shape}, 1)) || '_' || regexp_extract({e}, {shape}, 2) ELSE {e} END"


def bucket(h: str) -> str:
    return f"CASE WHEN {h} BETWEEN 6 AND 11 THEN 'MORNING' WHEN {h} BETWEEN 12 AND 16 THEN 'AFTERNOON' WHEN {h} BETWEEN 17 AND 20 THEN 'EVENING' WHEN {h} BETWEEN 0 AND 23 THEN 'NIGHT' END"


def km(a: str, b: str) -> str:
    s = f"(pow(sin((radians({b}.latitude) - radians({a}.latitude)) / 2), 2) + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * pow(sin((radians({b}.longitude) - radians({a}.longitude)) / 2), 2))"
    return f"(6371.0 * 2 * atan2(sqrt({s}), sqrt(1 - {s})))"


def jaccard(a: str, b: str) -> str:
    return f"(CASE WHEN len(list_distinct(list_concat({a}, {b}))) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0 END)"


def content_id(prefix: str, *groups: str) -> str:
    body = " || ':' || ".join([_text(prefix), *[f"array_to_string(list_sort({g}), '|')" for g in groups]])
    return f"substr(sha256({body}), 1, 12)"


# Lookups
_q("case_lookup", "SELECT * FROM cases WHERE case_id = 'C0000000007'", "cases")
_q("person_by_key", "SELECT person_id, name, date_of_birth FROM persons WHERE person_id = 'P0000000011' ORDER BY person_id LIMIT 1", "persons")
_q("vehicle_by_registration", "SELECT * FROM vehicles WHERE registration_number = 'OD00-ab0000' ORDER BY vehicle_id LIMIT 1", "vehicles")
_q("evidence_of_case", "SELECT * FROM evidences WHERE case_id = 'C0000000007'", "evidences")
_q("evidence_by_type", "SELECT * FROM evidences WHERE evidence_type = 'MOBILE'", "evidences")
_q("paged_scan", "SELECT case_id, fir_number, crime_type FROM cases ORDER BY case_id LIMIT 100 OFFSET 50", "cases")
_q("cases_by_district", "SELECT case_id, district FROM cases WHERE district = 'NATION_3' ORDER BY case_id LIMIT 50", "cases")
_q("cases_by_category", "SELECT case_id, crime_category FROM cases WHERE crime_category = 'P' ORDER BY case_id LIMIT 50", "cases")
_q("persons_ilike", "SELECT person_id, name FROM persons WHERE lower(name) LIKE '%shri r%' ORDER BY person_id LIMIT 50", "persons")
_q("case_timeline", "SELECT event_id, event_type, strftime(event_date, '%Y-%m-%d %H:%M:%S') AS at FROM investigation_events WHERE case_id = 'C0000000008'", "investigation_events")
_q("gather_cases", "SELECT case_id, fir_number FROM cases WHERE case_id IN ('C0000000003', 'C0000000009') OR fir_number IN ('FIR-9', 'FIR-12')", "cases")
_q("cases_in_scope", "SELECT case_id, station_id, strftime(registration_date, '%Y-%m-%d') AS day FROM cases WHERE station_id IN ('PS_01', 'PS_02') AND registration_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'", "cases")
_COUNTED = ("cases", "persons", "vehicles", "phones", "locations", "evidences", "case_persons", "investigation_events")
_q("table_counts", " UNION ALL ".join([f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in _COUNTED] + ["SELECT 'stations', count(DISTINCT station_id) FROM cases"]), *_COUNTED)
_q(
    "case_children",
    """+ p AS (SELECT case_id, string_agg(person_id || '/' || role, ',' ORDER BY person_id, role) AS persons FROM case_persons GROUP BY case_id),
  e AS (SELECT case_id, string_agg(evidence_type, ',' ORDER BY evidence_type) AS evidences FROM evidences GROUP BY case_id),
  i AS (SELECT case_id, string_agg(event_id, ',' ORDER BY event_id) AS events FROM investigation_events GROUP BY case_id),
  l AS (SELECT case_id, string_agg(section, ',' ORDER BY section) AS sections FROM case_sections GROUP BY case_id)
  SELECT case_id, coalesce(persons, '') AS persons, coalesce(evidences, '') AS evidences, coalesce(events, '') AS events, coalesce(sections, '') AS sections FROM cases LEFT JOIN p USING (case_id) LEFT JOIN e USING (case_id) LEFT JOIN i USING (case_id) LEFT JOIN l USING (case_id)""",
    "cases", "case_persons", "evidences", "investigation_events", "case_sections",
)

# Normalization
_PERSON = f"""p1 AS (SELECT person_id, date_of_birth, trim(name) AS f FROM persons),
  p2 AS (SELECT *, lower(trim(regexp_extract(f, '(?i)\\balias\\b\\s+(.*)$', 1))) AS al FROM p1),
  p3 AS (SELECT *, {plain("CASE WHEN al <> '' THEN regexp_replace(f, '(?i)\\balias\\b\\s+.*$', '') ELSE f END")} AS every FROM p2),
  p4 AS (SELECT *, list_filter(every, lambda w: w NOT IN {_in(TITLES)}) AS kept FROM p3),
  p5 AS (SELECT *, CASE WHEN len(kept) > 0 THEN kept ELSE every END AS tokens FROM p4),
  np AS (SELECT person_id, date_of_birth, tokens, array_to_string(tokens, ' ') AS normalized, array_to_string(list_filter(list_transform(tokens, lambda w: {soundex('w')}), lambda c: c <> ''), '-') AS phonetic, al FROM p5)"""
_q(
    "normalize_person",
    f"+ {_PERSON} SELECT person_id, normalized, phonetic, CAST(len(tokens) AS BIGINT) AS word_count, len(list_filter(tokens, lambda w: length(w) = 1)) > 0 AS has_initials, nullif(al, '') AS alias, CASE WHEN al <> '' THEN {soundex('al')} END AS alias_phonetic FROM np",
    "persons",
)
_q("soundex_words", f"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) SELECT word, {soundex('word')} AS code FROM w")
_q("normalize_phone", "SELECT phone_id, {} AS normalized, {} AS is_valid FROM phones".format(*phone("number")), "phones")
_q(
    "normalize_vehicle",
    f"""+ v AS (SELECT vehicle_id, {plate('registration_number')} AS c FROM vehicles), w AS (SELECT *, {_VALID.format('c')} AS ok FROM v)
  SELECT vehicle_id, c AS normalized, ok AS is_valid, CASE WHEN ok THEN substr(c, 1, 2) END AS state, CASE WHEN ok THEN substr(c, 1, 4) END AS rto, CASE WHEN ok THEN substr(c, 5, length(c) - 8) END AS series, CASE WHEN ok THEN right(c, 4) END AS number FROM w""",
    "vehicles",
)
_q("normalize_location", f"SELECT person_id, array_to_string(list_transform({plain('address')}, lambda w: {_map(PLACE_WORDS, 'w')}), ' ') AS place FROM persons", "persons")
_METHOD = f"m AS (SELECT doc_id, crime_category, description, list_transform(list_filter({plain(fold('description'))}, lambda w: w NOT IN {_in(METHOD_STOP_WORDS)}), lambda w: {_map(METHOD_WORDS, 'w')}) AS t FROM narratives)"
_q("normalize_method", f"+ {_METHOD} SELECT doc_id, CAST(len(t) AS BIGINT) AS tokens, CAST(len(list_filter(t, lambda w: length(w) >= 4)) AS BIGINT) AS keywords, md5(array_to_string(t, ' ')) AS digest FROM m", "narratives")
_q("normalize_evidence", f"+ m AS (SELECT doc_id, {plain(fold('description'))} AS t FROM narratives) SELECT doc_id, CAST(len(t) AS BIGINT) AS tokens, md5(array_to_string(t, ' ')) AS digest FROM m", "narratives")
_q(
    "time_buckets",
    f"SELECT event_id, strftime(event_date, '%Y-%m-%dT%H:%M:%S') AS iso, year(event_date) AS year, month(event_date) AS month, day(event_date) AS day, hour(event_date) AS hour, {bucket('hour(event_date)')} AS bucket, CAST(isodow(event_date) - 1 AS INT) AS weekday, strftime(event_date, '%Y') || ',' || strftime(event_date, '%Y-%m') AS tokens FROM investigation_events",
    "investigation_events",
)
_q(
    "geo_distance",
    f"SELECT a.location_id, b.location_id AS other, round({km('a', 'b')}, 4) AS km, round(exp(-{km('a', 'b')} / 10.0), 4) AS nearness, coalesce(a.latitude BETWEEN -90 AND 90 AND a.longitude BETWEEN -180 AND 180, FALSE) AS is_valid FROM locations a JOIN locations b ON CAST(substr(b.location_id, 2) AS BIGINT) - 3 = CAST(substr(a.location_id, 2) AS BIGINT)",
    "locations",
)
_q("legal_codes", f"SELECT DISTINCT section, {section('section')} AS code FROM case_sections", "case_sections")
_q("pair_keys", f"SELECT least(person_id, case_id) || ':' || greatest(person_id, case_id) || ':RELATED_TO' AS pair_key, 'sig:' || {content_id('sig', '[person_id, case_id]')} AS content_id FROM case_persons", "case_persons")

# Blocking and resolution
_PAIRS = "SELECT a.id AS id1, b.id AS id2, string_agg(DISTINCT a.signal, ',' ORDER BY a.signal) AS signals FROM k a JOIN k b ON a.signal = b.signal AND a.key = b.key AND a.id < b.id GROUP BY ALL"
_SIZES = "SELECT signal, key, count(*) AS ids, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS pairs FROM k GROUP BY signal, key HAVING count(*) > 1"
_PERSON_KEYS = f"""{_PERSON},
  k AS (SELECT DISTINCT * FROM (SELECT 'EXACT_NAME' AS signal, normalized AS key, person_id AS id FROM np UNION ALL SELECT 'PHONETIC_NAME', phonetic, person_id FROM np
    UNION ALL SELECT 'SURNAME', CASE WHEN len(tokens) >= 2 AND length(tokens[-1]) >= 3 THEN tokens[-1] END, person_id FROM np UNION ALL SELECT 'DOB_YEAR', substr(date_of_birth, 1, 4), person_id FROM np) WHERE key <> '')"""
_q("block_persons", f"+ {_PERSON_KEYS} {_PAIRS}", "persons")
_q("block_person_buckets", f"+ {_PERSON_KEYS} {_SIZES}", "persons")
_q(
    "block_persons_skewed",
    f"+ {_PERSON_KEYS}, pb AS (SELECT signal, key, min(id) AS first_id, count(*) AS ids FROM k GROUP BY signal, key HAVING count(*) > 1) SELECT k.signal, k.key, id, first_id, ids FROM k JOIN pb USING (signal, key)".replace("FROM persons)", "FROM persons_skewed)"),
    "persons_skewed",
)
_PHONE_KEYS = "k AS (SELECT 'NORMALIZED_PHONE' AS signal, {} AS key, phone_id AS id FROM phones WHERE {})".format(*phone("number"))
_q("block_phones", f"+ {_PHONE_KEYS} {_PAIRS}", "phones")
_VEHICLE_KEYS = f"""v AS (SELECT vehicle_id AS id, {plate('registration_number')} AS c FROM vehicles),
  k AS (SELECT 'NORMALIZED_VEHICLE' AS signal, c AS key, id FROM v UNION ALL SELECT 'RTO_SERIES', substr(c, 1, 2) || '_' || substr(c, 1, 4) || '_' || substr(c, 5, length(c) - 8), id FROM v WHERE {_VALID.format('c')})"""
_q("block_vehicles", f"+ {_VEHICLE_KEYS} {_PAIRS}", "vehicles")
_PLACE = f"array_to_string(list_transform({plain('locality')}, lambda w: {_map(PLACE_WORDS, 'w')}), ' ')"
_q("block_locations", f"+ k AS (SELECT 'NORMALIZED_LOCALITY' AS signal, {_PLACE} AS key, location_id AS id FROM locations WHERE locality IS NOT NULL UNION ALL SELECT 'DISTRICT', lower(trim(district)), location_id FROM locations WHERE locality IS NOT NULL) {_PAIRS}", "locations")
_METHOD_KEYS = f"""{_METHOD}, k AS (SELECT 'CRIME_CATEGORY' AS signal, lower(trim(crime_category)) AS key, CAST(doc_id AS VARCHAR) AS id FROM m
    UNION ALL SELECT DISTINCT 'MO_KEYWORD_TOKEN', w, CAST(doc_id AS VARCHAR) FROM (SELECT doc_id, unnest(t) AS w FROM m) WHERE length(w) >= 4)"""
_q("block_method_buckets", f"+ {_METHOD_KEYS} {_SIZES}", "narratives")
_q("block_methods", f"+ {_METHOD_KEYS.replace('k AS (', 'k0 AS (', 1)}, k AS (SELECT signal, key, id FROM (SELECT *, count(*) OVER (PARTITION BY signal, key) AS n FROM k0) WHERE n BETWEEN 2 AND 100) {_PAIRS}", "narratives")
_q("resolve_phones", f"+ {_PHONE_KEYS} SELECT a.id AS id1, b.id AS id2, 1.0e0 AS score, 'HIGH_CONFIDENCE_MATCH' AS decision FROM k a JOIN k b ON a.key = b.key AND a.id < b.id", "phones")
_q(
    "resolve_vehicles",
    f"""+ {_VEHICLE_KEYS}, pr AS ({_PAIRS}) SELECT id1, id2, CASE WHEN {_VALID.format('x.c')} AND x.c = y.c THEN 1.0e0 ELSE 0.0e0 END AS score, CASE WHEN {_VALID.format('x.c')} AND x.c = y.c THEN 'HIGH_CONFIDENCE_MATCH' ELSE 'NO_MATCH' END AS decision
  FROM pr JOIN v x ON x.id = id1 JOIN v y ON y.id = id2""",
    "vehicles",
)

# Features and similarity
_VIEWS = ("cases", "case_persons", "persons", "vehicles", "case_vehicles", "phones", "case_phones", "case_sections", "locations", "evidences", "case_texts")
_NUMBER, _NUMBER_OK = phone("number")


def _terms(text: str) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+')"


def _method_words(text: str) -> str:
    return f"list_transform(list_filter({plain(fold(text))}, lambda w: w NOT IN {_in(METHOD_STOP_WORDS)}), lambda w: {_map(METHOD_WORDS, 'w')})"


_FEATURES = f"""fp AS (SELECT case_id, list_sort(list(DISTINCT person_id)) AS persons FROM case_persons GROUP BY case_id),
  fv AS (SELECT case_id, list_sort(list(DISTINCT {plate('registration_number')})) AS plates FROM case_vehicles JOIN vehicles USING (vehicle_id) GROUP BY case_id),
  ft AS (SELECT case_id, list_sort(list(DISTINCT {_NUMBER})) AS numbers FROM case_phones JOIN phones USING (phone_id) WHERE {_NUMBER_OK} GROUP BY case_id),
  fs AS (SELECT case_id, list_sort(list(DISTINCT {section('section')})) AS sections FROM case_sections GROUP BY case_id),
  fe AS (SELECT case_id, list_sort(list(DISTINCT evidence_type)) AS evidence FROM evidences GROUP BY case_id),
  fm AS (SELECT case_id, nullif(trim(method), '') AS own, nullif(trim(description), '') AS other FROM case_texts),
  f AS (SELECT c.case_id, fir_number, crime_type, crime_category, c.district, registration_date, {bucket('incident_hour')} AS time_bucket, CAST(isodow(registration_date) - 1 AS INT) AS weekday,
     array_to_string(list_transform({plain("concat_ws(' ', l.locality, l.address, c.district)")}, lambda w: {_map(PLACE_WORDS, 'w')}), ' ') AS place, coalesce(l.locality, l.address) IS NOT NULL AS has_place, latitude, longitude,
     coalesce(own, other) AS method, CASE WHEN own IS NOT NULL THEN 'DEDICATED_MO' WHEN other IS NOT NULL THEN 'DESCRIPTION_DERIVED' ELSE 'UNAVAILABLE' END AS method_source,
     coalesce(persons, []) AS persons, coalesce(plates, []) AS plates, coalesce(numbers, []) AS numbers, coalesce(sections, []) AS sections, coalesce(evidence, []) AS evidence
     FROM cases c LEFT JOIN locations l USING (location_id) LEFT JOIN fp USING (case_id) LEFT JOIN fv USING (case_id) LEFT JOIN ft USING (case_id) LEFT JOIN fs USING (case_id) LEFT JOIN fe USING (case_id) LEFT JOIN fm USING (case_id))"""
_q(
    "case_features",
    f"""+ {_FEATURES} SELECT case_id, fir_number, time_bucket, weekday, place, has_place, round(latitude, 4) AS latitude, md5(coalesce(method, '')) AS method, method_source, array_to_string(persons, ',') AS persons,
    array_to_string(plates, ',') AS plates, array_to_string(numbers, ',') AS numbers, array_to_string(sections, ',') AS sections, array_to_string(evidence, ',') AS evidence FROM f""",
    *_VIEWS,
)
# Persons of one name: with equal or missing dates of birth they resolve high, else the name alone is left.
_PEOPLE = f"""{_PERSON},
  nm AS (SELECT a.person_id AS x, b.person_id AS y, coalesce(a.date_of_birth = b.date_of_birth, TRUE) AS high FROM np a JOIN np b ON a.normalized = b.normalized AND a.normalized <> '' AND a.person_id < b.person_id),
  nb2 AS (SELECT x, y, high FROM nm UNION ALL SELECT y, x, high FROM nm),
  pp AS (SELECT DISTINCT a.case_id AS id1, b.case_id AS id2, a.person_id AS x, b.person_id AS y, TRUE AS high FROM case_persons a JOIN case_persons b ON a.person_id = b.person_id AND a.case_id < b.case_id
    UNION ALL SELECT a.case_id, b.case_id, x, y, high FROM case_persons a JOIN nb2 ON a.person_id = x JOIN case_persons b ON b.person_id = y WHERE a.case_id < b.case_id),
  pairs AS (SELECT DISTINCT id1, id2 FROM pp)"""
_W2 = repr((1 + log(1.5)) ** 2)
#: From tf (id, term, tf) and pr (id1, id2): the terms that both have are joined, all sums are whole numbers.
_WEIGHED = f"""sq AS (SELECT id, sum(tf * tf) AS q FROM tf GROUP BY id),
  su AS (SELECT id1, id2, sum(x.tf * y.tf) AS d, sum(x.tf * x.tf) AS sa, sum(y.tf * y.tf) AS sb FROM pr JOIN tf x ON x.id = id1 JOIN tf y ON y.id = id2 AND y.term = x.term GROUP BY ALL),
  co AS (SELECT pr.id1, pr.id2, coalesce(round(CAST(d AS DOUBLE) / (sqrt(CAST(sa AS DOUBLE) + CAST(p.q - sa AS DOUBLE) * {_W2}) * sqrt(CAST(sb AS DOUBLE) + CAST(r.q - sb AS DOUBLE) * {_W2})), 4), 0.0) AS cosine
    FROM pr LEFT JOIN su ON su.id1 = pr.id1 AND su.id2 = pr.id2 LEFT JOIN sq p ON p.id = pr.id1 LEFT JOIN sq r ON r.id = pr.id2)"""


def _method_score(own: str) -> str:
    """The method score from cosine, ta, tb: a fraction of whole numbers, halves up."""
    both, either = "len(list_intersect(ta, tb))", "len(list_distinct(list_concat(ta, tb)))"
    top = f"((6 * CAST(round(cosine * 10000) AS BIGINT) * {either} + 40000 * {both}) * CASE {own} WHEN 2 THEN 100 WHEN 1 THEN 95 ELSE 90 END)"
    return f"least(1.0e0, CASE WHEN {either} > 0 THEN ((2 * {top} + 1000 * {either}) // (2000 * {either})) / 10000e0 END)"


_METHODS = f"""pr AS (SELECT id1, id2 FROM pairs JOIN f a ON a.case_id = id1 JOIN f b ON b.case_id = id2 WHERE a.method IS NOT NULL AND b.method IS NOT NULL),
  used_m AS (SELECT case_id, method, method_source, {_method_words('method')} AS t FROM f WHERE case_id IN (SELECT id1 FROM pr UNION SELECT id2 FROM pr)),
  tf AS (SELECT id, term, count(*) AS tf FROM (SELECT case_id AS id, unnest({_terms('method')}) AS term FROM used_m) GROUP BY ALL),
  {_WEIGHED},
  mx AS (SELECT id1, id2, list_distinct(a.t) AS ta, list_distinct(b.t) AS tb, cosine, (a.method_source = 'DEDICATED_MO')::INT + (b.method_source = 'DEDICATED_MO')::INT AS own FROM co JOIN used_m a ON a.case_id = id1 JOIN used_m b ON b.case_id = id2),
  my AS (SELECT id1, id2, len(ta) > 0 AND len(tb) > 0 AS ok, {_method_score('own')} AS v FROM mx),
  ms AS (SELECT id1, id2, CASE WHEN ok THEN v ELSE 0.0e0 END AS c0, CASE WHEN NOT ok THEN 'UNAVAILABLE' WHEN v >= 0.70 THEN 'MATCH' WHEN v >= 0.25 THEN 'PARTIAL' ELSE 'MISMATCH' END AS s0 FROM my)"""
_POINTS = "(a.latitude BETWEEN -90 AND 90 AND b.latitude BETWEEN -90 AND 90 AND a.longitude BETWEEN -180 AND 180 AND b.longitude BETWEEN -180 AND 180)"
_COMPARED = f"""{_FEATURES}, {_PEOPLE}, {_METHODS},
  ov AS (SELECT id1, id2, max(CASE WHEN high THEN 1.0e0 ELSE 0.35e0 END) AS c7 FROM pp GROUP BY ALL),
  j AS (SELECT id1, id2, a, b, coalesce({_POINTS}, FALSE) AS gps, {km('a', 'b')} AS km, a.has_place AND b.has_place AS spots, {jaccard("list_distinct(string_split(a.place, ' '))", "list_distinct(string_split(b.place, ' '))")} AS pj,
    lower(trim(a.district)) = lower(trim(b.district)) AS near, abs(a.registration_date - b.registration_date) AS days, {jaccard('a.sections', 'b.sections')} AS js FROM pairs JOIN f a ON a.case_id = id1 JOIN f b ON b.case_id = id2),
  s AS (SELECT id1, id2, gps, km, spots, pj, a.plates AS pa, b.plates AS pb, a.numbers AS ta, b.numbers AS tb, coalesce(c0, 0e0) AS c0, coalesce(s0, 'UNAVAILABLE') AS s0, c7, CASE WHEN c7 = 1 THEN 'MATCH' ELSE 'PARTIAL' END AS s7,
    CASE WHEN a.crime_category = b.crime_category AND a.crime_type = b.crime_type THEN 1.0e0 WHEN a.crime_category = b.crime_category THEN 0.85e0 ELSE 0.0e0 END AS c1, CASE WHEN a.crime_category = b.crime_category THEN 'MATCH' ELSE 'MISMATCH' END AS s1,
    CASE WHEN len(a.sections) > 0 AND len(b.sections) > 0 THEN round(js, 4) ELSE 0.0e0 END AS c2, CASE WHEN len(a.sections) = 0 OR len(b.sections) = 0 THEN 'UNAVAILABLE' WHEN round(js, 4) >= 0.80 THEN 'MATCH' WHEN js > 0 THEN 'PARTIAL' ELSE 'MISMATCH' END AS s2,
    CASE WHEN gps THEN round(exp(-km / 10.0), 4) WHEN spots THEN CASE WHEN round(pj, 4) >= 0.70 THEN 0.75e0 WHEN round(pj, 4) >= 0.30 THEN 0.50e0 ELSE 0e0 END WHEN near THEN 0.40e0 ELSE 0e0 END AS c3,
    CASE WHEN gps THEN CASE WHEN km <= 1.0 THEN 'MATCH' WHEN km <= 15.0 THEN 'PARTIAL' ELSE 'MISMATCH' END WHEN spots THEN CASE WHEN round(pj, 4) >= 0.30 THEN 'PARTIAL' ELSE 'MISMATCH' END WHEN near THEN 'PARTIAL' ELSE 'MISMATCH' END AS s3,
    round(CASE WHEN a.time_bucket = b.time_bucket THEN least(1.0, exp(-days / 30.0) * 1.15) ELSE exp(-days / 30.0) END, 4) AS c4, CASE WHEN days <= 7 THEN 'MATCH' WHEN days <= 30 THEN 'PARTIAL' ELSE 'MISMATCH' END AS s4,
    CASE WHEN len(list_intersect(a.plates, b.plates)) > 0 THEN 1.0 ELSE 0.0 END AS c5, CASE WHEN len(a.plates) = 0 OR len(b.plates) = 0 THEN 'UNAVAILABLE' WHEN len(list_intersect(a.plates, b.plates)) > 0 THEN 'MATCH' ELSE 'MISMATCH' END AS s5,
    CASE WHEN len(list_intersect(a.numbers, b.numbers)) > 0 THEN 1.0 ELSE 0.0 END AS c6, CASE WHEN len(a.numbers) = 0 OR len(b.numbers) = 0 THEN 'UNAVAILABLE' WHEN len(list_intersect(a.numbers, b.numbers)) > 0 THEN 'MATCH' ELSE 'MISMATCH' END AS s6
    FROM j LEFT JOIN ms USING (id1, id2) JOIN ov USING (id1, id2))"""
_W = (25, 15, 10, 15, 10, 5, 5, 15)
_WEIGHT = " + ".join(f"CASE WHEN s{i} <> 'UNAVAILABLE' THEN {w} ELSE 0 END" for i, w in enumerate(_W))
_GAINED = " + ".join(f"CASE WHEN s{i} <> 'UNAVAILABLE' THEN {w} * CAST(round(c{i} * 10000) AS BIGINT) ELSE 0 END" for i, w in enumerate(_W))
_SHOWN = ", ".join(f"s{i} || ':' || printf('%.4f', c{i}) AS {n}" for i, n in enumerate(("method", "category", "legal", "geography", "time", "vehicles", "phones", "persons")))
_q(
    "case_similarity",
    f"""+ {_COMPARED}, r AS (SELECT *, ((2 * ({_GAINED}) + ({_WEIGHT})) // (2 * ({_WEIGHT}))) / 10000e0 AS score FROM s)
  SELECT id1, id2, {_SHOWN}, score, CASE WHEN score >= 0.75 THEN 'HIGH' WHEN score >= 0.50 THEN 'MODERATE' ELSE 'LOW' END AS level FROM r""",
    *_VIEWS,
)
_COSINE = f"""{_METHOD}, tk AS (SELECT DISTINCT doc_id AS id, w FROM (SELECT doc_id, unnest(t) AS w FROM m) WHERE length(w) >= 4),
  rare AS (SELECT w FROM tk GROUP BY w HAVING count(*) BETWEEN 2 AND 3),
  pr AS (SELECT DISTINCT a.id AS id1, b.id AS id2 FROM tk a JOIN rare USING (w) JOIN tk b USING (w) WHERE CAST(a.id AS VARCHAR) < CAST(b.id AS VARCHAR)),
  tf AS (SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest({_terms('description')}) AS term FROM narratives) GROUP BY ALL),
  {_WEIGHED}"""
_q("tfidf_cosine", f"+ {_COSINE} SELECT id1, id2, cosine FROM co", "narratives")
_q(
    "method_similarity",
    f"""+ {_COSINE}, x AS (SELECT id1, id2, list_distinct(a.t) AS ta, list_distinct(b.t) AS tb, cosine FROM co JOIN m a ON a.doc_id = id1 JOIN m b ON b.doc_id = id2),
  y AS (SELECT id1, id2, len(ta) > 0 AND len(tb) > 0 AS ok, {_method_score('0')} AS v FROM x)
  SELECT id1, id2, CASE WHEN ok THEN v ELSE 0.0e0 END AS score, CASE WHEN NOT ok THEN 'UNAVAILABLE' WHEN v >= 0.70 THEN 'MATCH' WHEN v >= 0.25 THEN 'PARTIAL' ELSE 'MISMATCH' END AS status FROM y""",
    "narratives",
)

# Links
_q(
    "quick_links",
    """+ sh AS (SELECT a.case_id AS id1, b.case_id AS id2, 'P' AS k FROM case_persons a JOIN case_persons b ON a.person_id = b.person_id AND a.case_id < b.case_id
    UNION ALL SELECT a.case_id, b.case_id, 'V' FROM case_vehicles a JOIN case_vehicles b ON a.vehicle_id = b.vehicle_id AND a.case_id < b.case_id),
  g AS (SELECT id1, id2, bool_or(k = 'P') AS p, bool_or(k = 'V') AS v FROM sh GROUP BY ALL), c AS (SELECT *, CASE WHEN p AND v THEN 0.95e0 WHEN p THEN 0.85e0 ELSE 0.70e0 END AS confidence FROM g)
  SELECT id1, id2, confidence, CASE WHEN confidence >= 0.85 THEN 'VERY_HIGH' ELSE 'HIGH' END AS level, CASE WHEN p THEN 'PERSON_IDENTITY' WHEN v THEN 'VEHICLE' ELSE 'CONTACT' END AS family FROM c""",
    "case_persons", "case_vehicles",
)
_q("shared_phone_buckets", f"+ t AS (SELECT DISTINCT {_NUMBER} AS number, case_id FROM case_phones JOIN phones USING (phone_id) WHERE {_NUMBER_OK}) SELECT number, count(*) AS cases, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS pairs FROM t GROUP BY number", "phones", "case_phones")
_SIGNALS = f"""{_COMPARED}, sg AS (
  SELECT id1, id2, CASE WHEN high THEN 'SHARED_HIGH_CONFIDENCE_PERSON' ELSE 'POSSIBLE_PERSON_RELATIONSHIP' END AS rel_type, CASE WHEN high THEN 1.0e0 ELSE 0.35e0 END AS score, CASE WHEN high THEN 'HIGH_CONFIDENCE_ENTITY' ELSE 'WEAK_UNVERIFIED' END AS certainty, NOT high AS unverified FROM pp
  UNION ALL SELECT id1, id2, 'SHARED_PHONE', 1.0e0, 'EXACT_ATTRIBUTE_MATCH', FALSE FROM (SELECT id1, id2, unnest(list_intersect(ta, tb)) AS v FROM s)
  UNION ALL SELECT id1, id2, 'SHARED_VEHICLE', 1.0e0, 'EXACT_ATTRIBUTE_MATCH', FALSE FROM (SELECT id1, id2, unnest(list_intersect(pa, pb)) AS v FROM s)
  UNION ALL SELECT id1, id2, 'SHARED_LOCATION', CASE WHEN NOT gps THEN 0.75e0 WHEN km <= 1.0 THEN 1.0e0 ELSE round(1 - km / 15.0 * 0.5, 4) END, 'CORRELATIONAL', FALSE FROM s WHERE CASE WHEN gps THEN km <= 15.0 ELSE spots AND pj >= 0.70 END
  UNION ALL SELECT id1, id2, 'SIMILAR_MODUS_OPERANDI', c0, 'INFERRED_PATTERN', FALSE FROM s WHERE s0 IN ('MATCH', 'PARTIAL')
  UNION ALL SELECT id1, id2, 'SIMILAR_CRIME_CATEGORY', c1, 'CONTEXTUAL', FALSE FROM s WHERE s1 = 'MATCH'
  UNION ALL SELECT id1, id2, 'SIMILAR_LEGAL_SECTIONS', c2, 'CONTEXTUAL', FALSE FROM s WHERE s2 IN ('MATCH', 'PARTIAL')
  UNION ALL SELECT id1, id2, 'TEMPORAL_PROXIMITY', c4, 'CORRELATIONAL', FALSE FROM s WHERE s4 IN ('MATCH', 'PARTIAL'))"""
_q("shared_location_signal", f"+ {_SIGNALS} SELECT id1, id2, score, certainty FROM sg WHERE rel_type = 'SHARED_LOCATION'", *_VIEWS)
for _kind in ("phone", "vehicle"):
    _q(f"shared_{_kind}_signal", f"+ {_SIGNALS} SELECT id1, id2, count(*) AS signals, max(score) AS score FROM sg WHERE rel_type = 'SHARED_{_kind.upper()}' GROUP BY id1, id2", *_VIEWS)
_q("all_signals", f"+ {_SIGNALS} SELECT * FROM sg", *_VIEWS)
# Weights in hundredths, scores in ten-thousandths, the first signal of a family in four quarters, 0.70 and 0.30 in hundredths.
_LINKED = f"""{_SIGNALS}, fam AS (SELECT *, {_map(FAMILIES, 'rel_type')} AS family, CAST(CASE rel_type {' '.join(f"WHEN '{k}' THEN {round(100 * w)}" for k, w in DEFAULT.link_weights.items())} END AS BIGINT) * CAST(round(score * 10000) AS BIGINT) AS worth FROM sg),
  placed_s AS (SELECT *, row_number() OVER (PARTITION BY id1, id2, family ORDER BY worth DESC, rel_type) AS k FROM fam),
  per_f AS (SELECT id1, id2, family, sum(worth * CASE WHEN k = 1 THEN 4 ELSE 1 END)::BIGINT AS worth, count(*) AS signals, bool_or(rel_type = 'SHARED_HIGH_CONFIDENCE_PERSON') AS sure, bool_or(unverified) AS unverified,
    count(*) FILTER (certainty IN ('HIGH_CONFIDENCE_ENTITY', 'EXACT_ATTRIBUTE_MATCH')) AS high, count(*) FILTER (certainty IN ('POSSIBLE_ENTITY', 'CORRELATIONAL', 'INFERRED_PATTERN', 'CONTEXTUAL')) AS possible FROM placed_s GROUP BY id1, id2, family),
  per_p AS (SELECT id1, id2, max(worth) AS top, sum(worth)::BIGINT AS every, count(*) AS n, sum(signals)::BIGINT AS signals, bool_or(unverified) AND NOT bool_or(sure) AS cautious, list_sort(list(family)) AS families, sum(high)::BIGINT AS high, sum(possible)::BIGINT AS possible FROM per_f GROUP BY id1, id2),
  raw_p AS (SELECT *, 70 * top + 30 * (every - top) + CASE WHEN n >= 2 THEN 60000000 ELSE 0 END + CASE WHEN n >= 3 THEN 40000000 ELSE 0 END + CASE WHEN n >= 4 THEN (n - 3) * 20000000 ELSE 0 END - CASE WHEN cautious THEN 40000000 ELSE 0 END AS raw FROM per_p),
  cf AS (SELECT *, id1 || ':' || id2 || ':RELATED_TO' AS pair_key, signals - high - possible AS weak, ((least(400000000, greatest(0, raw)) + 20000) // 40000) / 10000e0 AS score FROM raw_p),
  cl AS (SELECT *, CASE WHEN score >= 0.85 THEN 'VERY_HIGH' WHEN score >= 0.70 THEN 'HIGH' WHEN score >= 0.50 THEN 'MODERATE' WHEN score >= 0.25 THEN 'LOW' ELSE 'INSUFFICIENT_DATA' END AS level FROM cf)"""
_q("pair_confidence", f"+ {_LINKED} SELECT id1, id2, pair_key, score, level, array_to_string(families, ',') AS families, signals, high, possible, weak FROM cl", *_VIEWS)

# Graph
_GRAPH_VIEWS = ("cases", "persons", "vehicles", "phones", "locations", "evidences", "case_persons", "case_vehicles", "case_phones", "case_sections")
_SECTIONS = f"cs AS (SELECT DISTINCT case_id, {section('section')} AS section FROM case_sections)"
_NODES = """nodes AS (SELECT case_id AS node_id, 'Case' AS label, station_id, 'fir_number' AS props FROM cases UNION ALL SELECT person_id, 'Person', NULL, 'name' FROM persons UNION ALL SELECT vehicle_id, 'Vehicle', NULL, 'registration' FROM vehicles
  UNION ALL SELECT phone_id, 'Phone', NULL, 'number' FROM phones UNION ALL SELECT location_id, 'Location', NULL, 'locality' FROM locations UNION ALL SELECT evidence_id, 'Evidence', NULL, 'kind' FROM evidences UNION ALL SELECT DISTINCT section, 'LegalSection', NULL, '' FROM cs)"""
_EDGES = """edges AS (SELECT *, CASE WHEN rel_type = 'RELATED_TO' THEN src || ':' || dst || ':RELATED_TO' ELSE src || ':' || rel_type || ':' || dst END AS edge_id FROM (SELECT DISTINCT case_id AS src, person_id AS dst, 'HAS_PERSON' AS rel_type FROM case_persons UNION ALL SELECT case_id, vehicle_id, 'HAS_VEHICLE' FROM case_vehicles UNION ALL SELECT case_id, phone_id, 'HAS_PHONE' FROM case_phones
  UNION ALL SELECT case_id, location_id, 'HAS_LOCATION' FROM cases UNION ALL SELECT case_id, evidence_id, 'HAS_EVIDENCE' FROM evidences UNION ALL SELECT case_id, section, 'HAS_LEGAL_SECTION' FROM cs
  UNION ALL SELECT DISTINCT a.case_id, b.case_id, 'RELATED_TO' FROM case_persons a JOIN case_persons b ON a.person_id = b.person_id AND a.case_id < b.case_id) e WHERE src IN (SELECT node_id FROM nodes) AND dst IN (SELECT node_id FROM nodes))"""
_q("graph_nodes", f"+ {_SECTIONS}, {_NODES} SELECT * FROM nodes", *_GRAPH_VIEWS)
_q("graph_edges", f"+ {_SECTIONS}, {_NODES}, {_EDGES} SELECT edge_id, src, dst, rel_type FROM edges", *_GRAPH_VIEWS)
_q("graph_counts", f"+ {_SECTIONS}, {_NODES}, {_EDGES} SELECT label AS kind, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT rel_type, count(*) FROM edges GROUP BY rel_type", *_GRAPH_VIEWS)
_q(
    "node_degrees",
    f"""+ {_SECTIONS}, {_NODES}, {_EDGES}, d AS (SELECT id, sum(o) AS o, sum(i) AS i, sum(CASE WHEN rel_type = 'RELATED_TO' THEN 85 ELSE 100 END) AS w FROM (SELECT src AS id, 1 AS o, 0 AS i, rel_type FROM edges UNION ALL SELECT dst, 0, 1, rel_type FROM edges) GROUP BY id)
  SELECT node_id, label, CAST(coalesce(i, 0) AS BIGINT) AS in_degree, CAST(coalesce(o, 0) AS BIGINT) AS out_degree, CAST(coalesce(i + o, 0) AS BIGINT) AS total_degree, CAST(coalesce(w, 0) AS DOUBLE) / 100 AS weighted_degree FROM nodes LEFT JOIN d ON id = node_id""",
    *_GRAPH_VIEWS,
)
_PV = ("cases", "persons", "case_persons")
_PGRAPH = """nodes AS (SELECT case_id AS node_id, 'Case' AS label, station_id FROM cases UNION ALL SELECT person_id, 'Person', NULL FROM persons),
  edges AS (SELECT DISTINCT case_id AS src, person_id AS dst, 'HAS_PERSON' AS rel_type, 1.0 AS w FROM case_persons UNION ALL
    SELECT a.case_id, b.case_id, 'RELATED_TO', 0.85 FROM cases a JOIN cases b ON a.person_id = b.person_id AND year(a.registration_date) = year(b.registration_date) AND a.case_id < b.case_id),
  placed AS (SELECT n.node_id, n.label, n.station_id, coalesce(m.c, n.node_id) AS component FROM nodes n LEFT JOIN (SELECT person_id, min(case_id) AS c FROM case_persons GROUP BY person_id) m
    ON m.person_id = CASE WHEN n.label = 'Person' THEN n.node_id ELSE (SELECT cp.person_id FROM case_persons cp WHERE cp.case_id = n.node_id) END),
  both_ways AS (SELECT src AS near, dst AS far FROM edges UNION SELECT dst, src FROM edges)"""
_SUMMARY = "summary AS (SELECT component, count(*) AS size, count(*) FILTER (label = 'Case') AS cases, count(DISTINCT CASE WHEN label = 'Case' THEN station_id END) AS stations FROM placed GROUP BY component)"
_REACH = """reach AS (SELECT id, count(DISTINCT c) AS cases, count(DISTINCT station_id) AS stations FROM (SELECT near AS id, far AS c FROM both_ways JOIN nodes ON node_id = far AND label = 'Case' UNION SELECT node_id, node_id FROM nodes WHERE label = 'Case') JOIN nodes ON node_id = c GROUP BY id)"""
# The whole graph has one component of several nodes here: what can be reached from its smallest node. Nodes without edges are their own.
_WHOLE = f"""{_SECTIONS}, {_NODES}, {_EDGES}, both_ways AS (SELECT src AS near, dst AS far FROM edges UNION SELECT dst, src FROM edges),
  seen(id) AS (SELECT min(near) FROM both_ways UNION SELECT far FROM seen JOIN both_ways ON near = id),
  placed AS (SELECT node_id, label, station_id, CASE WHEN s.id IS NOT NULL THEN (SELECT min(id) FROM seen) ELSE node_id END AS component FROM nodes LEFT JOIN seen s ON s.id = node_id)"""
_q("case_reach", f"+ {_WHOLE}, {_REACH} SELECT node_id, coalesce(cases, 0) AS cases, coalesce(stations, 0) AS stations FROM nodes LEFT JOIN reach ON id = node_id", *_GRAPH_VIEWS, recursive=True)
_q("graph_components", f"+ {_WHOLE}, {_SUMMARY} SELECT 'comp:' || component AS component_id, size, cases, stations, stations > 1 AS cross_station FROM summary", *_GRAPH_VIEWS, recursive=True)
_COMMUNITY = f"""{_SUMMARY}, ie AS (SELECT component, rel_type, src, dst FROM edges JOIN placed ON node_id = src),
  pc AS (SELECT component, count(*) AS pairs FROM (SELECT DISTINCT component, least(src, dst) AS x, greatest(src, dst) AS y FROM ie) GROUP BY component),
  et AS (SELECT component, sum(n) AS edge_count, string_agg(rel_type || ':' || n, ',' ORDER BY rel_type) AS edge_types FROM (SELECT component, rel_type, count(*) AS n FROM ie GROUP BY ALL) GROUP BY component),
  lt AS (SELECT component, string_agg(label || ':' || n, ',' ORDER BY label) AS labels FROM (SELECT component, label, count(*) AS n FROM placed GROUP BY ALL) GROUP BY component),
  cm AS (SELECT 'community:' || component AS community_id, size AS member_count, round(2.0 * coalesce(pairs, 0) / (size * (size - 1)), 4) AS density, CAST(coalesce(edge_count, 0) AS BIGINT) AS edge_count, cases AS case_count, stations AS station_count, stations > 1 AS spans_cross_station, labels, coalesce(edge_types, '') AS edge_types
    FROM summary LEFT JOIN pc USING (component) LEFT JOIN et USING (component) JOIN lt USING (component) WHERE size >= 2)"""
_COMMUNITIES = f"{_PGRAPH}, {_COMMUNITY}"
_q("communities", f"+ {_WHOLE}, {_COMMUNITY} SELECT * FROM cm", *_GRAPH_VIEWS, recursive=True)
# Within a component all nodes touch the person, so a distance is 1 or 2; shortest paths of length 2 are counted by joins.
_METRICS = f"""{_PGRAPH}, {_SUMMARY}, {_REACH},
  deg AS (SELECT id, count(*) AS d, CAST(round(sum(w), 4) AS DOUBLE) AS wd FROM (SELECT src AS id, w FROM edges UNION ALL SELECT dst, w FROM edges) GROUP BY id),
  nb AS (SELECT near, count(*) AS k FROM both_ways GROUP BY near),
  two AS (SELECT a.near AS s, b.far AS t, a.far AS v FROM both_ways a JOIN both_ways b ON a.far = b.near AND a.near < b.far WHERE NOT EXISTS (SELECT 1 FROM both_ways c WHERE c.near = a.near AND c.far = b.far)),
  ways AS (SELECT s, t, count(*) AS n FROM two GROUP BY s, t),
  bt AS (SELECT v, sum(1.0 / n) AS g FROM two JOIN ways USING (s, t) GROUP BY v),
  mt AS (SELECT p.node_id, label, CAST(coalesce(d, 0) AS BIGINT) AS total_degree, coalesce(wd, 0.0) AS weighted_degree, coalesce(r.cases, 0) AS cases, coalesce(r.stations, 0) AS stations,
    CASE WHEN size > 1 THEN least(1.0, round(coalesce(d, 0) / (size - 1), 4)) ELSE 0.0 END AS degree_centrality, CASE WHEN size > 1 THEN round((size - 1) / (k + 2.0 * (size - 1 - k)), 4) ELSE 0.0 END AS closeness,
    CASE WHEN size > 2 THEN round(coalesce(g, 0) / ((size - 1) * (size - 2) / 2.0), 4) ELSE 0.0 END AS betweenness, 'comp:' || component AS component_id
    FROM placed p JOIN summary USING (component) LEFT JOIN deg ON deg.id = node_id LEFT JOIN nb ON near = node_id LEFT JOIN bt ON v = node_id LEFT JOIN reach r ON r.id = node_id),
  mr AS (SELECT *, CASE WHEN betweenness >= 0.2 THEN 'High betweenness centrality connector node in network component.' WHEN stations >= 2 THEN 'Cross-station network connector linking multiple police stations.'
    WHEN label <> 'Case' AND cases >= 2 THEN 'Shared ' || lower(label) || ' entity bridging ' || cases || ' distinct cases.' END AS role FROM mt)"""
_q("network_metrics", f"+ {_METRICS} SELECT *, role IS NOT NULL AS is_connector FROM mr", *_PV)
_TWO = f"{_SECTIONS}, {_NODES}, {_EDGES}, used AS (SELECT * FROM edges WHERE rel_type IN ('HAS_PERSON', 'HAS_VEHICLE')), bw AS (SELECT src AS near, dst AS far, edge_id, rel_type FROM used UNION ALL SELECT dst, src, edge_id, rel_type FROM used)"
_TRAILS = f"""{_TWO}, bl AS (SELECT bw.*, label AS far_label FROM bw JOIN nodes ON node_id = far),
  tr AS (SELECT 'C0000000001' AS start_id, 'C0000000001' AS end_id, 'Case' AS end_label, 0 AS hops, '' AS path_key, ['C0000000001'] AS ns, CAST([] AS VARCHAR[]) AS es
    UNION ALL SELECT start_id, far, far_label, hops + 1, path_key || CASE WHEN path_key = '' THEN '' ELSE '->' END || '(' || end_label || ':' || end_id || ')-[' || rel_type || ']->(' || far_label || ':' || far || ')', list_append(ns, far), list_append(es, edge_id)
    FROM tr JOIN bl ON near = end_id WHERE hops < 3 AND NOT list_contains(es, edge_id))"""
_q("traverse_depth3", f"+ {_TRAILS} SELECT DISTINCT start_id, end_id, hops, path_key FROM tr WHERE hops > 0", *_GRAPH_VIEWS, recursive=True)
_NAMED = """named AS (SELECT case_id AS id, 'Case' AS label, station_id, fir_number AS shown FROM cases UNION ALL SELECT person_id, 'Person', NULL, name FROM persons UNION ALL SELECT vehicle_id, 'Vehicle', NULL, registration_number FROM vehicles)"""
_q(
    "path_properties",
    f"""+ {_SECTIONS}, {_NODES}, {_EDGES}, {_NAMED}, bw AS (SELECT src AS near, dst AS far, edge_id, rel_type, CASE WHEN rel_type = 'RELATED_TO' THEN 0.85 ELSE 1.0 END AS w FROM edges WHERE rel_type IN ('HAS_PERSON', 'HAS_VEHICLE', 'RELATED_TO')
    UNION ALL SELECT dst, src, edge_id, rel_type, CASE WHEN rel_type = 'RELATED_TO' THEN 0.85 ELSE 1.0 END FROM edges WHERE rel_type IN ('HAS_PERSON', 'HAS_VEHICLE', 'RELATED_TO')),
  st AS (SELECT b.*, x.label AS la, y.label AS lb, '(' || x.label || ':' || near || ')-[' || rel_type || ']->(' || y.label || ':' || far || ')' AS piece, concat_ws('/', x.label, near, x.station_id, x.shown) AS na, concat_ws('/', y.label, far, y.station_id, y.shown) AS nb,
    edge_id || '/' || CASE WHEN w = 1 THEN '1.0' ELSE '0.85' END AS e FROM bw b JOIN named x ON x.id = near JOIN named y ON y.id = far),
  h1 AS (SELECT * FROM st WHERE near = 'C0000000001'),
  h2 AS (SELECT a.piece || '->' || b.piece AS path_key, a.na || ',' || a.nb || ',' || b.nb AS nodes, a.e || ',' || b.e AS edges FROM h1 a JOIN st b ON a.far = b.near AND a.edge_id <> b.edge_id)
  SELECT 'C0000000001' AS start_id, piece AS path_key, na || ',' || nb AS nodes, e AS edges FROM h1 UNION ALL SELECT 'C0000000001', path_key, nodes, edges FROM h2""",
    *_GRAPH_VIEWS,
)
_HOOD = "hd AS (SELECT 'C0000000001' AS node_id, 0 AS distance UNION SELECT far, distance + 1 FROM hd JOIN bw ON near = node_id WHERE distance < 2), hood AS (SELECT node_id, min(distance) AS distance FROM hd GROUP BY node_id)"
_q("neighbourhood_depth2", f"+ {_TWO}, {_HOOD} SELECT * FROM hood", *_GRAPH_VIEWS, recursive=True)
_q("induced_edges", f"+ {_TWO}, {_HOOD} SELECT edge_id FROM used WHERE src IN (SELECT node_id FROM hood) AND dst IN (SELECT node_id FROM hood)", *_GRAPH_VIEWS, recursive=True)
_q(
    "multi_hop_paths",
    f"""+ {_TRAILS}, tp AS (SELECT row_number() OVER (ORDER BY hops, end_id, path_key) AS path_rank, hops, ns FROM (SELECT DISTINCT hops, end_id, path_key, ns FROM tr WHERE hops > 0) QUALIFY path_rank <= 5)
  SELECT path_rank, h AS hop, ns[h] AS src, ns[h + 1] AS dst, 0.9e0 AS confidence FROM tp, unnest(range(1, hops + 1)) u(h)""",
    *_GRAPH_VIEWS, recursive=True,
)

# Patterns
_KEEP = " AND ".join(f"NOT contains(lower(title || ' ' || description), {_text(w)})" for w in PATTERN_WORDS)
_OUT = "pattern_id, pattern_type, title, description, first_case, entity_id, stations, array_to_string(signals, ',') AS signals, occurrence_count, strength"


def _pattern(kind: str, rows: str, title: str, description: str, signals: str, strength: str, entity: str = "CAST(NULL AS VARCHAR)", of: str | None = None) -> str:
    """rows: n, first_case, stations and what the texts use; of: the entity that the id is made of."""
    one = f"[{of or entity}]" if of or entity[:4] != "CAST" else "CAST([] AS VARCHAR[])"
    body = content_id(kind, "CAST([] AS VARCHAR[])", one, "signals")
    return f"""SELECT * FROM (SELECT 'pat:{kind.lower()}:' || {body} AS pattern_id, '{kind}' AS pattern_type, title, description, first_case, entity_id, stations, signals, n AS occurrence_count, round(least(1.0, strength), 4) AS strength
    FROM (SELECT *, {title} AS title, {description} AS description, {signals} AS signals, {strength} AS strength, {entity} AS entity_id FROM ({rows}))) WHERE {_KEEP}"""


def _entity(kind: str, ptype: str, links: str) -> str:
    rows = f"SELECT entity, count(DISTINCT case_id) AS n, min(case_id) AS first_case, count(DISTINCT station_id) AS stations, arg_min(name, case_id) AS name FROM (SELECT DISTINCT case_id, entity, name FROM ({links})) JOIN cases USING (case_id) GROUP BY entity HAVING count(DISTINCT case_id) >= 2"
    if kind in ("Vehicle", "Phone"):
        title, text = f"'Recurring {kind} Entity Pattern: ' || name", f"'{kind} entity ''' || name || ''' is associated with ' || n || ' distinct cases.'"
    else:
        title = f"'Recurring {'Person Entity' if kind == 'Person' else 'Location'} Pattern across ' || n || ' Cases'"
        text = f"'{'Person entity' if kind == 'Person' else 'Location'} ''' || name || ''' is associated with ' || n || ' distinct cases across ' || stations || ' police station(s).'"
    return _pattern(ptype, rows, title, text, f"['Shared {kind} Entity: ' || name || ' (' || entity || ')']", "n / 4.0e0", "entity")


_PATTERNS = {
    "modus_operandi": (
        _pattern(
            "MODUS_OPERANDI",
            """SELECT g.*, kinds FROM (SELECT crime_category, crime_type, count(*) AS n, min(case_id) AS first_case, count(DISTINCT station_id) AS stations FROM cases GROUP BY ALL HAVING count(*) >= 2) g
      LEFT JOIN (SELECT crime_category, crime_type, list_sort(list(DISTINCT 'Evidence Type: ' || evidence_type)) AS kinds FROM cases JOIN evidences USING (case_id) GROUP BY ALL) k USING (crime_category, crime_type)""",
            "'Recurring Operational Characteristics Pattern: ' || crime_type",
            "'Identified ' || n || ' cases exhibiting matching crime category ''' || crime_category || ''' and operational crime type ''' || crime_type || '''. Indicates shared operational characteristics across cases.'",
            "list_concat(['Crime Category: ' || crime_category, 'Crime Type: ' || crime_type], coalesce(kinds, []))",
            "n / 5.0e0",
        ),
        ("cases", "evidences"),
    ),
    "person": (_entity("Person", "RECURRING_ENTITY", "SELECT case_id, person_id AS entity, name FROM case_persons JOIN persons USING (person_id)").replace("USING (case_id) GROUP", "USING (case_id) GROUP"), ("cases", "persons", "case_persons")),
    "location": (_entity("Location", "RECURRING_LOCATION", "SELECT case_id, location_id AS entity, coalesce(l.address, l.district) AS name FROM cases JOIN locations l USING (location_id)"), ("cases", "locations")),
    "vehicle": (_entity("Vehicle", "RECURRING_VEHICLE_PHONE", "SELECT case_id, vehicle_id AS entity, registration_number AS name FROM case_vehicles JOIN vehicles USING (vehicle_id)"), ("cases", "vehicles", "case_vehicles")),
    "phone": (_entity("Phone", "RECURRING_VEHICLE_PHONE", "SELECT case_id, phone_id AS entity, number AS name FROM case_phones JOIN phones USING (phone_id)"), ("cases", "phones", "case_phones")),
    "temporal": (
        _pattern(
            "TEMPORAL_CLUSTER",
            """SELECT case_id AS first_case, registration_date AS day, CAST(NULL AS BIGINT) AS stations, (SELECT sum(m) FROM days d WHERE d.day <= c.registration_date + 30) - row_number() OVER (ORDER BY registration_date, case_id) + 1 AS n,
      (SELECT max(d.day) FROM days d WHERE d.day <= c.registration_date + 30) AS end_day FROM cases c""",
            "'Temporal Recurrence Cluster: ' || n || ' Cases in 30 Days'",
            "'Identified ' || n || ' cases registered within a 30-day temporal window between ' || strftime(day, '%Y-%m-%d') || ' and ' || strftime(end_day, '%Y-%m-%d') || '.'",
            "['Temporal Window: 30 Days', 'Span: ' || strftime(day, '%Y-%m-%d') || ' to ' || strftime(end_day, '%Y-%m-%d')]",
            "n / 5.0e0",
            of="first_case",
        ).replace("n AS occurrence_count", "CAST(n AS BIGINT) AS occurrence_count").replace(f"WHERE {_KEEP}", f"WHERE occurrence_count >= 2 AND {_KEEP}"),
        ("cases",),
    ),
    "cross_station": (
        _pattern(
            "GEOGRAPHIC_CROSS_STATION",
            "SELECT count(*) AS n, min(case_id) AS first_case, count(DISTINCT station_id) AS stations, string_agg(DISTINCT station_id, ', ' ORDER BY station_id) AS names FROM cases HAVING count(DISTINCT station_id) >= 2",
            "'Cross-Station Structural Pattern across ' || stations || ' Stations'",
            "'Identified structural case activity spanning ' || stations || ' police stations (' || names || ').'",
            "['Cross-Station Activity: ' || stations || ' Police Stations']",
            "stations / 4.0e0",
        ),
        ("cases",),
    ),
    "characteristics": (
        _pattern(
            "CASE_CHARACTERISTIC",
            "SELECT crime_category, crime_type, district, count(*) AS n, min(case_id) AS first_case, count(DISTINCT station_id) AS stations FROM cases GROUP BY ALL HAVING count(*) >= 2",
            "'Structured Case Characteristic Combination: ' || crime_type || ' in ' || district",
            "'Identified ' || n || ' cases sharing matching crime category ''' || crime_category || ''', crime type ''' || crime_type || ''', and district ''' || district || '''.'",
            "['Category: ' || crime_category, 'Crime Type: ' || crime_type, 'District: ' || district]",
            "n / 5.0e0",
        ),
        ("cases",),
    ),
}
_DAYS = "days AS (SELECT registration_date AS day, count(*) AS m FROM cases GROUP BY registration_date)"
for _name, (_sql, _used) in _PATTERNS.items():
    _q(f"pattern_{_name}", f"+ {_DAYS}, pt AS ({_sql}) SELECT {_OUT} FROM pt", *_used)
_EVERY = ("cases", "persons", "vehicles", "phones", "locations", "evidences", "case_persons", "case_vehicles", "case_phones")
_q("pattern_histogram", f"+ {_DAYS}, pt AS ({' UNION ALL '.join(s for s, _ in _PATTERNS.values())}) SELECT pattern_type, count(*) AS n FROM pt GROUP BY pattern_type", *_EVERY)
_STRUCTURAL = [
    _pattern(
        "GRAPH_STRUCTURAL",
        "SELECT community_id AS entity, member_count AS n, CAST(NULL AS VARCHAR) AS first_case, station_count AS stations, density, spans_cross_station FROM cm WHERE spans_cross_station OR density >= 0.2",
        "'Graph Structural Pattern: Community Cluster (' || entity || ')'",
        "'Identified dense graph community cluster ''' || entity || ''' with ' || n || ' member nodes and structural density ' || density || '.'",
        "list_filter(['Community Density: ' || density, 'Member Count: ' || n, CASE WHEN spans_cross_station THEN 'Spans Multiple Stations' END], lambda x: x IS NOT NULL)",
        "density", "entity",
    ),
    _pattern(
        "GRAPH_STRUCTURAL",
        "SELECT node_id AS entity, label, total_degree AS n, CAST(NULL AS VARCHAR) AS first_case, stations, betweenness, cases, role FROM mr WHERE role IS NOT NULL",
        "'Graph Structural Pattern: Network Connector (' || label || ':' || entity || ')'",
        "'Identified high-centrality network connector node ''' || entity || ''' (' || label || ') connecting ' || cases || ' cases.'",
        "['Connector Role: ' || role]", "betweenness", "entity",
    ),
]
_ALL_GRAPH = f"{_METRICS}, {_COMMUNITIES.split(_SUMMARY + ', ', 1)[1]}"
_q("pattern_structural", f"+ {_ALL_GRAPH}, pt AS ({' UNION ALL '.join(_STRUCTURAL)}) SELECT {_OUT.replace('first_case, ', '')} FROM pt WHERE occurrence_count >= 2", *_PV)

# Explanations
_TOLD = "explanation_id, subject_id, subject_type, title, observation, explanation, case_ids, entity_ids, signals, weight, limitations"
_TELL = " AND ".join(f"NOT contains(lower(title || ' ' || observation || ' ' || explanation), {_text(w)})" for w in EXPLAIN_WORDS)
_OF_PATTERNS = f"""ex AS (SELECT 'exp:pattern:' || {content_id('exp:pattern', '[pattern_id, coalesce(entity_id, first_case)]')} AS explanation_id, coalesce(entity_id, first_case) AS subject_id,
    CASE WHEN pattern_type = 'RECURRING_ENTITY' THEN 'Person' WHEN pattern_type = 'RECURRING_LOCATION' THEN 'Location' WHEN starts_with(entity_id, 'V') THEN 'Vehicle' WHEN starts_with(entity_id, 'T') THEN 'Phone' ELSE 'Case' END AS subject_type,
    'Explanation for ' || title AS title, 'Pattern observation ''' || title || ''' was detected with structural strength ' || strength || ' across ' || occurrence_count || ' occurrences.' AS observation,
    'The analytical pattern was derived because ' || description || ' Supporting signals include: ' || array_to_string(signals, ', ') || '.' AS explanation, '' AS case_ids, coalesce(entity_id, '') AS entity_ids, array_to_string(signals, ',') AS signals,
    strength AS weight, CAST(CASE WHEN pattern_type = 'MODUS_OPERANDI' THEN 3 ELSE 2 END AS BIGINT) AS limitations FROM (SELECT * REPLACE (CAST(strength AS DOUBLE) AS strength) FROM pt))"""


def _union(*names: str) -> str:
    return " UNION ALL ".join(_PATTERNS[n][0] for n in names)


_q("explain_patterns", f"+ {_DAYS}, pt AS ({_union('modus_operandi', 'person', 'vehicle')}), {_OF_PATTERNS} SELECT {_TOLD} FROM ex WHERE {_TELL}", *_EVERY)
_OF_LINKS = f"""lx AS (SELECT 'exp:relationship:' || {content_id('exp:relationship', '[pair_key]')} AS explanation_id, pair_key AS subject_id, 'CasePair' AS subject_type, 'Explanation for Relationship Link (' || level || ')' AS title,
    'Relationship link between Case ' || id1 || ' and Case ' || id2 || ' evaluated with ' || level || ' confidence (score: ' || CAST(score AS DOUBLE) || ').' AS observation,
    'Step 5B Confidence Assessment: ' || level || ' confidence based on ' || array_to_string(list_filter([CASE WHEN high > 0 THEN high || ' high-confidence/exact signal(s)' END, CASE WHEN possible > 0 THEN possible || ' possible/pattern signal(s)' END,
      CASE WHEN weak > 0 THEN weak || ' weak signal(s)' END], lambda x: x IS NOT NULL), ', ') || ' across ' || len(families) || ' evidence categories. Relationship Confidence: ' || level
      || ' (Score: ' || printf('%.2f', CAST(score AS DOUBLE)) || '). Contributing Evidence Categories (' || len(families) || '): ' || array_to_string(families, ', ') || '.' AS explanation,
    id1 || ',' || id2 AS case_ids, '' AS entity_ids, array_to_string(list_transform(families, lambda x: 'Contributing Signal Family: ' || x), ',') AS signals, CAST(score AS DOUBLE) AS weight, CAST(2 + cautious::INT AS BIGINT) AS limitations FROM cl)"""
_q("explain_links", f"+ {_LINKED}, {_OF_LINKS} SELECT {_TOLD} FROM lx", *_VIEWS)
_OF_COMMUNITIES = f"""cx AS (SELECT 'exp:community:' || {content_id('exp:community', '[community_id]')} AS explanation_id, community_id AS subject_id, 'Community' AS subject_type, 'Explanation for Graph Community (' || community_id || ')' AS title,
    'Graph structural community ''' || community_id || ''' identified with ' || member_count || ' member nodes and density ' || density || '.' AS observation,
    'Community cluster derived from graph structural modularity. Spans multiple police stations: ' || CASE WHEN spans_cross_station THEN 'True' ELSE 'False' END || '. Total station count: ' || station_count || '.' AS explanation,
    '' AS case_ids, '' AS entity_ids, 'Community Structural Density: ' || density AS signals, density AS weight, CAST(2 AS BIGINT) AS limitations FROM cm)"""
_q("explain_communities", f"+ {_WHOLE}, {_COMMUNITY}, {_OF_COMMUNITIES} SELECT {_TOLD} FROM cx", *_GRAPH_VIEWS, recursive=True)
_OF_CONNECTORS = f"""nx AS (SELECT 'exp:connector:' || {content_id('exp:connector', '[node_id]')} AS explanation_id, node_id AS subject_id, label AS subject_type, 'Explanation for Network Connector Node (' || label || ':' || node_id || ')' AS title,
    'Network node ''' || node_id || ''' (' || label || ') identified as high-centrality connector node connecting ' || cases || ' cases.' AS observation,
    'High structural centrality detected with total degree ' || total_degree || ' and betweenness centrality ' || printf('%.4f', betweenness) || '. Role summary: ' || role || '.' AS explanation,
    '' AS case_ids, node_id AS entity_ids, 'Betweenness Centrality: ' || printf('%.4f', betweenness) AS signals, betweenness AS weight, CAST(2 AS BIGINT) AS limitations FROM mr WHERE role IS NOT NULL)"""
_q("explain_connectors", f"+ {_METRICS}, {_OF_CONNECTORS} SELECT {_TOLD} FROM nx", *_PV)
_q(
    "explain_histogram",
    f"+ {_DAYS}, pt AS ({_union('person', 'vehicle', 'phone', 'location')}), {_OF_PATTERNS}, {_ALL_GRAPH}, {_OF_COMMUNITIES}, {_OF_CONNECTORS} SELECT subject_type, count(*) AS n FROM (SELECT {_TOLD} FROM ex WHERE {_TELL} UNION ALL SELECT {_TOLD} FROM cx UNION ALL SELECT {_TOLD} FROM nx) GROUP BY subject_type",
    *_EVERY,
)

# Privacy and report

def _prepared(column: str) -> str:
    out = f"regexp_replace(coalesce({column}, ''), {_text(SECRETS)}, '{SECRET_MARK}', 'g')"
    for d in DIRECTIVES:
        out = f"regexp_replace({out}, {_text(d)}, '{DIRECTIVE_MARK}', 'g')"
    return out


def _count(text: str, mark: str) -> str:
    return f"CAST((length({text}) - length(replace({text}, '{mark}', ''))) / {len(mark)} AS BIGINT)"


_q("redact_texts", f"WITH d AS (SELECT doc_id, {_prepared('text')} AS t FROM documents) SELECT doc_id, {_count('t', SECRET_MARK)} AS secrets, {_count('t', DIRECTIVE_MARK)} AS directives, md5(t) AS digest FROM d")
_q("redact_pages", f"WITH d AS (SELECT page_id, {_prepared('html')} AS t FROM pages) SELECT page_id, {_count('t', SECRET_MARK)} AS secrets, md5(t) AS digest FROM d")
_LETTERS = "".join(f"WHEN n <= {sum(26**i for i in range(1, k + 1))} THEN " + " || ".join(f"chr(CAST(65 + ((n - {sum(26**i for i in range(j + 1))}) // {26**j}) % 26 AS INT))" for j in range(k - 1, -1, -1)) + " " for k in range(1, 5))
_q(
    "alias_table",
    f"""+ vs AS (SELECT case_id AS value, 'Case' AS kind, case_id AS c, 0 AS p, '' AS v FROM cases UNION ALL SELECT fir_number, 'Case', case_id, 1, '' FROM cases UNION ALL SELECT name, 'Person', case_id, 2, name FROM case_persons JOIN persons USING (person_id)),
  fs AS (SELECT trim(value) AS original, arg_min(kind, ROW(c, p, v)) AS kind, min(ROW(c, p, v)) AS pos FROM vs WHERE trim(value) <> '' GROUP BY trim(value)),
  nm AS (SELECT original, kind, row_number() OVER (PARTITION BY kind ORDER BY pos, original) AS n FROM fs)
  SELECT original, kind || '-' || CASE {_LETTERS} END AS alias, kind, n AS number FROM nm""",
    "cases", "persons", "case_persons",
)
_q(
    "scan_output",
    "WITH s AS (SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(coalesce(text, ''), {_text(p)}) THEN 'SECRET'" for p in OUTPUT_SECRETS) + " " + " ".join(f"WHEN regexp_matches(coalesce(text, ''), {_text(p)}) THEN '{n}'" for n, p in RAW.items()) + " END AS finding FROM documents) SELECT *, finding IS NULL AS is_clean FROM s",
)
_SAY = " AND ".join(f"NOT contains(lower(statement), {_text(w)})" for w in (*EXPLAIN_WORDS, *COERCIVE))
_STATEMENTS = f"st AS (SELECT explanation_id, subject_type, 'Structured Explanation (' || subject_type || ':' || subject_id || '): ' || observation AS statement, CAST(0 AS BIGINT) AS case_count, CAST(1 AS BIGINT) AS entity_count FROM ex WHERE {_TELL}), sk AS (SELECT * FROM st WHERE {_SAY})"
_q("report_statements", f"+ {_DAYS}, pt AS ({_union('person', 'location')}), {_OF_PATTERNS}, {_STATEMENTS} SELECT * FROM sk", *_EVERY)
_q(
    "report_summary",
    f"""+ {_DAYS}, pt AS ({_union('person', 'location', 'vehicle')}), {_OF_PATTERNS}, {_STATEMENTS}, per AS (SELECT subject_type, count(*) AS n FROM sk GROUP BY subject_type)
  SELECT 'reasoning_fb:' || {content_id('reasoning_fb', "['llm-privacy-boundary-v1', 'FALLBACK_USED']")} AS report_id, 'FALLBACK_USED' AS status, CAST(sum(n) AS BIGINT) AS sentences, string_agg(subject_type || ':' || n, ',' ORDER BY subject_type || ':' || n) AS by_subject, {_text(FOLLOW_UP)} AS follow_up FROM per""",
    *_EVERY,
)
_q("ground_statements", "SELECT case_id AS statement_id, CASE WHEN case_id IN (SELECT case_id FROM cases) THEN case_id ELSE '' END AS grounded, case_id IN (SELECT case_id FROM cases) AS is_grounded FROM case_persons", "cases", "case_persons")
_q("event_activity", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
