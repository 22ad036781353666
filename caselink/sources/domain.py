"""The case tables: schemas, and views that render star-schema tables as cases.

The views are plain SELECTs, written so that Spark and other SQL engines read
them alike; `{name}` stands for a table. `views(...)` binds them to DataFrames,
`with_sql(...)` renders the same text as a WITH clause.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_S, _D, _N, _TS = T.StringType(), T.DateType(), T.DoubleType(), T.TimestampType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SCHEMAS = {
    "cases": _schema(case_id=_S, fir_number=_S, station_id=_S, police_station=_S, district=_S, state=_S, registration_date=_D, incident_date=_D, incident_time=_S, crime_type=_S, crime_category=_S, description=_S, status=_S, location_id=_S),
    "persons": _schema(person_id=_S, name=_S, date_of_birth=_D, gender=_S, address=_S, identifier_hash=_S),
    "case_persons": _schema(case_id=_S, person_id=_S, role=_S, details=_S),
    "vehicles": _schema(vehicle_id=_S, registration_number=_S, vehicle_type=_S, make=_S, model=_S),
    "case_vehicles": _schema(case_id=_S, vehicle_id=_S, role=_S),
    "phones": _schema(phone_id=_S, number=_S, number_hash=_S),
    "case_phones": _schema(case_id=_S, phone_id=_S),
    "person_phones": _schema(person_id=_S, phone_id=_S),
    "locations": _schema(location_id=_S, address=_S, locality=_S, city=_S, district=_S, state=_S, latitude=_N, longitude=_N),
    "evidences": _schema(evidence_id=_S, case_id=_S, evidence_type=_S, description=_S, source=_S, collected_at=_TS, status=_S),
    "investigation_events": _schema(event_id=_S, case_id=_S, event_type=_S, description=_S, event_date=_TS, officer_reference=_S),
    "chargesheets": _schema(case_id=_S, filing_date=_D, status=_S, document_reference=_S, summary=_S),
    "legal_sections": _schema(section_id=_S, code=_S, title=_S, description=_S, law_name=_S),
    "case_legal_sections": _schema(case_id=_S, section_id=_S),
}

#: Closed domains.
ROLES = ("ACCUSED", "SUSPECT", "VICTIM", "WITNESS", "COMPLAINANT", "OTHER")
VEHICLE_ROLES = ("SUSPECT_VEHICLE", "STOLEN_VEHICLE", "RECOVERED_VEHICLE", "VICTIM_VEHICLE", "OTHER")
EVIDENCE_TYPES = ("CCTV", "MOBILE", "DOCUMENT", "VEHICLE", "WEAPON", "DIGITAL", "PHYSICAL", "OTHER")

_FIRST = "rahul amit sunita priya deepak manoj rekha suresh anita vikram kavita arjun meena rohit lata sanjay gita nikhil usha tarun".split()
_PARTS = "ka ro mi sha ten da pra lu bi gar no ve su jit pa ran tho lal min das".split()
_SERIES = "ab ca fx zk".split()


def _id(prefix: str, column: str) -> str:
    return f"'{prefix}' || lpad(CAST({column} AS STRING), 10, '0')"


def _part(number: str, words: list[str]) -> str:
    """The word at a place, counted from 0 and around."""
    return f"(CASE ({number}) % {len(words)} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)) + " END)"


def _div(a: str, b: int) -> str:
    return f"CAST(floor(({a}) / {b}) AS BIGINT)"


#: Three neighbouring customers share a surname, two of them the whole name, so that buckets of names stay small at any size.
_NAME = (
    f"(CASE WHEN c_custkey % 11 = 0 THEN 'Shri ' ELSE '' END) || {_part(_div('c_custkey', 3) + ' * 2 + ' + _div('c_custkey % 3', 2), _FIRST)} || ' ' || "
    f"{_part(_div('c_custkey', 3), _PARTS)} || {_part(_div('c_custkey', 60), _PARTS)} || {_part(_div('c_custkey', 1200), _PARTS)} || {_part(_div('c_custkey', 24000), _PARTS)}"
    " || (CASE WHEN c_custkey % 13 = 0 THEN ' alias Raju' ELSE '' END)"
)
_DOB = f"CAST(1900 + ({_div('c_custkey', 2)} * 7) % 115 AS STRING) || '-' || lpad(CAST(1 + {_div('c_custkey', 2)} % 12 AS STRING), 2, '0') || '-' || lpad(CAST(1 + {_div('c_custkey', 2)} % 28 AS STRING), 2, '0')"
_PLATE = f"'OD' || lpad(CAST({_div('p_partkey', 40)} % 90 AS STRING), 2, '0') || (CASE WHEN p_partkey % 5 = 0 THEN '-' ELSE '' END) || {_part('p_partkey', _SERIES)} || lpad(CAST(({_div('p_partkey', 2)} * 17) % 10000 AS STRING), 4, '0')"
_NUMBER = f"(CASE s_suppkey % 3 WHEN 0 THEN '+91 ' WHEN 1 THEN '0' ELSE '' END) || CAST(9000000000 + {_div('s_suppkey', 2)} * 7919 AS STRING)"

SQL = {
    "cases": f"""SELECT {_id('C', 'o_orderkey')} AS case_id, 'FIR-' || CAST(o_orderkey AS STRING) AS fir_number, 'PS_' || lpad(CAST(n_nationkey AS STRING), 2, '0') AS station_id,
      'Station ' || n_name AS police_station, n_name AS district, r_name AS state, CAST(o_orderdate AS DATE) AS registration_date, CAST((o_orderkey * 7) % 24 AS INT) AS incident_hour,
      o_orderpriority AS crime_type, o_orderstatus AS crime_category, {_id('L', 'n_nationkey')} AS location_id, {_id('P', 'o_custkey')} AS person_id
      FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey""",
    "persons": f"SELECT {_id('P', 'c_custkey')} AS person_id, {_NAME} AS name, {_DOB} AS date_of_birth, n_name AS district, 'Plot ' || CAST({_div('c_custkey', 5)} AS STRING) || ', ' || n_name || ' rd' AS address FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey",
    "case_persons": f"SELECT DISTINCT {_id('C', 'o_orderkey')} AS case_id, {_id('P', 'o_custkey')} AS person_id, (CASE o_orderkey % 6 WHEN 0 THEN 'ACCUSED' WHEN 1 THEN 'SUSPECT' WHEN 2 THEN 'VICTIM' WHEN 3 THEN 'WITNESS' WHEN 4 THEN 'COMPLAINANT' ELSE 'OTHER' END) AS role FROM {{orders}}",
    "vehicles": f"SELECT {_id('V', 'p_partkey')} AS vehicle_id, {_PLATE} AS registration_number, p_type AS vehicle_type, p_brand AS make FROM {{part}}",
    "case_vehicles": f"SELECT DISTINCT {_id('C', 'l_orderkey')} AS case_id, {_id('V', 'l_partkey')} AS vehicle_id FROM {{lineitem}}",
    "phones": f"SELECT {_id('T', 's_suppkey')} AS phone_id, {_NUMBER} AS number FROM {{supplier}}",
    "case_phones": f"SELECT DISTINCT {_id('C', 'l_orderkey')} AS case_id, {_id('T', 'l_suppkey')} AS phone_id FROM {{lineitem}}",
    # One location in five has no coordinates, and one no coordinates and no text either.
    "locations": f"""SELECT {_id('L', 'n_nationkey')} AS location_id, CASE WHEN n_nationkey % 5 <> 1 THEN 'Sq ' || CAST(n_nationkey AS STRING) || ', ' || n_name END AS locality,
      CASE WHEN n_nationkey % 5 <> 1 THEN 'Plot ' || CAST(n_nationkey AS STRING) || ' rd' END AS address, r_name AS district, r_name AS state,
      CASE WHEN n_nationkey % 5 > 1 THEN CAST(20.0 + n_nationkey / 100.0 AS DOUBLE) END AS latitude, CASE WHEN n_nationkey % 5 > 1 THEN CAST(85.0 + n_nationkey / 100.0 AS DOUBLE) END AS longitude
      FROM {{nation}} JOIN {{region}} ON n_regionkey = r_regionkey""",
    "evidences": f"SELECT DISTINCT {_id('C', 'l_orderkey')} AS case_id, (CASE l_returnflag WHEN 'A' THEN 'CCTV' WHEN 'N' THEN 'MOBILE' ELSE 'DOCUMENT' END) AS evidence_type, {_id('C', 'l_orderkey')} || '-' || l_returnflag AS evidence_id FROM {{lineitem}}",
    "case_sections": f"SELECT DISTINCT {_id('C', 'l_orderkey')} AS case_id, (CASE WHEN l_linestatus = 'O' THEN 'BNS ' ELSE 'ipc_' END) || CAST(100 + l_linenumber AS STRING) AS section FROM {{lineitem}}",
    "investigation_events": f"SELECT {_id('E', 'event_id')} AS event_id, {_id('C', 'user_id')} AS case_id, event_type, ts AS event_date, value FROM {{events}}",
    "case_texts": f"SELECT {_id('C', 'doc_id')} AS case_id, CASE WHEN doc_id % 3 = 0 THEN text END AS method, text AS description FROM {{documents}}",
    # As persons, but one name and year of birth holds a third of all.
    "persons_skewed": f"SELECT {_id('P', 'c_custkey')} AS person_id, CASE WHEN c_custkey % 3 = 0 THEN 'Rahul Das' ELSE {_NAME} END AS name, CASE WHEN c_custkey % 3 = 0 THEN '1980-01-01' ELSE {_DOB} END AS date_of_birth FROM {{customer}}",
    "narratives": "SELECT doc_id, text AS description, lang, source AS crime_category FROM {documents}",
}


def views(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named views over the Parquet tables of a folder."""
    out = []
    for name in names:
        used = dict.fromkeys(re.findall(r"\{(\w+)\}", SQL[name]))
        out.append(spark.sql(SQL[name], **{t: spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in used}))
    return out


def with_sql(body: str, *names: str, recursive: bool = False) -> str:
    """`body` behind a WITH clause that holds the named views."""
    parts = [f"{n} AS ({re.sub(r'[{](\w+)[}]', r'main.\1', SQL[n])})" for n in names]
    more = body.lstrip().startswith("+")  # further common tables follow
    return f"WITH {'RECURSIVE ' * recursive}{', '.join(parts)}{', ' if more else ' '}{body.lstrip().removeprefix('+')}"
