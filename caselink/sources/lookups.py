"""Lookups of the system of record as pushed-down filters and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_key(df: DataFrame, column: str, value) -> DataFrame:
    """Point lookup; equality reaches the Parquet scan."""
    return df.where(F.col(column) == value)


def page(df: DataFrame, key: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page in the order of the key."""
    return df.orderBy(key).offset(offset).limit(limit)


def first_by(df: DataFrame, column: str, value, key: str) -> DataFrame:
    return df.where(F.col(column) == value).orderBy(key).limit(1)


def some_by(df: DataFrame, column: str, value, key: str, limit: int = 50) -> DataFrame:
    return df.where(F.col(column) == value).orderBy(key).limit(limit)


def name_contains(df: DataFrame, column: str, fragment: str, key: str, limit: int = 50) -> DataFrame:
    """Case-insensitive fragment search; `%` and `_` of the fragment stand for themselves."""
    pattern = "".join("\\" + c if c in "%_\\" else c for c in fragment)
    return df.where(F.col(column).ilike(f"%{pattern}%")).orderBy(key).limit(limit)


def timeline(events: DataFrame, case_id: str) -> DataFrame:
    return events.where(F.col("case_id") == case_id).orderBy("event_date", "event_id")


def gather(cases: DataFrame, targets: DataFrame, max_cases: int = 100) -> DataFrame:
    """Cases whose id or FIR number is a target, `max_cases` at most in the order of targets; a target by id goes first.

    Written as two equi-joins, since an OR would plan as a nested loop.
    """
    t = targets.select(F.col("target"), F.col("position"))
    by_id = cases.join(t, cases["case_id"] == t["target"]).withColumn("way", F.lit(0))
    by_fir = cases.join(t, cases["fir_number"] == t["target"]).withColumn("way", F.lit(1))
    both = by_id.unionByName(by_fir)
    first = both.groupBy("case_id").agg(F.min(F.struct("position", "way")).alias("at"))
    return cases.join(first, "case_id").orderBy("at", "case_id").limit(max_cases).drop("at")


def with_children(cases: DataFrame, **children: DataFrame) -> DataFrame:
    """Each case with its children as sorted arrays of structs, one left join each; cases without children get empty arrays."""
    out = cases
    for name, child in children.items():
        cols = [c for c in child.columns if c != "case_id"]
        kind = child.select(F.array(F.struct(*cols)).alias("a")).schema["a"].dataType
        packed = child.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
        out = out.join(packed, "case_id", "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out


def filtered(cases: DataFrame, stations: list[str] | None = None, start=None, end=None, where: Column | None = None) -> DataFrame:
    """The scope of a request: stations and registration dates, both inclusive."""
    if stations:
        cases = cases.where(F.col("station_id").isin(stations))
    if start is not None:
        cases = cases.where(F.col("registration_date") >= F.lit(start))
    if end is not None:
        cases = cases.where(F.col("registration_date") <= F.lit(end))
    return cases if where is None else cases.where(where)


def tagged_out(nodes: DataFrame, dataset: Column | None = None, labels: list[str] | None = None) -> DataFrame:
    """Nodes without those of a tagged subset."""
    gone = F.lit(False)
    if dataset is not None:
        gone = gone | F.coalesce(dataset, F.lit(False))
    if labels:
        gone = gone | F.col("label").isin(labels)
    return nodes.where(~gone)


def upsert(table: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """table with rows inserted, or put in the place of those with the same key; written with a table swap."""
    return table.join(rows.select(*key).distinct(), list(key), "left_anti").unionByName(rows.select(*table.columns))


def remove(table: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    return table.join(rows.select(*key).distinct(), list(key), "left_anti")


def tag(nodes: DataFrame, ids: DataFrame, **props: str) -> DataFrame:
    """nodes with properties set on those of ids (node_id)."""
    more = F.create_map(*[F.lit(x) for kv in props.items() for x in kv])
    hit = ids.select("node_id").distinct().withColumn("hit", F.lit(True))
    keep = F.map_filter("props", lambda k, v: ~k.isin(*props))
    return nodes.join(hit, "node_id", "left").withColumn("props", F.when(F.col("hit"), F.map_concat(keep, more)).otherwise(F.col("props"))).select(*nodes.columns)
