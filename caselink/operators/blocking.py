"""Candidate blocking: rows to (signal, key, id), then one self equi-join.

The join is on (signal, key) with a < b, and each pair comes once with its sorted
signals. Pairs within a bucket grow with its square; `buckets` tells the sizes
beforehand, and `least`/`most` keep only buckets of that many ids, where an
operator is defined so. Null ids are dropped.

`pairs_once` meets ids that carry all their keys, so the bucket of the first key
that two ids share tells the pair and all its signals: no pair is shuffled, and
only the entries are on disk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N


def keys(df: DataFrame, id_column: str, signals: dict[str, Column]) -> DataFrame:
    """signal, key, id; a signal's column may be an array of keys. Null and empty keys are dropped."""
    entries = []
    for name, column in signals.items():
        kind = df.select(column.alias("k")).schema["k"].dataType.typeName()
        each = column if kind == "array" else F.array(column)
        entries.append(F.transform(each, _entry(name)))
    made = df.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("string").alias("id"), F.explode(F.concat(*entries)).alias("e"))
    return made.select("e.signal", "e.key", "id").where("key is not null and key <> ''").distinct()


def _entry(signal: str):
    return lambda key: F.struct(F.lit(signal).alias("signal"), key.cast("string").alias("key"))


def buckets(entries: DataFrame) -> DataFrame:
    """signal, key, ids, pairs: how many pairs each bucket makes."""
    n = F.count("*")
    return entries.groupBy("signal", "key").agg(n.alias("ids"), (n * (n - 1) / 2).cast("long").alias("pairs")).where("ids > 1")


def pairs(entries: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    """id1, id2, signals."""
    if least or most:
        sizes = entries.groupBy("signal", "key").agg(F.count("*").alias("n")).where(F.col("n").between(least or 0, most or 1 << 62))
        entries = entries.join(sizes.select("signal", "key"), ["signal", "key"])
    a, b = entries.alias("a"), entries.alias("b")
    joined = a.join(b, (F.col("a.signal") == F.col("b.signal")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")))
    return joined.groupBy(F.col("a.id").alias("id1"), F.col("b.id").alias("id2")).agg(F.array_sort(F.collect_set("a.signal")).alias("signals"))


def rare_pairs(keyed: DataFrame) -> DataFrame:
    """id1, id2: `pairs` of ids that share a key which two or three have; keyed: id (long), key, each once.

    A bucket of up to three is told by its least, its greatest and the parity of all
    its ids, so keys are counted before they are shuffled and no entry is kept. Ids
    are in the order of their text.
    """
    few = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("z"), F.bit_xor("id").alias("x")).where("n between 2 and 3")
    middle = F.col("x").bitwiseXOR(F.col("a")).bitwiseXOR(F.col("z"))
    pair = lambda x, y: F.when(x.cast("string") < y.cast("string"), F.struct(x.alias("id1"), y.alias("id2"))).otherwise(F.struct(y.alias("id1"), x.alias("id2")))
    a, z = F.col("a"), F.col("z")
    return few.select(F.explode(F.when(F.col("n") == 2, F.array(pair(a, z))).otherwise(F.array(pair(a, z), pair(a, middle), pair(middle, z)))).alias("p")).select("p.id1", "p.id2").distinct()


def _bit(key: str) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(F.col(key)), F.lit(64)).cast("int"))


def carried(entries: DataFrame, signals: Sequence[str], more: DataFrame | None = None) -> DataFrame:
    """signal, key, id, has: the entries, each with the keys of its id by signal as struct `has`, and 64 bits of their hashes as struct `bits`; `more` (id, m) adds a column m, and ids that it lacks are dropped."""
    sets = [F.collect_set(F.when(F.col("signal") == s, F.col("key"))).alias(s) for s in signals]
    bits = [F.coalesce(F.bit_or(F.when(F.col("signal") == s, _bit("key"))), F.lit(0).cast("long")).alias(f"{s}_bits") for s in signals]
    per = entries.groupBy("id").agg(*sets, *bits).select("id", F.struct(*signals).alias("has"), F.struct(*[F.col(f"{s}_bits").alias(s) for s in signals]).alias("bits"))
    kept = ["id", "has", "bits"]
    if more is not None:
        per, kept = per.join(more, "id"), [*kept, "m"]
    each = F.explode(F.concat(*[F.transform(F.col(f"has.{s}"), _entry(s)) for s in signals])).alias("e")
    return per.select(*kept, each).select("e.signal", "e.key", *kept)


def met(rows: DataFrame, signals: Sequence[str]) -> tuple[DataFrame, Column]:
    """(rows a and b of `carried`, once for each pair that shares a key; its sorted signals)."""
    names = sorted(signals)
    # As many parts as Spark shuffles to: few bytes of entries make many pairs, so they are not to be coalesced by size.
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "signal", "key")
    one = lambda s: (F.size(f"a.has.{s}") <= 1) & (F.size(f"b.has.{s}") <= 1)
    both = lambda s: F.col(f"a.bits.{s}").bitwiseAND(F.col(f"b.bits.{s}"))
    apart = lambda side, s: F.bit_count(f"{side}.bits.{s}") == F.size(f"{side}.has.{s}")
    # Where no bit is common, or only that of the key at hand on a side whose keys have a bit each, there is no need to look at the keys.
    same = {s: (both(s) != 0) & (F.coalesce(F.get(f"a.has.{s}", F.lit(0)) == F.get(f"b.has.{s}", F.lit(0)), F.lit(False)) | (~one(s) & F.arrays_overlap(f"a.has.{s}", f"b.has.{s}"))) for s in names}
    own = F.lit(False)
    for i, s in enumerate(names):
        here = (F.col("a.signal") == s) & (one(s) | ((both(s) == _bit("a.key")) & (apart("a", s) | apart("b", s))) | (F.col("a.key") == F.array_min(F.array_intersect(f"a.has.{s}", f"b.has.{s}"))))
        for before in names[:i]:
            here &= ~same[before]
        own |= here
    a, b = rows.alias("a"), rows.alias("b")
    on = (F.col("a.signal") == F.col("b.signal")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id"))
    found = F.concat(*[F.when(same[s], F.array(F.lit(s))).otherwise(F.array().cast("array<string>")) for s in names])
    return a.join(b, on & own), found


def met_rows(rows: DataFrame) -> DataFrame:
    """Rows a and b of `rows` (id, keys, and what they carry), once for each pair of ids that shares a key."""
    dealt = rows.withColumn("key", F.explode("keys")).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    a, b = dealt.alias("a"), dealt.alias("b")
    first = (F.size("a.keys") == 1) | (F.size("b.keys") == 1) | (F.col("a.key") == F.array_min(F.array_intersect("a.keys", "b.keys")))
    return a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & first)


def pairs_once(entries: DataFrame, signals: Sequence[str]) -> DataFrame:
    """id1, id2, signals: as `pairs` of entries of these signals, without a shuffle of pairs."""
    joined, found = met(carried(entries, signals), signals)
    return joined.select(F.col("a.id").alias("id1"), F.col("b.id").alias("id2"), found.alias("signals"))


def classes(entries: DataFrame) -> DataFrame:
    """signal, key, id, first_id, ids: each id with the smallest one of its bucket and the bucket's size.

    What `pairs` says with a row for every pair of a bucket, in one row for every
    id: two ids of a bucket share its first_id. It grows with the ids alone, so it
    is the form for buckets of common names.
    """
    per = entries.groupBy("signal", "key").agg(F.min("id").alias("first_id"), F.count("*").alias("ids")).where("ids > 1")
    return entries.join(per, ["signal", "key"]).select("signal", "key", "id", "first_id", "ids")


PERSON_SIGNALS = ("EXACT_NAME", "PHONETIC_NAME", "SURNAME", "DOB_YEAR")
VEHICLE_SIGNALS = ("NORMALIZED_VEHICLE", "RTO_SERIES")


def person_keys(persons: DataFrame) -> DataFrame:
    p = persons.withColumn("p", N.person(F.col("name")))
    last = F.element_at("p.tokens", -1)
    return keys(
        p,
        "person_id",
        {
            "EXACT_NAME": F.col("p.normalized"),
            "PHONETIC_NAME": F.col("p.phonetic"),
            "SURNAME": F.when((F.size("p.tokens") >= 2) & (F.length(last) >= 3), last),
            "DOB_YEAR": F.nullif(F.regexp_extract(F.col("date_of_birth").cast("string"), r"^(\d{4})", 1), F.lit("")),
        },
    )


def block_persons(persons: DataFrame) -> DataFrame:
    return pairs_once(person_keys(persons), PERSON_SIGNALS)


def block_phones(phones: DataFrame) -> DataFrame:
    n = N.phone(F.col("number"))
    return pairs(keys(phones, "phone_id", {"NORMALIZED_PHONE": F.when(n["is_valid"], n["normalized"])}))


def vehicle_keys(vehicles: DataFrame) -> DataFrame:
    v = vehicles.withColumn("v", N.vehicle(F.col("registration_number")))
    return keys(v, "vehicle_id", {"NORMALIZED_VEHICLE": F.col("v.normalized"), "RTO_SERIES": F.when(F.col("v.is_valid"), F.concat_ws("_", "v.state", "v.rto", "v.series"))})


def block_vehicles(vehicles: DataFrame) -> DataFrame:
    return pairs_once(vehicle_keys(vehicles), VEHICLE_SIGNALS)


def block_locations(locations: DataFrame) -> DataFrame:
    """Rows with neither locality nor address are left out, for DISTRICT as well."""
    text = F.coalesce(F.nullif(F.trim("locality"), F.lit("")), F.col("address") if "address" in locations.columns else F.lit(None).cast("string"))
    rows = locations.withColumn("t", text).where("t is not null and t <> ''")
    return pairs(keys(rows, "location_id", {"NORMALIZED_LOCALITY": N.location(F.col("t")), "DISTRICT": F.lower(F.trim("district"))}))


def method_keys(cases: DataFrame, case_id: str = "case_id", text: str = "description") -> DataFrame:
    return keys(cases, case_id, {"CRIME_CATEGORY": F.lower(F.trim("crime_category")), "MO_KEYWORD_TOKEN": N.keywords(N.method_tokens(F.col(text)))})


def block_methods(cases: DataFrame, case_id: str = "case_id", text: str = "description", most: int = 100) -> DataFrame:
    """Buckets of fewer than 2 or more than `most` ids are left out, which is part of this operator's definition."""
    return pairs(method_keys(cases, case_id, text), 2, most)
