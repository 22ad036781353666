"""Normalization as column expressions: everything stays inside code generation.

A null or blank input gives an empty string (or an empty array), never null,
unless a function says otherwise.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and maps of the normalizers.
TITLES = ("shri", "smt", "mr", "mrs", "ms", "dr", "advocate", "adv", "inspector", "si", "asi", "shree", "miss", "late", "babu", "master")
PLACE_WORDS = {
    "ps": "police station",
    "chhak": "square",
    "chok": "square",
    "sq": "square",
    "sqr": "square",
    "rd": "road",
    "st": "street",
    "bhub": "bhubaneswar",
    "bbsr": "bhubaneswar",
    "ctc": "cuttack",
    "puri": "puri",
    "sbp": "sambalpur",
    "rkl": "rourkela",
    "dist": "district",
    "nr": "near",
}
METHOD_STOP_WORDS = (
    "a", "an", "the", "and", "or", "in", "on", "at", "to", "from", "by", "with", "of", "for", "was", "were", "been", "is", "are", "using", "via", "through",
)
METHOD_WORDS = {
    "entry": "enter",
    "entered": "enter",
    "entering": "enter",
    "broken": "break",
    "breaking": "break",
    "broke": "break",
    "cut": "cutting",
    "cutter": "cutting",
    "stolen": "theft",
    "stealing": "theft",
}
VEHICLE = r"^([A-Z]{2})([0-9]{2})([A-Z]{1,3})([0-9]{4})$"
SENSITIVE_PROPERTIES = ("date_of_birth", "address", "password", "token", "secret", "credential", "binary")


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str, dict[str, str]]:
    """(characters whose compatibility decomposition leaves one ASCII character, those characters, and the rest with what they leave)."""
    one, to, more = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        left = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(left) == 1:
            one.append(chr(code))
            to.append(left)
        elif left:
            more[chr(code)] = left
    return "".join(one), "".join(to), more


def _spelled(body: Column) -> Column:
    """Characters that leave several ASCII characters (ligatures, fractions, units) written out; only texts that hold one are taken apart."""
    more = _folds()[2]
    table = F.from_json(F.lit(json.dumps(more)), "map<string,string>")
    each = F.transform(F.split(body, ""), lambda c: F.when(F.octet_length(c) == 1, c).otherwise(F.coalesce(F.try_element_at(table, c), c)))
    return F.when(body.rlike("[" + "".join(more) + "]"), F.array_join(each, "")).otherwise(body)


def fold(text: Column) -> Column:
    """NFKD and then ASCII only."""
    one, to, _ = _folds()
    body = F.coalesce(text, F.lit(""))
    return F.when(F.length(body) == F.octet_length(body), body).otherwise(F.regexp_replace(F.translate(_spelled(body), one, to), r"[^\x00-\x7F]", ""))


def squeeze(text: Column) -> Column:
    """Lower case, marks to blanks, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\w\s]", " "), r"\s+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def plain_words(text: Column) -> Column:
    """The shared prologue: fold, squeeze, split."""
    return words(squeeze(fold(text)))


def mapped(tokens: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.transform(tokens, lambda w: F.coalesce(F.try_element_at(pairs, w), w))


def soundex(name: Column) -> Column:
    """Four-character phonetic code in which H, W and vowels all end a run of equal digits."""
    letters = F.regexp_replace(F.upper(name), "[^A-Z]", "")
    digits = F.translate(letters, "BFPVCGJKQSXZDTLMNRAEIOUYHW", "11112222222233455600000000")
    runs = F.regexp_replace(digits, r"(\d)\1+", "$1")
    code = F.concat(F.substring(letters, 1, 1), F.regexp_replace(F.substring(runs, 2, 1 << 20), "0", ""))
    return F.when(letters == "", "").otherwise(F.rpad(F.substring(code, 1, 4), 4, "0"))


def person(name: Column) -> Column:
    """struct(normalized, phonetic, tokens, word_count, has_initials, alias, alias_phonetic)."""
    folded = fold(F.trim(F.coalesce(name, F.lit(""))))
    alias = F.lower(F.trim(F.regexp_extract(folded, r"(?i)\balias\b\s+(.*)$", 1)))
    rest = F.when(alias != "", F.regexp_replace(folded, r"(?i)\balias\b\s+.*$", "")).otherwise(folded)
    every = words(squeeze(rest))
    kept = F.filter(every, lambda w: ~w.isin(*TITLES))
    tokens = F.when(F.size(kept) > 0, kept).otherwise(every)
    codes = F.filter(F.transform(tokens, soundex), lambda c: c != "")
    return F.struct(
        F.array_join(tokens, " ").alias("normalized"),
        F.array_join(codes, "-").alias("phonetic"),
        tokens.alias("tokens"),
        F.size(tokens).alias("word_count"),
        F.exists(tokens, lambda w: F.length(w) == 1).alias("has_initials"),
        F.when(alias != "", alias).alias("alias"),
        F.when(alias != "", soundex(alias)).alias("alias_phonetic"),
    )


def phone(raw: Column) -> Column:
    """struct(normalized, is_valid): ten national digits with +91 in front, else the digits as they are."""
    digits = F.regexp_replace(F.coalesce(raw, F.lit("")), r"[^0-9]", "")
    n = F.length(digits)
    national = (
        F.when(n == 10, digits)
        .when((n == 11) & digits.startswith("0"), F.substring(digits, 2, 10))
        .when((n == 12) & digits.startswith("91"), F.substring(digits, 3, 10))
        .when(n > 10, F.right(digits, F.lit(10)))
    )
    return F.struct(F.coalesce(F.concat(F.lit("+91"), national), digits).alias("normalized"), national.isNotNull().alias("is_valid"))


def vehicle(raw: Column) -> Column:
    """struct(normalized, is_valid, state, rto, series, number); parts are null where the registration is not valid."""
    clean = F.regexp_replace(F.upper(F.coalesce(raw, F.lit(""))), "[^A-Z0-9]", "")
    ok = clean.rlike(VEHICLE)
    part = lambda i: F.when(ok, F.regexp_extract(clean, VEHICLE, i))
    return F.struct(clean.alias("normalized"), ok.alias("is_valid"), part(1).alias("state"), F.concat(part(1), part(2)).alias("rto"), part(3).alias("series"), part(4).alias("number"))


def location(raw: Column) -> Column:
    """Normalized place text; abbreviations are written out."""
    return F.array_join(mapped(plain_words(raw), PLACE_WORDS), " ")


def method_tokens(raw: Column) -> Column:
    """Canonical words of a method text; order and repeats are kept."""
    return mapped(F.filter(plain_words(raw), lambda w: ~w.isin(*METHOD_STOP_WORDS)), METHOD_WORDS)


def evidence_tokens(raw: Column) -> Column:
    return plain_words(raw)


def keywords(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: F.length(w) >= 4)


def moment(ts: Column) -> Column:
    """struct(iso, year, month, day, hour, epoch, tokens) of a timestamp."""
    return F.struct(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.year(ts).alias("year"), F.month(ts).alias("month"), F.dayofmonth(ts).alias("day"),
        F.hour(ts).alias("hour"), F.unix_timestamp(ts).alias("epoch"), F.array(F.date_format(ts, "yyyy"), F.date_format(ts, "yyyy-MM")).alias("tokens"),
    )


def day(value: Column) -> Column:
    """ISO text of a date."""
    return F.date_format(value.cast("date"), "yyyy-MM-dd")


def clock(value: Column) -> Column:
    """struct(iso, hour, tokens) of a time of day given as text (`H:MM` or `HH:MM:SS`); other texts are trimmed and have neither hour nor tokens."""
    shape = r"^([01]?[0-9]|2[0-3]):([0-5][0-9])(?::([0-5][0-9]))?$"
    text = F.trim(value)
    part = lambda i: F.lpad(F.coalesce(F.nullif(F.regexp_extract(text, shape, i), F.lit("")), F.lit("0")), 2, "0")
    known = text.rlike(shape)
    hour = F.when(known, part(1))
    return F.struct(F.when(known, F.concat_ws(":", part(1), part(2), part(3))).otherwise(text).alias("iso"), hour.cast("int").alias("hour"), F.when(known, F.array(F.concat(hour, F.lit(":00")))).alias("tokens"))


def time_bucket(hour: Column) -> Column:
    return F.when(hour.between(6, 11), "MORNING").when(hour.between(12, 16), "AFTERNOON").when(hour.between(17, 20), "EVENING").when(hour.between(0, 23), "NIGHT")


def section_code(raw: Column) -> Column:
    """`LAW 303` or `LAW_303` to `LAW_303`; other texts stay as they are."""
    shape = r"^([A-Za-z_]+)[\s_]+(.+)$"
    return F.when(raw.rlike(shape), F.concat(F.upper(F.regexp_extract(raw, shape, 1)), F.lit("_"), F.regexp_extract(raw, shape, 2))).otherwise(raw)


def section_of(law: Column, code: Column) -> Column:
    """Code of a law name and a section that may repeat the law's name."""
    return section_code(F.when(code.rlike(r"^[A-Za-z_]+[\s_]"), code).otherwise(F.concat_ws("_", law, code)))


def weekday(day: Column) -> Column:
    """Monday is 0."""
    return F.weekday(day)


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws(":", F.least(a, b), F.greatest(a, b), F.lit("RELATED_TO"))


def strict_pair_key(a: Column, b: Column) -> Column:
    """As pair_key, but an error for equal or malformed ids (UUIDs)."""
    uuid = r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
    low = lambda c: F.lower(c)
    return (
        F.when(~a.rlike(uuid) | ~b.rlike(uuid), F.raise_error(F.lit("a case id is not a UUID")).cast("string"))
        .when(low(a) == low(b), F.raise_error(F.lit("a case cannot be related to itself")).cast("string"))
        .otherwise(pair_key(low(a), low(b)))
    )


def content_id(prefix: Column, *groups: Column) -> Column:
    """prefix, then `:` and the sorted items of each group joined by `|`; first 12 hex digits of the SHA-256."""
    body = F.concat_ws(":", prefix, *[F.array_join(F.array_sort(g), "|") for g in groups])
    return F.substring(F.sha2(body, 256), 1, 12)


def letters(n: Column, most: int = 8) -> Column:
    """Bijective base 26: 1 is A, 26 is Z, 27 is AA; up to `most` letters."""
    left, out = n.cast("long"), F.lit("")
    for _ in range(most):
        out = F.concat(F.when(left > 0, F.char((65 + F.pmod(left - 1, F.lit(26))).cast("int"))).otherwise(""), out)
        left = F.floor((left - 1) / 26).cast("long")
    return out


def valid_point(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.lit(6371.0) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bounded(score: Column, digits: int = 4) -> Column:
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), digits)


def shown(score: Column) -> Column:
    """A score of four decimals as text, without an exponent: 0.0002, 0.5, 1.0."""
    return F.regexp_replace(F.format_string("%.4f", score), r"(\.[0-9]+?)0+$", "$1")


def said(template: str, **values: Column) -> Column:
    """A text template with its {names} filled by columns; null is written `None`."""
    parts = re.split(r"\{(\w+)\}", template)
    made = [F.coalesce(values[x].cast("string"), F.lit("None")) if i % 2 else F.lit(x) for i, x in enumerate(parts)]
    return F.concat(*made)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets given as arrays; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def redact(properties: Column) -> Column:
    """A property map without the sensitive keys."""
    return F.map_filter(properties, lambda k, v: ~k.isin(*SENSITIVE_PROPERTIES))
