"""De-identification of texts: secrets, directives, aliases, and the way back.

Aliases are a table (original, alias, kind): distinct values in the order of first
sight, numbered by kind with a distributed rank, lettered A, B, ..., AA. A text is
masked with the aliases of the values that it holds, longest first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import normalize as N
from ..store import cut, ranked

# Patterns of secrets, directives and identifiers, in the order in which they are applied.
SECRETS = r"(?i)(postgresql|postgres|neo4j|neo4j\+s|bolt|amqp|https?)://[^\s'\"]+|(bearer\s+[a-zA-Z0-9._\-]+)|(sk-[a-zA-Z0-9]{20,})|(password\s*=\s*[^\s'\"]+)"
DIRECTIVES = (
    r"(?i)system\s+directive\s*:",
    r"(?i)ignore\s+(all\s+)?previous\s+instructions",
    r"(?i)override\s+system\s+instructions",
    r"(?i)you\s+are\s+now\s+a",
    r"(?i)<\|im_start\|>",
    r"(?i)<\|im_end\|>",
    r"(?i)\[INST\]",
    r"(?i)\[/INST\]",
)
KINDS = {
    "Phone": r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{2,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{3,4}",
    "Email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "Vehicle": r"\b[A-Z]{2}[-.\s]?[0-9]{1,2}[-.\s]?[A-Z]{1,3}[-.\s]?[0-9]{4}\b",
    "ID": r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}\b|\b[A-Z]{5}[0-9]{4}[A-Z]{1}\b",
    "Entity": r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
}
ALIAS = r"(?:Person|Phone|Vehicle|Email|ID|Case|Entity)-[A-Z]+"
SECRET_MARK, DIRECTIVE_MARK = "[REDACTED_SECRET]", "[NEUTRALIZED_DIRECTIVE]"


def redact_secrets(text: Column) -> Column:
    return F.regexp_replace(text, SECRETS, SECRET_MARK)


def neutralize(text: Column) -> Column:
    for pattern in DIRECTIVES:
        text = F.regexp_replace(text, pattern, DIRECTIVE_MARK)
    return text


def prepared(text: Column) -> Column:
    return neutralize(redact_secrets(F.coalesce(text, F.lit(""))))


def found(text: Column, kind: str) -> Column:
    """Values of a kind in a text, in order."""
    return F.regexp_extract_all(text, F.lit(KINDS[kind]), F.lit(0))


def alias_table(values: DataFrame, name: str = "aliases", known: DataFrame | None = None) -> DataFrame:
    """original, alias, kind, number of values (value, kind, position array<long> or long); the first kind seen names a value.

    `known` holds aliases already given: its values are left out and its numbers are continued.
    """
    rows = values.select(F.trim("value").alias("original"), "kind", "position").where("original <> ''")
    first = rows.groupBy("original").agg(F.min(F.struct("position", "kind")).alias("at")).select("original", "at.kind", "at.position")
    start = F.lit(0)
    if known is not None:
        first = first.join(known.select("original"), "original", "left_anti")
    placed = ranked(first, name, "kind", "position", "original")
    lowest = placed.groupBy("kind").agg((F.min("rank") - 1).alias("base"))
    out = placed.join(lowest, "kind")
    if known is not None:
        used = known.groupBy("kind").agg(F.max("number").alias("used"))
        out = out.join(used, "kind", "left")
        start = F.coalesce("used", F.lit(0))
    number = F.col("rank") - F.col("base") + start
    return out.select("original", F.concat(F.col("kind"), F.lit("-"), N.letters(number)).alias("alias"), "kind", number.alias("number"))


def entity_values(cases: DataFrame, **links: DataFrame) -> DataFrame:
    """value, kind, position of the identifiers of cases, in the order of case ids; links: kind=(case_id, value)."""
    out = cases.select(F.col("case_id").alias("value"), F.lit("Case").alias("kind"), F.struct(F.col("case_id").alias("case"), F.lit(0).alias("part"), F.lit("").alias("value")).alias("position"))
    out = out.unionByName(cases.where("fir_number <> ''").select(F.col("fir_number").alias("value"), F.lit("Case").alias("kind"), F.struct(F.col("case_id").alias("case"), F.lit(1).alias("part"), F.lit("").alias("value")).alias("position")))
    for i, (kind, link) in enumerate(links.items()):
        out = out.unionByName(link.select("value", F.lit(kind).alias("kind"), F.struct(F.col("case_id").alias("case"), F.lit(2 + i).alias("part"), F.col("value").alias("value")).alias("position")))
    return out


def entity_aliases(cases: DataFrame, **entities: DataFrame) -> DataFrame:
    """original, alias, kind, shown: case ids, FIR numbers, and entities (kind=(case_id, id, name)) whose id and name share an alias.

    `shown` is what an alias maps back to: the name, where there is one. A name of
    several entities has the alias of the last one registered.
    """
    ids = {kind: e.select("case_id", F.col("id").alias("value")) for kind, e in entities.items()}
    base = cut(alias_table(entity_values(cases, **ids)), "entity-aliases")
    out = base.select("original", "alias", "kind", F.col("original").alias("shown"))
    for kind, e in entities.items():
        last = e.where("name <> ''").groupBy(F.col("id").cast("string").alias("original")).agg(F.max("case_id").alias("case"), F.max_by("name", "case_id").alias("name"))
        named = last.join(base.where(F.col("kind") == kind), "original")
        per = named.groupBy("name").agg(F.max_by("alias", F.struct("case", "original")).alias("alias"))
        out = out.join(named.select("alias", F.col("name").alias("better")), "alias", "left").withColumn("shown", F.coalesce("better", "shown")).drop("better")
        names = per.select(F.col("name").alias("original"), "alias", F.lit(kind).alias("kind"), F.col("name").alias("shown")).join(out.select("original"), "original", "left_anti")
        out = out.select("original", "alias", "kind", "shown").unionByName(names)
    return out


def replaced(text: Column, pairs: Column) -> Column:
    """text with each (original, alias) of pairs replaced, in their order."""
    return F.aggregate(pairs, text, lambda t, p: F.replace(t, p["original"], p["alias"]))


def mask(texts: DataFrame, key: str = "id", text: str = "text", kinds: tuple[str, ...] = tuple(KINDS), known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(key and the masked text, aliases). Each kind is taken from the text as the stages before have left it.

    Secrets and directives first, then the originals of `known` aliases (original,
    alias, kind, number), longest first, then each kind: extract all, number the
    new values behind the known ones, and replace them in the texts that hold
    them; only those values travel, joined by value.
    """
    current = cut(texts.select(F.col(key).alias("id"), prepared(F.col(text)).alias("text")), "mask-text")
    tables: list[DataFrame] = []
    if known is not None:
        known = known.select("original", "alias", "kind", "number")
        tables.append(known)
        per = held_pairs(current, known)
        current = cut(current.join(per, "id", "left").select("id", F.when(F.col("pairs").isNotNull(), replaced(F.col("text"), F.col("pairs"))).otherwise(F.col("text")).alias("text")), "mask-text")
    for kind in kinds:
        hits = current.select("id", F.posexplode(found(F.col("text"), kind)).alias("n", "value")).where(~F.col("value").rlike(ALIAS))
        hits = cut(hits, "mask-hits")
        table = cut(alias_table(hits.select("value", F.lit(kind).alias("kind"), F.struct(F.col("id").cast("string").alias("id"), "n").alias("position")), f"mask-{kind}", known), "mask-aliases")
        tables.append(table)
        longest = F.array_sort(F.collect_list(F.struct((-F.length("value")).alias("l"), F.col("value").alias("original"), "alias")))
        named = table if known is None else table.unionByName(known)
        per = hits.select("id", "value").distinct().join(named, F.trim("value") == F.col("original")).groupBy("id").agg(longest.alias("pairs"))
        joined = current.join(per, "id", "left").select("id", F.when(F.col("pairs").isNotNull(), replaced(F.col("text"), F.col("pairs"))).otherwise(F.col("text")).alias("text"))
        current = cut(joined, "mask-text")
    aliases = tables[0]
    for t in tables[1:]:
        aliases = aliases.unionByName(t)
    return current.select(F.col("id").alias(key), "text"), aliases


def backmap(texts: DataFrame, aliases: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """key, text with known aliases as whole words replaced by their originals; unknown aliases stay."""
    shape = rf"\b{ALIAS}\b"
    held = texts.select(F.col(key).alias("id"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(shape), F.lit(0)))).alias("alias"))
    pairs = F.array_sort(F.collect_list(F.struct((-F.length("alias")).alias("l"), "alias", "original")))
    per = held.join(aliases.select("alias", "original"), "alias").groupBy("id").agg(pairs.alias("pairs"))
    quote = lambda c: F.regexp_replace(c, r"([\\$])", r"\\$1")
    back = F.aggregate("pairs", F.col(text), lambda t, p: F.regexp_replace(t, F.concat(F.lit(r"\b"), p["alias"], F.lit(r"\b")), quote(p["original"])))
    return texts.join(per, texts[key] == per["id"], "left").select(texts[key], F.when(F.col("pairs").isNotNull(), back).otherwise(F.col(text)).alias(text))


def subject_kind(value: Column, kind: Column) -> Column:
    """The prefix of a subject's alias by the words of its type, else by its shape; null for subjects that are masked as texts."""
    low = F.lower(F.coalesce(kind, F.lit("")))
    named = F.when(F.lit(False), F.lit(""))
    for word, prefix in (("person", "Person"), ("vehicle", "Vehicle"), ("phone", "Phone"), ("email", "Email"), ("case", "Case")):
        named = named.when(low.contains(word), prefix)
    return named.when(value.rlike(f"^(?:{KINDS['Entity']})"), "Entity")


def with_subjects(subjects: DataFrame, aliases: DataFrame, value: str = "subject_id", kind: str = "subject_type", name: str = "subjects") -> DataFrame:
    """aliases (original, alias, kind, number), extended by subjects that are not in it and whose kind has a prefix; numbers go on."""
    made = subjects.select(F.col(value).alias("value"), subject_kind(F.col(value), F.col(kind)).alias("kind")).where("kind is not null and trim(value) <> ''").distinct()
    new = alias_table(made.select("value", "kind", F.col("value").alias("position")), name, known=aliases)
    return aliases.select("original", "alias", "kind", "number").unionByName(new)


#: Runs of letters and digits, by which texts and the values they may hold are joined.
RUNS = r"[\p{L}\p{N}]+"


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(RUNS), F.lit(0))


def held_pairs(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """id, pairs: the (original, alias) whose original stands in the text of `texts` (id, text), longest first.

    Rows meet by the longest run of letters and digits of an original; those
    without any (marks only) are left out. Nothing is broadcast, so the number of
    aliases does not matter.
    """
    longest = F.array_max(F.transform(_runs(F.col("original")), lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))["r"]
    keyed = aliases.select("original", "alias", longest.alias("run")).where("run is not null")
    seen = texts.select("id", F.explode(F.array_distinct(_runs(F.col("text")))).alias("run"), "text")
    found = seen.join(keyed, "run").where(F.contains("text", F.col("original")))
    order = F.array_sort(F.collect_set(F.struct((-F.length("original")).alias("l"), "original", "alias")))
    return found.groupBy("id").agg(order.alias("pairs"))


def masked_rows(rows: DataFrame, columns: list[str], aliases: DataFrame, key: str, kinds: tuple[str, ...] = ()) -> DataFrame:
    """rows with secrets and directives marked and every alias original replaced in the columns, longest first; `key` tells rows apart.

    Columns may be strings, arrays, maps and structs of strings in any depth.
    """
    flat = F.concat_ws("\n", *[F.col(c) if rows.schema[c].dataType.typeName() == "string" else F.to_json(c) for c in columns])
    per = held_pairs(rows.select(F.col(key).alias("id"), flat.alias("text")), aliases)
    joined = rows.join(per, rows[key].eqNullSafe(per["id"]), "left").withColumn("pairs", F.coalesce("pairs", F.array().cast(per.schema["pairs"].dataType)))
    out = {c: deep(F.col(c), rows.schema[c].dataType, lambda v: F.when(v.isNotNull(), replaced(prepared(v), F.col("pairs")))) for c in columns}
    return joined.withColumns(out).select(*rows.columns)


def deep(value: Column, kind: T.DataType, f) -> Column:
    """f on every string inside a nested value: elements of arrays, keys and values of maps, fields of structs."""
    if isinstance(kind, T.StringType):
        return f(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: deep(x, kind.elementType, f))
    if isinstance(kind, T.MapType):
        keys, values = deep(F.map_keys(value), T.ArrayType(kind.keyType), f), deep(F.map_values(value), T.ArrayType(kind.valueType), f)
        return F.map_from_arrays(keys, values)
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[deep(value[x.name], x.dataType, f).alias(x.name) for x in kind.fields]))
    return value
