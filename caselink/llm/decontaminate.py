"""Benchmark decontamination by a prefix-filtered set join (DataFrame operations only).

Items are cut into windows of 10 consecutive words (a shorter item is one
window). A window occurs only where all its words do, so its necessary prefix in
the order of rarity is one token: the rarest by the counts over all documents.
What document words join with is the distinct (token, offset, window length): at
most as many rows a token as there are places in a window, however many windows
it stands for. The position of the word then gives the only place where such a
window could lie, which must be within the document, and the words at that place
are joined with the windows themselves, word for word.

Documents are cut into words once, in a table that all passes read.

Defined cases: null text has no words; a null item_id is written `null`; items
without words have no window. Rows that repeat a doc_id are judged by their own
text. With no benchmark item every document is clean. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, free_names, shuffled

WINDOW = 10
#: Tables made from the windows are broadcast while their words take at most so many bytes; larger ones are joined by shuffle.
BROADCAST_BYTES = 8 << 20

#: What separates words.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(text: Column) -> Column:
    """Words of a whole text once A-Z are lowered; lower() is used where it does the same, for ASCII."""
    body = F.coalesce(text, F.lit(""))
    low = F.when(F.length(body) == F.octet_length(body), F.lower(body)).otherwise(F.translate(body, _UPPER, _LOWER))
    return F.array_remove(F.split(low, BREAKS), "")


def windows(items: DataFrame, size: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """words (array), items (ids as strings): each distinct window once."""
    cutting = F.transform(F.sequence(F.lit(0), F.greatest(F.size("t") - size, F.lit(0))), lambda i: F.slice("t", i + 1, size))
    return (
        items.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), tokens(F.col(text)).alias("t"))
        .where(F.size("t") > 0)
        .select("item", F.explode(cutting).alias("words"))
        .groupBy("words").agg(F.collect_set("item").alias("items"))
    )


def prefixes(cuts: DataFrame, counts: DataFrame) -> DataFrame:
    """token, off, size, distinct: where the rarest word of a window lies in it, and how long the window is."""
    rare = (
        cuts.select("words", F.posexplode("words").alias("off", "token"))
        .join(counts, "token", "left")
        .groupBy("words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("token").alias("token"), F.col("off").alias("off"))).alias("r"))
    )
    return rare.select("r.token", "r.off", F.size("words").alias("size")).distinct()


def row_key(text: Column) -> Column:
    """A digest of a row's id and text: rows that share it are the same document."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit(""))))


def cut_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, h (row_key), t (the words of the whole text) of every row; a written table."""
    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col(text)).alias("h"), tokens(F.col(text)).alias("t")), "dec-words")


def occurrences(rows: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """h, hits of each document of `rows` (from cut_words) in which a window occurs; hits are structs (start, n, items)."""
    cuts = cut(windows(items, size), "dec-windows")
    bytes_ = cuts.agg(F.sum(F.octet_length(F.array_join("words", " ")) + 16 * F.size("items"))).first()[0] or 0
    held = F.broadcast if bytes_ <= BROADCAST_BYTES else shuffled
    vocabulary = cuts.select(F.explode("words").alias("token")).distinct()
    counts = cut(
        rows.select(F.explode("t").alias("token")).join(held(vocabulary), "token").groupBy("token").agg(F.count("*").alias("n")),
        "dec-counts",
    )
    pre = cut(prefixes(cuts, counts), "dec-prefix")
    at = F.col("pos") - F.col("off")
    places = (
        rows.select("h", F.size("t").alias("len"), F.posexplode("t").alias("pos", "token"))
        .join(held(pre), "token")
        .where((at >= 0) & (at + F.col("size") <= F.col("len")))
        .groupBy("h").agg(F.collect_set(F.struct(at.alias("start"), "size")).alias("places"))
    )
    read = F.transform("places", lambda p: F.struct(p["start"].alias("start"), F.slice("t", p["start"] + 1, p["size"]).alias("words")))
    found = (
        rows.select("h", "t").join(places.hint("shuffle_hash"), "h")
        .select("h", F.explode(read).alias("p")).select("h", "p.start", "p.words")
        .join(held(cuts), "words")
    )
    return found.groupBy("h").agg(F.collect_set(F.struct("start", F.size("words").alias("n"), "items")).alias("hits"))


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids for every row of docs."""
    rows = cut_words(docs, text)
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["start"], x["start"] + x["n"] - 1))))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda x: x["items"]))))
    found = cut(occurrences(rows, items, size).select("h", F.size(covered).alias("hit"), ids.alias("ids")), "dec-found")
    return (
        rows.select("doc_id", "h", F.size("t").cast("long").alias("n_words")).join(found, "h", "left")
        .select("doc_id", "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("ids", F.array().cast("array<string>")).alias("item_ids"))
        .select(
            "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
            F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "item_ids",
        )
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW, text: str = "text") -> DataFrame:
    """docs without the rows in which a benchmark window occurs: the id and a digest of the text name a row."""
    (of,) = free_names(docs, "__digest")
    bad = cut(occurrences(cut_words(docs, text), items, size).select(F.col("h").alias(of)), "dec-bad")
    # No hint: the written table's size is known, so Spark broadcasts it below its own bound and shuffles beyond.
    return docs.join(bad, row_key(F.col(text)) == F.col(of), "left_anti")


SQL = r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS t
  FROM documents),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS t
  FROM benchmark),
wins AS (
  SELECT DISTINCT item, least(len(t), 10) AS n, array_to_string(list_slice(t, s + 1, s + 10), ' ') AS w
  FROM items, unnest(range(0, greatest(len(t) - 10, 0) + 1)) u(s) WHERE len(t) > 0),
sizes AS (SELECT DISTINCT n FROM wins),
places AS (
  SELECT doc_id, s, n, array_to_string(list_slice(t, s + 1, s + n), ' ') AS w
  FROM docs, sizes, unnest(range(0, len(t) - n + 1)) u(s)),
hits AS (SELECT doc_id, s, p.n, item FROM places p JOIN wins USING (w, n)),
covered AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM hits, unnest(range(s, s + n)) v(x) GROUP BY doc_id),
named AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS item_list FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(t) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(item_list), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(item_list, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
