"""The deterministic report, and the checks that any report passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from .patterns import blocked
from .privacy import backmap

# Patterns of secrets and raw identifiers, terms, sentences and limits.
SECRETS = (r"(?i)gsk_[A-Za-z0-9_-]{15,}", r"(?i)csk-[A-Za-z0-9_-]{15,}", r"(?i)Bearer\s+[A-Za-z0-9._-]+", r"(?i)postgresql://\S+", r"(?i)neo4j://\S+")
RAW = {
    "RAW_PHONE": r"\b(?:\+91|0)?[6-9]\d{9}\b",
    "RAW_VEHICLE_REG": r"\b[A-Z]{2}[0-9]{2}[A-Z]{1,2}[0-9]{4}\b",
    "RAW_EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "RAW_AADHAAR": r"\b[2-9]\d{3}\s?\d{4}\s?\d{4}\b",
    "RAW_PAN": r"\b[A-Z]{5}[0-9]{4}[A-Z]\b",
}
COERCIVE = ("arrest", "detain", "prosecute", "convict", "charge person", "jail", "punish", "handcuff", "execute warrant")
FOLLOW_UP = "Verify empirical findings and supporting evidence in underlying case files."
MOST_INPUT, MOST_OUTPUT = 500_000, 100_000
HEAD = ("Structured Explanation (", ":", "): ")
EMPTY = ("reasoning_fb:empty", "NO_DATA", 0, "", "No cases match the requested scope.")


def scan(text: Column) -> Column:
    """The first check that a text fails (SECRET, RAW_...), or null."""
    out = F.when(F.lit(False), F.lit(""))
    for p in SECRETS:
        out = out.when(text.rlike(p), "SECRET")
    for name, p in RAW.items():
        out = out.when(text.rlike(p), name)
    return out


def scan_rows(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    return texts.select(key, scan(F.coalesce(F.col(text), F.lit(""))).alias("finding")).withColumn("is_clean", F.col("finding").isNull())


def allowed(text: Column, words: tuple[str, ...]) -> Column:
    """Neither a forbidden nor a coercive term."""
    return ~blocked(text, words=(*words, *COERCIVE))


def within(text: Column, most: int = MOST_OUTPUT) -> Column:
    return F.length(text) <= most


def ground(statements: DataFrame, known: DataFrame) -> DataFrame:
    """Statements (statement_id, cited array) with the citations that are known (id), and whether any is left.

    Citations are joined as rows, so the known ids may be of any number.
    """
    cited = statements.select("statement_id", F.explode("cited").alias("id")).distinct()
    kept = cited.join(known.select("id").distinct(), "id").groupBy("statement_id").agg(F.array_sort(F.collect_list("id")).alias("grounded"))
    out = statements.join(kept, "statement_id", "left").withColumn("grounded", F.coalesce("grounded", F.array().cast("array<string>")))
    return out.withColumn("is_grounded", F.size("grounded") > 0)


def _sentences(explanations: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """One observation sentence per explanation, and why it may not be said (null where it may)."""
    text = F.concat(F.lit(HEAD[0]), "subject_type", F.lit(HEAD[1]), "subject_id", F.lit(HEAD[2]), "observation")
    rows = explanations.select("explanation_id", "subject_type", text.alias("statement"), F.size("case_ids").alias("case_count"), F.size("entity_ids").alias("entity_count"))
    said = F.col("statement")
    return rows.withColumn("refusal", F.when(~within(said, MOST_INPUT), "TOO_LONG").when(~allowed(said, words), "FORBIDDEN_TERM"))


def statements(explanations: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """One observation sentence per explanation; what is left out is in `refused`."""
    return _sentences(explanations, words).where("refusal is null").drop("refusal")


def refused(explanations: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """explanation_id, subject_type, refusal, length of the sentences that `statements` leaves out: too long, or with a forbidden or coercive term."""
    return _sentences(explanations, words).where("refusal is not null").select("explanation_id", "subject_type", "refusal", F.length("statement").cast("long").alias("length"))


def summary(rows: DataFrame, status: str = "FALLBACK_USED") -> DataFrame:
    """The head of the report: id, sentence count by subject type, follow-up."""
    per = rows.groupBy("subject_type").agg(F.count("*").alias("n"))
    total = per.groupBy().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("sentences"), F.array_join(F.array_sort(F.collect_list(F.concat("subject_type", F.lit(":"), F.col("n").cast("string")))), ",").alias("by_subject"))
    return total.select(
        F.concat(F.lit("reasoning_fb:"), N.content_id(F.lit("reasoning_fb"), F.array(F.lit("llm-privacy-boundary-v1"), F.lit(status)))).alias("report_id"), F.lit(status).alias("status"), "sentences", "by_subject", F.lit(FOLLOW_UP).alias("follow_up"),
    )


def empty(spark: SparkSession) -> DataFrame:
    """The head of a report without cases."""
    return spark.createDataFrame([EMPTY], "report_id string, status string, sentences long, by_subject string, follow_up string")


def restored(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Statements with their aliases mapped back (aliases: alias, original)."""
    back = backmap(rows.select("explanation_id", "statement"), aliases, "explanation_id", "statement")
    return rows.drop("statement").join(back, "explanation_id").select(*rows.columns)
