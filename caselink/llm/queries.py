"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from . import ann, chat, decontaminate, licenses, mixing, neardup, pii, quality, tokens, warc
from .shared import load


def op1_quality_classifier(spark, sf_dir):
    return quality.classify(load(spark, sf_dir, "documents"))


def op2_ann_search(spark, sf_dir):
    vectors = load(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op3_near_dedup(spark, sf_dir):
    return neardup.near_duplicates(load(spark, sf_dir, "documents"))


def op4_decontamination(spark, sf_dir):
    found = decontaminate.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.drop("item_ids")


def op5_license_scan(spark, sf_dir):
    return licenses.scan_licenses(load(spark, sf_dir, "documents"))


TOKENIZER = "word_bpe_49k.json"


def op6_token_ids(spark, sf_dir):
    import public_tokenizers

    return tokens.read(tokens.write(load(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)))


def op7_warc(spark, sf_dir):
    archives = warc.write(load(spark, sf_dir, "pages"))
    return warc.read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_chat_rotation(spark, sf_dir):
    return chat.rotate(load(spark, sf_dir, "conversations"))


def op9_mixing(spark, sf_dir):
    return mixing.mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.col("copies"))


def op10_pii_crf(spark, sf_dir):
    return pii.personal_data(load(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_ann_search, op3_near_dedup, op4_decontamination, op5_license_scan, op6_token_ids, op7_warc, op8_chat_rotation, op9_mixing, op10_pii_crf)}
QUERIES["pipeline"] = corpus_pipeline.run
SQL = {"op3_near_dedup": neardup.SQL, "op4_decontamination": decontaminate.SQL, "op7_warc": warc.SQL, "op8_chat_rotation": chat.ROTATE_SQL}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
