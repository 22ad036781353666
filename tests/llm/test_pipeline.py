import zlib
from pathlib import Path

import numpy as np
import pytest

from .test_decontaminate import brute as brute_leaks
from .test_neardup import brute as brute_copies

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, out = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name.replace(" ", "-"))
        stage(spark, docs, str(DATA)).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs.collect()
        if name != "token ids":
            assert docs.columns == columns
    rows = {k: [(r["doc_id"], r["text"]) for r in v] for k, v in out.items() if k != "token ids"}
    clean = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").collect()}
    assert len(clean - {i for i, _ in rows["quality classifier"]}) <= 1
    copies = brute_copies(rows["quality classifier"])
    assert sorted(i for i, _ in rows["near-duplicates"]) == sorted(i for i, (_, c) in copies.items() if i == c)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    leaks = brute_leaks(rows["near-duplicates"], items)
    assert sorted(i for i, _ in rows["decontamination"]) == sorted(i for i, v in leaks.items() if not v[4])
    mixed = sorted(rows["mixing"])
    assert {i for i, _ in mixed} <= {i for i, _ in rows["decontamination"]} and all(mixed.count(x) <= 2 for x in mixed)
    from tokenizers import Tokenizer

    import public_tokenizers

    t, start = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER)), 0
    for r, (doc_id, text) in zip(sorted(out["token ids"], key=lambda r: r["start"]), mixed, strict=True):
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        assert tuple(r) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_stage_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-duplicates", "decontamination", "mixing", "token ids"]
