import random

from pyspark.sql import functions as F

from caselink.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def test_each_speaker_is_the_assistant_once(spark):
    rows = [(1, 0, "system", "Be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob b", "yo"), (1, 3, None, "who"), (1, 4, "ann", None), (2, 0, "system", "alone"), (None, 1, "eve", "x")]
    got = {(r["conv_id"], r["perspective"], r["turn"]): r for r in chat.rotate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 5 * 2 + 1
    a = got[1, "ann", 1]
    assert a["segment"] == "<|im_start|>assistant\nhi < |im_end|><|im_end|>\n" and a["out_role"] == "assistant" and a["name"] is None
    assert a["segment"][a["mask_start"] : a["mask_end"]] == "hi < |im_end|><|im_end|>" and a["loss_chars"] == 24
    b = got[1, "bob b", 1]
    assert b["segment"].startswith("<|im_start|>user name=ann\n") and b["mask_end"] == b["mask_start"] == 0
    assert got[1, "ann", 2]["name"] == "bob_20b" and got[1, "ann", 3]["name"] == "_unknown"
    assert got[1, "ann", 0]["out_role"] == "system" and got[1, "ann", 0]["loss_chars"] == 0
    assert got[1, "ann", 4]["segment"] == "<|im_start|>assistant\n<|im_end|>\n"
    assert got[None, "eve", 1]["out_role"] == "assistant"


def test_defined_cases(spark):
    rows = [(1, 0, "a", "x"), (1, 0, "a", "x"), (1, 0, "b", "y"), (None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("of", "perspective", "body", "head", "name", "speaker"):
        df = df.withColumn(c, F.lit("clash"))
    got = chat.rotate(df).collect()
    assert len(got) == 3 * 2
    assert chat.rotate(spark.createDataFrame([], SCHEMA)).count() == 0
    plan = chat.rotate(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


def test_names_are_reversible(spark):
    """Against a rule of its own: every byte that is not an ASCII letter, digit or `-` is `_` and its hex digits."""
    speakers = ["李雷", "韩梅", "A B", "A_B", "A+B", "A.B", "a*~b", "%41", "unknown", "_unknown", "", "x" * 50_000, "Été-9"]
    rows = [(1, i, s, "t") for i, s in enumerate(speakers)]
    got = {r["turn"]: r["name"] for r in chat.rotate(spark.createDataFrame([*rows, (1, 99, None, "t")], SCHEMA)).where("out_role = 'user'").collect()}
    want = {i: "".join(chr(b) if chr(b).isascii() and (chr(b).isalnum() or b == 45) else f"_{b:02X}" for b in s.encode()) for i, s in enumerate(speakers)}
    assert got == want | {99: "_unknown"} and len(set(got.values())) == len(speakers) + 1


def test_places_order_the_dialogue(spark):
    """Ties go by speaker and text, nulls first; a long conversation is one dialogue; very long texts are whole."""
    rng = random.Random(3)
    long = "word " * 200_000
    rows = [(7, rng.choice((None, 1, 2, 3)), rng.choice((None, "a", "b")), rng.choice((None, "x", "y", "z" * 9))) for _ in range(300)]
    rows += [(None, 1, "a", long), (8, 2, "b", "second"), (8, 1, "a", "first")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(0) for c in ("place", "at", "first", "__part")})
    got = chat.rotate(df).where("perspective = 'a'").collect()
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or "")
    want = sorted((r for r in rows if r[0] == 7), key=key)
    shown = sorted((r for r in got if r["conv_id"] == 7), key=lambda r: r["place"])
    assert [r["place"] for r in shown] == list(range(1, 301))
    for r, w in zip(shown, want, strict=True):
        assert r["turn"] == w[1] and r["segment"].split("\n", 1)[1] == (w[3] or "") + "<|im_end|>\n"
        assert (r["out_role"] == "assistant") == (w[2] == "a")
    assert [r["segment"] for r in got if r["conv_id"] is None] == [f"<|im_start|>assistant\n{long}<|im_end|>\n"]
    assert sorted((r["place"], r["turn"]) for r in got if r["conv_id"] == 8) == [(1, 1), (2, 2)]
