import datetime as dt
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from caselink.functions import fuzzy
from caselink.functions import normalize as N


def one(spark, make, *values):
    """The column made of each value."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string")
    return [r["x"] for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_person(spark):
    a, b, c, d, e = one(spark, N.person, "Shri Rahul  Kumar", "Rahul Kumar alias Raju", "R. K. Jena", None, "Mr Dr")
    assert (a["normalized"], a["word_count"], a["has_initials"], a["alias"]) == ("rahul kumar", 2, False, None)
    assert (b["normalized"], b["alias"], b["alias_phonetic"]) == ("rahul kumar", "raju", "R200")
    assert c["has_initials"] and c["tokens"] == ["r", "k", "jena"]
    assert d["normalized"] == "" and d["tokens"] == [] and e["normalized"] == "mr dr"


def test_soundex_runs_break_at_h_and_w(spark):
    assert one(spark, N.soundex, "Ashcraft", "Robert", "", None, "a1b2", "Pfister") == ["A226", "R163", "", None, "A100", "P236"]


@pytest.mark.parametrize("raw", ["9861105000", "+91 98611 05000", "09861105000", "91-9861105000", "0091 9861105000", "(986) 110-5000"])
def test_phone_spellings(spark, raw):
    assert one(spark, N.phone, raw) == [("+919861105000", True)]


def test_phone_invalid(spark):
    assert one(spark, N.phone, "123", None, "") == [("123", False), ("", False), ("", False)]


def test_vehicle(spark):
    good = one(spark, N.vehicle, "OD02AB1234", "od-02-ab-1234", "OD 02 AB 1234", "od02ab1234")
    assert {tuple(v) for v in good} == {("OD02AB1234", True, "OD", "OD02", "AB", "1234")}
    assert one(spark, N.vehicle, "OD02REAL9999")[0][:3] == ("OD02REAL9999", False, None)


def test_places_methods_evidence(spark):
    assert one(spark, N.location, "Janpath Rd, Master Canteen Sq, Bhub") == ["janpath road master canteen square bhubaneswar"]
    assert one(spark, N.method_tokens, "Entered by breaking the lock and stolen cash") == [["enter", "break", "lock", "theft", "cash"]]
    assert one(spark, N.evidence_tokens, "CCTV-footage: cam #3") == [["cctv", "footage", "cam", "3"]]


def test_fold_is_nfkd_ascii(spark):
    rng = random.Random(1)
    texts = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x250), rng.randrange(0x370, 0x2FFF)])) for _ in range(30)) for _ in range(60)]
    keep = [t for t in texts if all(len(unicodedata.normalize("NFKD", c).encode("ascii", "ignore")) <= 1 for c in t)]
    keep += ["café ÉTÉ naïve ß", "plain"]
    assert one(spark, N.fold, *keep) == [unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in keep]


def test_sections(spark):
    assert one(spark, N.section_code, "bns 303", "IPC_379", "BNS 111", "ipc 420", "66D") == ["BNS_303", "IPC_379", "BNS_111", "IPC_420", "66D"]
    df = spark.createDataFrame([("BNS", "BNS 303"), ("BNS", "303")], "l string, c string")
    assert {r[0] for r in df.select(N.section_of(F.col("l"), F.col("c"))).collect()} == {"BNS_303"}


def test_time_and_letters(spark):
    hours = spark.createDataFrame([(h,) for h in (5, 6, 11, 12, 16, 17, 20, 22, None)], "h int").select(N.time_bucket(F.col("h")))
    assert [r[0] for r in hours.collect()] == ["NIGHT", "MORNING", "MORNING", "AFTERNOON", "AFTERNOON", "EVENING", "EVENING", "NIGHT", None]
    n = spark.createDataFrame([(1,), (26,), (27,), (150,), (702,), (703,), (18279,)], "n long").select(N.letters(F.col("n")))
    assert [r[0] for r in n.collect()] == ["A", "Z", "AA", "ET", "ZZ", "AAA", "AAAA"]
    d = spark.createDataFrame([(dt.date(2024, 1, 1),)], "d date").select(N.weekday(F.col("d")))
    assert d.first()[0] == 0


def test_numbers(spark):
    df = spark.range(1).select(
        N.haversine_km(F.lit(20.27), F.lit(85.84), F.lit(20.27), F.lit(85.84)).alias("zero"), N.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("degree"),
        N.valid_point(F.lit(999.0), F.lit(0.0)).alias("bad"), N.valid_point(F.lit(None).cast("double"), F.lit(0.0)).alias("none"), N.bounded(F.lit(1.7)).alias("top"), N.bounded(F.lit(-3.0)).alias("low"),
        N.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))).alias("j"), N.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("j0"),
        N.redact(F.create_map(F.lit("name"), F.lit("x"), F.lit("address"), F.lit("y"))).alias("m"),
    )
    r = df.first()
    assert r["zero"] == 0 and abs(r["degree"] - 111.1949) < 1e-3 and not r["bad"] and not r["none"] and r["top"] == 1 and r["low"] == 0
    assert abs(r["j"] - 1 / 3) < 1e-12 and r["j0"] == 0 and r["m"] == {"name": "x"}


def test_fold_is_nfkd_and_ascii(spark):
    """Ligatures, fractions, units and letters beyond the basic plane, against the definition."""
    texts = ["\ufb01le \U0001d401\U0001d428\U0001d41b", "½ ㎞ №5 ﬀ ĳ", "Éœ ß İ", "…™", "ଓଡ଼ିଶା x", "\U0001f600 ok", "plain", "ﷺ"]
    got = one(spark, N.fold, *texts)
    assert got == [unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in texts] and got[0] == "file Bob"
    assert one(spark, lambda c: N.person(c)["normalized"], texts[0]) == ["file bob"]


def test_time_and_date_inputs(spark):
    got = one(spark, N.clock, "9:05", " 23:59:58 ", "25:00", "noon", None)
    assert [(r["iso"], r["hour"], r["tokens"]) for r in got] == [("09:05:00", 9, ["09:00"]), ("23:59:58", 23, ["23:00"]), ("25:00", None, None), ("noon", None, None), (None, None, None)]
    assert one(spark, N.day, "2024-03-05", None) == ["2024-03-05", None]
    assert one(spark, lambda c: N.shown(c.cast("double")), "0.0002", "0.5", "1", "0", "0.1234") == ["0.0002", "0.5", "1.0", "0.0", "0.1234"]


def test_pair_keys(spark):
    a, b = "6f9619ff-8b86-d011-b42d-00c04fc964ff", "0e984725-c51c-4bf4-9960-e1c80e27aba0"
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(N.strict_pair_key(F.col("a"), F.col("b"))).first()[0] == f"{b}:{a}:RELATED_TO" == df.select(N.pair_key(F.col("b"), F.col("a"))).first()[0]
    for x, y in ((a, a), (a, "nope")):
        with pytest.raises(Exception, match="case"):
            spark.createDataFrame([(x, y)], "a string, b string").select(N.strict_pair_key(F.col("a"), F.col("b"))).collect()


def test_fuzzy():
    assert fuzzy.token_set("rahul kumar", "rahul kumar jena") == 1.0
    assert fuzzy.ratio("abc", "abc") == 1.0 and fuzzy.ratio("abc", "xyz") == 0.0 and fuzzy.ratio("", "") == 1.0
    assert abs(fuzzy.ratio("kitten", "sitting") - 2 * 4 / 13) < 1e-12
    assert fuzzy.partial("abc", "xxabcxx") == 1.0
    assert fuzzy.weighted("", "a") == 0.0 and fuzzy.weighted("amit das", "das amit") == 0.95
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(9))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert fuzzy.lcs(a, b) == table[-1][-1]
