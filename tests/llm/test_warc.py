import base64
import hashlib
import random
import zlib

from caselink.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_whole_table_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, f"http://x/{i}", rng.choice(["", "<p>a</p>", "<p>b</p>", f"<p>{i}</p>", "É\U0001f600" * 5])) for i in range(80)] + [(200, None, None), (201, "http://bad url\r\nX: y", "one")]
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read(warc.write(pages(spark, rows), archive_bytes=2000)).collect()}
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(i, last.get(h or "", -1))
    for i, _, h in rows:
        data = (h or "").encode()
        first = last[h or ""]
        assert got[i] == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == first else "revisit", None if i == first else first)
    assert len(got) == len(rows)


def test_least_size(spark):
    rows = [(1, "u", ""), (2, "u", ""), (3, "u", "long enough"), (4, "u", "long enough")]
    got = {r["page_id"]: r["record_type"] for r in warc.read(warc.write(pages(spark, rows), min_bytes=5)).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_null_and_repeated_ids(spark):
    rows = [(None, "u", "x"), (5, "u", "x"), (5, "u", "x"), (None, None, None), (7, "v", "y")]
    got = sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in warc.read(warc.write(pages(spark, rows))).collect())
    assert got == [("5", "response", "None"), ("5", "response", "None"), ("7", "response", "None"), ("None", "response", "None"), ("None", "revisit", "5")]
    assert warc.read(warc.write(pages(spark, []))).count() == 0


def test_a_url_of_any_length_is_read_back(spark):
    long = "data:text/plain," + "x" * 100_000
    rows = [(1, long, "a"), (2, long, "a"), (3, "u", "b")]
    archives = warc.write(pages(spark, rows))
    assert sorted((r["page_id"], r["record_type"]) for r in warc.read(archives).collect()) == [(1, "revisit"), (2, "response"), (3, "response")]
    assert warc.gaps(archives).count() == 0
    plain = zlib.decompress(warc.member(1, long, b"a", None, False), 31)
    (record,) = warc.salvage(plain).records
    assert record.headers["warc-target-uri"] == long and record.payload == b"a"


def archive(n=6):
    members = [warc.member(i, f"http://x/{i}", b"payload %d " % i * 40, None, False) for i in range(n)]
    return members, b"".join(members)


def ids(found):
    return [int(r.headers["warc-record-id"][10:-1]) for r in found.records]


def test_salvage_recovers_what_follows_a_fault():
    members, data = archive()
    edges = [0]
    for m in members:
        edges.append(edges[-1] + len(m))
    whole = warc.salvage(data)
    assert ids(whole) == list(range(6)) and not whole.gaps
    broken = bytearray(data)
    broken[edges[2] + len(members[2]) // 2] ^= 0xFF
    found = warc.salvage(bytes(broken))
    assert ids(found) == [0, 1, 3, 4, 5]
    assert [(a, b) for a, b, _ in found.gaps] == [(edges[2], edges[3])]
    cut = warc.salvage(data[: edges[4] + 10])
    assert ids(cut) == [0, 1, 2, 3] and cut.gaps[0][:2] == (edges[4], edges[4] + 10)
    junk = warc.salvage(b"junk \x1f\x8b\x08 WARC/1.1\r\n no" + data[: edges[1]] + b"\x00" * 9 + data[edges[1] :])
    assert ids(junk) == list(range(6)) and len(junk.gaps) == 2


def test_salvage_of_plain_records_and_bad_digests():
    import zlib

    members, _ = archive(3)
    plain = [zlib.decompress(m, 31) for m in members]
    spoiled = plain[1].replace(b"payload 1 ", b"payload X ", 1)
    found = warc.salvage(plain[0] + spoiled + plain[2])
    assert ids(found) == [0, 2]
    assert found.gaps == [(len(plain[0]), len(plain[0]) + len(spoiled), "payload digest")]
    assert warc.salvage(b"").records == [] and warc.salvage(b"").gaps == []


def test_gap_log(spark):
    members, data = archive(3)
    bad = members[0] + members[1][:-3] + members[2]
    df = spark.createDataFrame([("a.warc.gz", bytearray(bad))], "name string, data binary")
    assert [r["page_id"] for r in warc.read(df).orderBy("page_id").collect()] == [0, 2]
    (gap,) = warc.gaps(df).collect()
    assert (gap["archive"], gap["start"], gap["end"]) == ("a.warc.gz", len(members[0]), len(members[0]) + len(members[1]) - 3)


def test_unreadable_fields_are_gaps():
    """Fields that cannot be read, or say something else than the record, fail it; the records around it stay."""
    good = [zlib.decompress(warc.member(i, f"http://x/{i}", b"payload", None, False), 31) for i in range(3)]
    again = zlib.decompress(warc.member(1, "http://x/1", b"payload", 2, True), 31)
    for old, new in (
        (b"Payload-Length: 7", b"Payload-Length: x"), (b"Payload-Length: 7", b"Payload-Length: 9"), (b"Payload-Length: 7", "Payload-Length: ٧".encode()),
        (b"<urn:page:1>", b"<urn:page:99999999999999999999>"), (b"<urn:page:1>", b"<urn:page:one>"), (b"Content-Length: ", b"Content-Length: -"), (b"Content-Length: ", b"Content-Length: " + b"9" * 40),
    ):
        bad = good[1].replace(old, new)
        assert bad != good[1]
        found = warc.salvage(good[0] + bad + good[2])
        assert ids(found) == [0, 2] and found.gaps[0][:2] == (len(good[0]), len(good[0]) + len(bad))
        assert len(warc._record_rows("a", found)) == 2
    assert ids(warc.salvage(again)) == [1]
    assert not warc.salvage(again.replace(b"<urn:page:2>", b"<urn:page:2x>")).records


def test_long_pages_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    long = "é<p>" * 1_000_000
    df = pages(spark, [(1, "u", long), (2, None, long), (3, "v", None), (None, None, None)])
    for c in ("digest", "size", "sha", "refers_to", "revisit", "pid", "first_id", "n", "name", "data"):
        df = df.withColumn(c, F.lit("clash"))
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read(warc.write(df)).collect()}
    assert got == {1: (len(long.encode()), "revisit", 2), 2: (len(long.encode()), "response", None), 3: (0, "response", None), None: (0, "revisit", 3)}
