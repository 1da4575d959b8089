import datetime as dt
import hashlib
import base64

import pytest
from pyspark.sql import functions as F

from aircapture.functions import frame, text
from aircapture.operators import decode as E

GOLDEN = "QNFdlwOAtDgB69p4RpQ55y9xNj/4poGNVsImkBhdaQwEW3k="
MAC = "extra_infos.phyPayload.macPayload"


def decode(spark, *payloads, **options):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, phyPayload string")
    return [r["extra_infos"] for r in E.decode_frames(rows, **options).orderBy("i").collect()]


def test_golden_uplink(spark):
    (x,) = decode(spark, GOLDEN)
    phy = x["phyPayload"]
    assert (phy["length"], phy["mic"], phy["mhdr"]["mType"], phy["mhdr"]["major"]) == (35, "0c045b79", 2, 0)
    mac = phy["macPayload"]
    assert (mac["fPort"], mac["fhdr"]["devAddr"], mac["fhdr"]["fCnt"]) == (1, "03975dd1", 14516)
    assert mac["fhdr"]["fCtrl"].asDict() == {
        "adr": True, "adrAckReq": False, "ack": False, "classB": False, "fPending": None, "fOptsLen": 0,
    }


def test_other_types(spark):
    join, down, confirmed = decode(
        spark,
        "AFR2mJB4VjQSBwAAkHhWNBJpSqd98Ag=",
        "YBKYPgCFJ5cDQAcAAfKHr5E=",
        "gMEP6QYAW7wB2JZAV68cvyB8xNkBo2GskWM=",
    )
    m = join["phyPayload"]["macPayload"]
    assert (m["appEUI"], m["devEUI"], m["devNonce"]) == ("1234567890987654", "1234567890000007", "4a69")
    assert m["fhdr"]["devAddr"] is None
    m = down["phyPayload"]["macPayload"]
    assert down["phyPayload"]["mhdr"]["mType"] == 3
    assert (m["fhdr"]["devAddr"], m["fhdr"]["fCnt"], m["fhdr"]["fCtrl"]["fOptsLen"]) == ("003e9812", 0x9727, 5)
    assert m["fhdr"]["fCtrl"]["classB"] is None and m["fhdr"]["fCtrl"]["fPending"] is False
    # seven header bytes and five of options, then nothing but the code: no port
    raw = base64.b64decode("YBKYPgCFJ5cDQAcAAfKHr5E=")
    assert m["fPort"] == (raw[13] if len(raw) - 4 > 13 else None)
    m = confirmed["phyPayload"]["macPayload"]
    assert confirmed["phyPayload"]["mhdr"]["mType"] == 4
    assert (m["fhdr"]["devAddr"], m["fhdr"]["fCnt"], m["fPort"]) == ("06e90fc1", 0xBC5B, 1)


def test_join_accept_is_not_reversed_and_may_be_short(spark):
    full = base64.b64encode(bytes([0x20]) + bytes(range(1, 17)) + b"mic!").decode()
    short = base64.b64encode(bytes([0x20, 1, 2, 3, 4]) + b"mic!").decode()
    a, b = (x["phyPayload"]["macPayload"] for x in decode(spark, full, short))
    assert (a["appnonce"], a["netid"], a["devaddr"]) == ("010203", "040506", "0708090a")
    assert (b["appnonce"], b["netid"], b["devaddr"]) == ("010203", "04", "")


def test_short_frames(spark):
    empty, tiny, short, missing = decode(spark, "", "AAAA", "y6PLK1UIAAA=", None)
    assert empty["version"] == "1.1" and empty["random"] is None and empty["phyPayload"]["length"] is None
    assert tiny["phyPayload"]["length"] == 3 and tiny["phyPayload"]["mic"] is None
    assert short["phyPayload"]["mhdr"]["mType"] == 6 and short["phyPayload"]["macPayload"]["fhdr"]["devAddr"] is None
    assert missing["version"] is None


def test_content_hash(spark):
    (a,) = decode(spark, GOLDEN)
    (b,) = decode(spark, GOLDEN, exact_hash=True)
    raw = base64.b64decode(GOLDEN)
    assert a["random"] == hashlib.sha256(raw).hexdigest()
    assert b["random"] == hashlib.sha3_256(raw).hexdigest()


# undecodable payloads seen in captures: all 8 to 11 bytes long, message types 2 to 7
BAD = """0qPLK1UIAAA= RxG8GI9aRTfjBRE= xaPLK1UIAAA= fDwIwKjHOQk= 9PYJDKk13gk= pgsBFIHzADA= 0aLBMVUIAAA= yaPLK1UIAAA=
Z0XlcMmcjru8EQ== gQtLKD/q6eklEA== dABzAAVIRUxMTw== wfnUBXAC7Mw= 16LBMVUIAAA= RxH+JGotRaLPBRE= WYt430QIAAA= u6PLK1UIAAA=""".split()


def test_bad_frames(spark):
    rows = [(p,) for p in BAD + BAD[:2] + ["", "AQID", None, "@@@", "AAECAwQFBgc=", GOLDEN]]
    got = {(r["phyPayload"], r["reason"]): r["count"] for r in E.bad_frames(spark.createDataFrame(rows, "phyPayload string")).collect()}
    assert all(got[(p, "short_mac")] == (2 if p in BAD[:2] else 1) for p in BAD)
    assert got[("", "invalid_length")] == got[("AQID", "invalid_length")] == 1
    assert got[(None, "missing_payload")] == got[("@@@", "invalid_base64")] == got[("AAECAwQFBgc=", "join_length")] == 1
    assert len(got) == len(BAD) + 5


def test_incremental_keeps_current_rows(spark, packets):
    rows = packets.limit(200)
    once = E.decode_incremental(rows)
    again = E.decode_incremental(once.withColumn("phyPayload", F.lit(GOLDEN)))
    assert again.select("_id", "extra_infos").exceptAll(once.select("_id", "extra_infos")).where(
        "extra_infos.version is null"
    ).count() == 0
    kept = again.where("txInfo.modulation.type = 'LORA'").select("_id", f"{MAC}.fhdr.devAddr")
    assert kept.exceptAll(once.select("_id", f"{MAC}.fhdr.devAddr")).count() == 0


def test_one_field_does_not_compute_the_others(spark, packets):
    plan = E.decode_frames(packets).select(f"{MAC}.fhdr.devAddr")._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan and "appEUI" not in plan


@pytest.mark.parametrize(
    "written, micro",
    [("2020-10-05T19:08:35Z", 0), ("2020-10-05T19:08:35.262Z", 262000), ("2020-10-05T19:08:35.251262Z", 251262),
     ("2020-10-05T19:08:35.251262999Z", 251262), ("2020-10-05T19:08:35", 0), ("2020-10-05T19:08:35.5", 500000)],
)
def test_parse_time(spark, written, micro):
    df = spark.createDataFrame([(written,)], "s string").select(text.parse_time(F.col("s")).cast("timestamp_ntz"))
    assert df.first()[0] == dt.datetime(2020, 10, 5, 19, 8, 35, micro)


def test_days_and_hash(spark):
    one = spark.range(1).select(
        text.day_name(F.lit(6)), text.day_name(F.lit(7)), text.day_index(F.lit("Sunday")), text.day_index(F.lit("x")),
        text.java_string_hash(F.lit("hello")), text.java_string_hash(F.lit("polygenelubricants")),
        text.java_string_hash(F.lit("")), frame.mtype_name(F.lit(4)),
    ).first()
    assert tuple(one) == ("Sun", None, 6, None, 99162322, -(1 << 31), 0, "Confirmed Uplink")


def test_week_start_over_summer_time(spark):
    t = [("2024-03-31T23:30:00",), ("2024-03-31T21:30:00",), ("2024-10-27T23:30:00",), ("2024-10-27T22:30:00",)]
    df = spark.createDataFrame(t, "s string").select(
        "s", text.week_start(F.to_timestamp("s"), "Europe/Paris").cast("timestamp_ntz").alias("w")
    )
    got = {r["s"]: r["w"].isoformat() for r in df.collect()}
    assert got == {
        "2024-03-31T23:30:00": "2024-03-31T22:00:00",  # Monday in Paris, summer time
        "2024-03-31T21:30:00": "2024-03-24T23:00:00",
        "2024-10-27T23:30:00": "2024-10-27T23:00:00",
        "2024-10-27T22:30:00": "2024-10-20T22:00:00",
    }
