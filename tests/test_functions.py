import datetime as dt

from pyspark.sql import functions as F

from meshline.functions import columns as C


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x"))).first()[0]


def test_amounts(spark):
    assert one(spark, "metrorail_one_way_full_fare_225", C.amount_in_id) == 2.25
    assert one(spark, "metrorail_free_fare_000", C.amount_in_id) == 0.0
    assert one(spark, "x_675", C.amount_in_id) == 6.75
    assert one(spark, "metrobus_one_way_regular_fare", C.amount_in_id) is None


def test_epoch_millis(spark):
    for text in ("2024-01-15T00:00:00", "2024-01-15T00:00:00Z"):
        assert one(spark, text, C.epoch_millis) == 1705276800000
    assert one(spark, "UNKNOWN", C.epoch_millis) is None
    assert one(spark, None, C.epoch_millis) is None


def test_service_time(spark):
    assert one(spark, "06:00:00", C.service_seconds) == 21600
    assert one(spark, "25:10:05", C.service_seconds) == 90605
    assert one(spark, "6:00:00", C.service_seconds) is None
    assert one(spark, "6:00:00", C.service_seconds_loose) == 21600
    assert one(spark, "ab:00:00", C.service_seconds) is None
    assert one(spark, 21600 + 5 * 60, C.clock, "int") == "6:05"


def test_clean(spark):
    assert [one(spark, x, C.clean) for x in ("", " nan ", "None", None, " a ")] == [None, None, None, None, "a"]


def test_segment_key(spark):
    a = one(spark, "Bottom of Escalator Between Street and Mezzanine", C.segment_key)
    assert a == one(spark, "Escalator between mezzanine and  street, to Vienna", C.segment_key) == "mezzanine_street"
    assert one(spark, "no such words", C.segment_key) is None
    assert one(spark, "Between Main Entrance and Platform Level", lambda c: C.segment_key(C.with_synonyms(c))) == "platform_street"


def test_sequence_numbers(spark):
    assert one(spark, "NODE_A08_ESC03_BT", C.seq_in_stop) == 3
    assert one(spark, "NODE_A08_PF", C.seq_in_stop) is None
    assert [one(spark, u, C.seq_in_unit) for u in ("A08N03", "A08N00", "A08", "A08Nxx")] == [3, None, None, None]


def test_holidays():
    days = dict(C.federal_holidays(2024, 2026))
    assert days["20241128"] == "Thanksgiving" and days["20240527"] == "Memorial Day"
    assert days["20260703"] == "Independence Day"  # the fourth is a Saturday


def test_dates(spark):
    today = dt.date(2024, 1, 17)  # a Wednesday
    assert C.resolve_date("last wednesday", today) == "20240110"
    assert C.resolve_date("yesterday", today) == "20240116"
    assert C.resolve_date("2024-02-30", today) is None
    assert one(spark, "20240230", C.date_of) is None
    assert one(spark, 1704067200, C.local_date_key, "long") == "20231231"


def test_classes(spark):
    days = lambda *f: [F.lit(x) for x in f]
    get = lambda sid, *f: spark.range(1).select(C.service_class(F.lit(sid), days(*f))).first()[0]
    assert get("WK", "1", "1", "1", "1", "1", "0", "0") == "Weekday"
    assert get("WK_R", "1", "1", "1", "1", "1", "0", "0") == "Maintenance"
    assert get("S", "0", "0", "0", "0", "0", "1", "0") == "Saturday"
    assert get("S", "0", "0", "0", "0", "0", "0", "1") == "Sunday"
    assert get("H", "0", "0", "0", "0", "0", "0", "0") == "Holiday"
    assert get("M", "1", "0", "0", "0", "0", "1", "0") == "Weekday"


def test_translation_and_delay(spark):
    t = spark.sql("select array(named_struct('language','es','text','hola'), named_struct('language','en','text','hi')) t, array(0, null, 40, 90) d")
    assert t.select(C.translation(F.col("t")), C.largest_delay(F.lit(None).cast("int"), F.col("d"))).first()[:] == ("hi", 90)
    assert t.select(C.largest_delay(F.lit(5), F.col("d"))).first()[0] == 5


def test_search_text(spark):
    assert one(spark, "a+b (c)", C.escape_search) == r"a\+b \(c\)"
    assert one(spark, '```json\n{"a":1}\n```', C.unfence) == '{"a":1}'
