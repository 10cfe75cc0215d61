import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from meshline.plans import accessibility, interruption
from meshline.sources import realtime, wire


def entities(spark, tmp_path):
    found = [
        {"id": "e1", "trip_update": {"trip": {"trip_id": "T1", "route_id": "R", "start_date": "20260104", "schedule_relationship": 3}, "timestamp": 5}},
        {"id": "e2", "trip_update": {"trip": {"trip_id": "T2", "route_id": "R", "start_date": "20260104"}, "timestamp": 6, "stop_time_update": [{"stop_sequence": 2, "stop_id": "PF_B", "schedule_relationship": 1}, {"stop_sequence": 1, "stop_id": "PF_A", "arrival": {"delay": 0}, "departure": {"delay": 950}}]}},
        {"id": "e3", "trip_update": {"trip": {"trip_id": "T3"}, "delay": 299}},
        {"id": "a1", "alert": {"effect": 5, "severity_level": 3, "header_text": [{"language": "es", "text": "hola"}, {"language": "en", "text": "hi"}], "active_period": [{"start": 1767500000, "end": 1767600000}], "informed_entity": [{"route_id": "R"}, {"stop_id": "S", "trip": {"trip_id": "T1"}}]}},
        {"id": "a2", "alert": {"effect": 10}},
    ]
    path = tmp_path / "rt.json"
    path.write_text("\n".join(map(json.dumps, found)))
    return spark.read.schema(realtime.ENTITY).json(str(path)).withColumn("source", F.lit("rail"))


def test_flatten_and_rules(spark, tmp_path, rows):
    e = entities(spark, tmp_path)
    trips, stops = realtime.trip_updates(e)
    assert rows(trips, "feed_entity_id", "schedule_relationship", "delay") == [("e1", "CANCELED", None), ("e2", "SCHEDULED", 950), ("e3", "SCHEDULED", 299)]
    assert rows(stops, "stop_sequence", "schedule_relationship") == [(1, "SCHEDULED"), (2, "SKIPPED")]
    hashed = interruption.dedup_hash(trips, stops)
    raw = "T2|20260104|SCHEDULED|950|1:SCHEDULED:0:950|2:SKIPPED::"
    assert dict(rows(hashed, "feed_entity_id", "dedup_hash"))["e2"] == hashlib.sha256(raw.encode()).hexdigest()[:16]
    assert interruption.unique_updates(hashed.unionAll(hashed.withColumn("feed_entity_id", F.concat("feed_entity_id", F.lit("z"))))).count() == 3
    out = interruption.trip_rules(trips, stops)
    assert rows(out.interruptions, "interruption_id", "label", "severity", "date") == [("int_skip_e2_2", "Skip", "WARNING", "20260104"), ("int_tu_e1", "Cancellation", "SEVERE", "20260104"), ("int_tu_e2", "Delay", "SEVERE", "20260104")]
    assert rows(out.affects_stop) == [("int_skip_e2_2", "PF_B")]
    alerts, selectors = realtime.service_alerts(e)
    assert rows(alerts, "feed_entity_id", "effect", "header_text") == [("a1", "DETOUR", "hi"), ("a2", "NO_EFFECT", None)]
    assert rows(selectors, "selector_group_id") == [("a1_sel_0",), ("a1_sel_1",)]
    alert = interruption.alert_rules(alerts, selectors)
    assert rows(alert.interruptions, "interruption_id", "label", "severity", "date") == [("int_sa_a1", "Detour", "WARNING", "20260103")]
    assert rows(alert.affects_route) == [("int_sa_a1", "R")] and rows(alert.affects_trip) == [("int_sa_a1", "T1")]
    every = interruption.combined(out, alert)
    active = spark.createDataFrame([("WK_R", "20260104"), ("WK", "20260104")], "service_id string, date string")
    services = spark.createDataFrame([("WK_R", "Maintenance"), ("WK", "Weekday")], "service_id string, label string")
    assert len(rows(interruption.during_maintenance(every.interruptions, active, services))) == 3


def test_failed_source_is_left_out(spark, tmp_path, caplog):
    good = lambda: spark.range(2)
    assert realtime.read_all({"a": good, "b": lambda: spark.read.parquet(str(tmp_path / "none"))}).count() == 2
    assert realtime.read_all({"b": lambda: spark.read.parquet(str(tmp_path / "none"))}) is None


def test_binary_messages(spark, tmp_path, rows):
    (tmp_path / "m1.pb").write_bytes(b"x1,x2")
    df = realtime.read_messages(spark, str(tmp_path / "*.pb"), lambda raw: [{"id": t} for t in raw.decode().split(",")], "rail")
    assert rows(df, "id", "source") == [("x1", "rail"), ("x2", "rail")]


def test_outages(spark, tmp_path, rows):
    listed = {"ElevatorIncidents": [
        {"UnitName": "A01N01", "UnitType": "ELEVATOR", "StationCode": "A01", "LocationDescription": "x", "SymptomDescription": "Major Repair", "DateOutOfService": "2024-01-15T00:00:00", "DateUpdated": "2024-01-16T00:00:00", "EstimatedReturnToService": "2024-01-18T23:00:00"},
        {"UnitName": "A01N02", "UnitType": "ESCALATOR", "StationCode": "A01", "SymptomDescription": "Whatever", "DateOutOfService": "UNKNOWN"},
        {"UnitName": "A01N02", "UnitType": "ESCALATOR", "StationCode": "A01", "SymptomDescription": "Whatever", "DateOutOfService": "UNKNOWN"},
    ]}
    path = tmp_path / "incidents.json"
    path.write_text(json.dumps(listed))
    out = accessibility.outages(realtime.incidents(spark, str(path)), F.lit("2024-02-01"))
    assert rows(out, "composite_key", "severity", "projected_duration_days", "status") == [("A01N01|1705276800000|1705363200000", 3, 3, "active"), ("A01N02|0|0", 2, None, "active")]


def key(number, kind):
    return varint(number << 3 | kind)


def varint(value):
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def held(number, raw):
    raw = raw.encode() if isinstance(raw, str) else raw
    return key(number, 2) + varint(len(raw)) + raw


def number(n, value):
    return key(n, 0) + varint(value)


def test_wire_messages(spark, tmp_path):
    trip = held(1, "T1") + held(5, "RED") + held(3, "20240105") + number(4, 3)
    stop = number(1, 4) + held(2, number(1, -30) + number(2, 1704440000)) + held(4, "S9") + number(5, 1)
    update = held(3, held(1, trip) + held(2, stop) + held(2, number(1, 5)) + number(4, 1704441234) + number(5, -60))
    text = held(1, held(1, "Elevator out") + held(2, "en"))
    alert = held(5, held(1, number(1, 7) + number(2, 9)) + held(5, held(2, "RED") + held(4, held(1, "T1"))) + number(6, 9) + number(7, 1) + held(10, text) + number(14, 4))
    position = held(4, held(2, key(1, 5) + struct.pack("<f", 38.5)) + key(99, 1) + bytes(8) + held(7, "S9"))
    feed = held(1, held(1, "2.0")) + held(2, held(1, "e1") + update) + held(2, held(1, "e2") + alert) + held(2, held(1, "e3") + position)
    one, two, three = wire.messages(feed)
    assert one["trip_update"]["delay"] == -60 and one["trip_update"]["stop_time_update"][0]["arrival"]["delay"] == -30
    assert two["alert"]["header_text"] == [{"text": "Elevator out", "language": "en"}] and two["alert"]["active_period"] == [{"start": 7, "end": 9}]
    assert three["vehicle"] == {"position": {"latitude": 38.5}, "stop_id": "S9"}
    (tmp_path / "poll.pb").write_bytes(feed)
    rows = realtime.read_messages(spark, str(tmp_path / "poll.pb"), source="rail").orderBy("id").collect()
    assert [r["id"] for r in rows] == ["e1", "e2", "e3"] and rows[0]["trip_update"]["trip"]["route_id"] == "RED" and rows[0]["source"] == "rail"
    trips, stops = realtime.trip_updates(realtime.read_messages(spark, str(tmp_path / "poll.pb")))
    assert trips.first()["schedule_relationship"] == "CANCELED" and stops.count() == 2
    for at in (len(feed) - 1, len(feed) - 3):
        with pytest.raises((ValueError, IndexError)):
            wire.messages(feed[:at])


def test_source_that_breaks_when_read_is_left_out(spark, tmp_path):
    (tmp_path / "good").mkdir()
    (tmp_path / "bad").mkdir()
    spark.range(3).write.mode("overwrite").parquet(str(tmp_path / "good"))
    (tmp_path / "bad/part-0.parquet").write_bytes(b"PAR1 not a table PAR1")
    schema = "id long"
    found = realtime.read_all({"a": lambda: spark.read.parquet(str(tmp_path / "good")), "b": lambda: spark.read.schema(schema).parquet(str(tmp_path / "bad")), "c": lambda: spark.read.parquet(str(tmp_path / "none"))})
    assert sorted((r["id"], r["source"]) for r in found.collect()) == [(0, "a"), (1, "a"), (2, "a")]
