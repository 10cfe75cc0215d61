import json

import pytest

from meshline.operators.graph import Match
from meshline.plans import checks, load, question


@pytest.fixture(scope="module")
def whole_feed(feed):
    day = "monday tuesday wednesday thursday friday saturday sunday"
    return {
        "stops": feed(
            "stop_id stop_name location_type parent_station zone_id level_id",
            ("STN_A", "Alpha", "1", None, "3", None), ("STN_B", "Beta", "1", None, "10", None), ("PF_A", "A 1", "0", "STN_A", None, "L1"), ("PF_B", "B 1", "0", "STN_B", None, "L1"), ("ENT_A", "door", "2", "STN_A", None, "L0"), ("NODE_A_FG_PAID", "gate", "3", "STN_A", "3", "L0"), ("NODE_A_X", "x", "3", "STN_A", None, None), ("1001", "bus", "0", None, None, None),
        ),
        "pathways": feed("pathway_id from_stop_id to_stop_id pathway_mode is_bidirectional", ("P1", "ENT_A", "NODE_A_X", "5", "1"), ("P2", "NODE_A_X", "PF_A", "4", "0")),
        "levels": feed("level_id level_index level_name", ("L0", "0", "Street"), ("L1", "-1", "Platform")),
        "agency": feed("agency_id agency_name", ("1", "Metro")),
        "routes": feed("route_id route_short_name route_type", ("RED", "RD", "1"), ("D80", "D80", "3")),
        "trips": feed("trip_id route_id service_id shape_id direction_id trip_headsign", ("T1", "RED", "WK", "SH1", "0", "Beta"), ("T2", "D80", "WK", "SH2", "0", "Out")),
        "stop_times": feed("trip_id stop_id arrival_time departure_time stop_sequence", ("T1", "PF_A", "06:00:00", "06:00:30", "1"), ("T1", "PF_B", "06:10:00", "06:10:30", "2"), ("T2", "1001", "07:00:00", "07:00:00", "1")),
        "calendar": feed(f"service_id {day} start_date end_date", ("WK", *"1111100", "20260101", "20260110")),
        "feed_info": feed("feed_start_date feed_end_date feed_version", ("20251214", "20260613", "v1")),
        "fare_leg_rules": feed("leg_group_id network_id from_area_id to_area_id fare_product_id", ("rail", "metrorail", "STN_A", "STN_B", "metrorail_one_way_full_fare_225")),
        "fare_media": feed("fare_media_id fare_media_name fare_media_type", ("card", "Card", "2")),
        "fare_products": feed("fare_product_id fare_media_id amount", ("metrorail_one_way_full_fare_225", "card", "2.25")),
    }


def test_layers_load_and_answer_patterns(whole_feed, tmp_path, rows):
    p = load.load_physical(whole_feed, str(tmp_path / "physical"))
    s = load.load_schedule(whole_feed, str(tmp_path / "schedule"))
    f = load.load_fare(whole_feed, str(tmp_path / "fare"))
    assert rows(f["in_zone"]) == [("STN_A", "3"), ("STN_B", "10")] and f["leg_rules"].count() == 1
    g = load.transit_graph(p, s)
    served = Match(g).start("r", "Route", lambda t: t.id == "RED").out("SERVES", "s", "Station").select("s__name")
    assert rows(served) == [("Alpha",), ("Beta",)]
    first = Match(g).start("s", "Station", lambda t: t.name == "Beta").out("CONTAINS", "p", "Platform").inn("SCHEDULED_AT", "t", "Trip").out("OPERATED_ON", "sp", "ServicePattern").out("ACTIVE_ON", "d", "Date")
    assert first.df.count() == 7 and {r["t__id"] for r in first.df.collect()} == {"T1"}


def test_bad_feed_is_stopped(whole_feed, feed, tmp_path):
    bad = {**whole_feed, "trips": whole_feed["trips"].unionAll(whole_feed["trips"])}
    with pytest.raises(ValueError, match="trips: one row for each id"):
        load.load_schedule(bad, str(tmp_path / "x"))
    orphan = {**whole_feed, "stops": whole_feed["stops"].unionAll(feed("stop_id stop_name location_type parent_station zone_id level_id", ("PF_Z", "z", "0", "STN_Z", None, None)))}
    with pytest.raises(ValueError, match="the parent exists"):
        load.load_physical(orphan, str(tmp_path / "y"))


def test_interruption_and_outage_checks(spark):
    t = {
        "trip_updates": spark.createDataFrame([("h", "T"), ("h", None)], "dedup_hash string, trip_id string"),
        "service_alerts": spark.createDataFrame([("a", "NO_EFFECT")], "feed_entity_id string, effect string"),
        "interruptions": spark.createDataFrame([("int_tu_1",), ("other",)], "interruption_id string"),
        "sources": spark.createDataFrame([("int_tu_1",), ("int_tu_9",)], "interruption_id string"),
    }
    r = checks.gate(t, checks.interruption_before(), blocking=False)
    assert sorted(e.split(":")[0] for e in r.errors) == ["sources", "trip updates"] and len(r.warnings) == 3
    o = spark.createDataFrame([(str(i), "active") for i in range(20)], "composite_key string, status string")
    assert checks.match_rate(o, o.limit(19)).infos and checks.match_rate(o, o.limit(18)).warnings
    assert checks.match_rate(o.limit(0), o).warnings == ["no active outage"]


def test_questions(spark):
    spark.createDataFrame([("A", 3), ("B", 5)], "station string, delays int").createOrReplaceTempView("delays_q")
    tries = iter(["drop table delays_q", "select nope from delays_q", "select station, delays from delays_q order by delays desc"])
    out = question.answer(spark, "How many delays at 'Alpha'?", {"delays_q"}, write=lambda q, errors: next(tries))
    assert out.mode == "precision" and out.attempts == 3 and len(out.errors) == 2 and out.rows[0] == {"station": "B", "delays": 5}
    assert question.answer(spark, "what is the weather", set()).mode == "rejected"
    assert question.answer(spark, "explain the delay at 'Alpha'", set(), context=lambda p: f"near {p.anchors['name'][0]}").text == "near Alpha"
    assert question.answer(spark, "explain the delay", {"delays_q"}, write=lambda q, e: "select * from secrets").mode == "degraded"
    assert question.plan_by_rules("shortest way by escalator").path == "query"


def test_model_plans():
    good = "```json\n" + json.dumps({"domain": "accessibility", "path": "subgraph", "uses_graph": True}) + "\n```"
    assert question.parse_plan(good).path == "query"
    calls = iter(["not json", json.dumps({"domain": "nothing"})])
    assert question.plan_with_retry(lambda q: next(calls), "an escalator outage").domain == "accessibility"


def test_agent_loop():
    def choose(q, seen):
        return ("find", {"x": 1}) if not seen else ("gone", {}) if len(seen) == 1 else ("bad", {}) if len(seen) == 2 else f"found {seen[0][1]}"

    text, seen = question.agent({"find": lambda x: x + 1, "bad": lambda: 1 / 0}, choose, "q")
    assert text == "found 2" and seen[1][1] == "no tool gone" and seen[2][1].startswith("failed")
    assert question.agent({}, lambda q, s: ("x", {}), "q", 2)[0].startswith("No answer")
