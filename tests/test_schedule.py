import pytest

from meshline.plans import schedule


@pytest.fixture(scope="module")
def tables(feed):
    day = "monday tuesday wednesday thursday friday saturday sunday"
    return {
        "calendar": feed(f"service_id {day} start_date end_date", ("WK_RAIL", *"1111100", "20260101", "20260110"), ("WK_BUS", *"1111100", "20260101", "20260110"), ("SAT", *"0000010", "20260101", "20260110"), ("OLD", *"1111111", "20200101", "20200102")),
        "calendar_dates": feed("service_id date exception_type", ("WK_RAIL", "20260101", "2"), ("WK_R", "20260104", "1"), ("WK_BUS", "20260103", "2"), ("WK_BUS", "20260103", "1")),
        "feed_info": feed("feed_start_date feed_end_date", ("20251214", "20260613")),
        "routes": feed("route_id route_short_name route_type", ("RED", "RD", "1"), ("BLUE", "BL", "1"), ("D80", "D80", "3"), ("X2", "X2", "x")),
        "trips": feed("trip_id route_id service_id shape_id direction_id trip_headsign", ("T1", "RED", "WK_RAIL", "SH1", None, "Glenmont"), ("T2", "RED", "WK_RAIL", "SH1", "0", "Other"), ("T3", "BLUE", "SAT", "SH2", "1", None), ("T4", "D80", "WK_BUS", "SH3", "0", "Union")),
        "stop_times": feed(
            "trip_id stop_id arrival_time departure_time stop_sequence",
            ("T1", "PF_A", "06:00:00", "06:00:30", "1"), ("T1", "PF_B", "06:05:00", "06:05:30", "2"), ("T1", "PF_A", "24:10:00", "24:10:30", "3"), ("T2", "PF_B", "07:00:00", "07:00:30", "1"),
            ("T3", "PF_B", "bad", "08:00:00", "1"), ("T4", "1001", "09:00:00", "09:00:00", "1"), ("T4", "1002", "09:05:00", "09:05:00", "2"),
        ),
        "stops": feed("stop_id parent_station", ("PF_A", "STN_A"), ("PF_B", "STN_B"), ("1001", None), ("1002", None)),
    }


def test_calendar(tables, rows):
    services, active = schedule.calendar(tables["calendar"], tables["calendar_dates"], tables["feed_info"])
    assert dict(rows(services)) == {"WK_RAIL": "Weekday", "WK_BUS": "Weekday", "SAT": "Saturday", "OLD": "Weekday", "WK_R": "Holiday"}
    days = {}
    for s, d, h in rows(active, "service_id", "date", "holiday_name"):
        days.setdefault(s, {})[d] = h
    assert set(days["SAT"]) == {"20260103", "20260110"} and set(days["WK_R"]) == {"20260104"}
    assert set(days["WK_RAIL"]) == {"20260102", "20260105", "20260106", "20260107", "20260108", "20260109"}
    assert days["WK_BUS"]["20260101"] == "New Year's Day" and "20260103" in days["WK_BUS"]  # the last exception decides
    assert "OLD" not in days
    assert ("20260103", "Saturday") in rows(schedule.dates(active))


def test_routes_patterns_and_stops(tables, rows):
    r = schedule.routes(tables["routes"])
    assert dict(rows(r, "route_id", "mode")) == {"RED": "Rail", "BLUE": "Rail", "D80": "Bus", "X2": "Bus"}
    p = schedule.patterns(tables["trips"])
    assert rows(p, "shape_id", "route_id", "headsign", "direction_id") == [("SH1", "RED", "Glenmont", "0"), ("SH2", "BLUE", None, "1"), ("SH3", "D80", "Union", "0")]
    at = {(t, s): (a, m) for t, s, a, m in rows(schedule.scheduled_at(tables["stop_times"], tables["trips"], r), "trip_id", "stop_sequence", "arrival", "mode")}
    assert at["T1", 1] == (21600, "rail") and at["T1", 3] == (87000, "rail") and at["T3", 1] == (None, "rail") and at["T4", 1] == (32400, "bus")
    stops = schedule.pattern_stops(tables["stop_times"], tables["trips"])
    assert ("SH1", "PF_A", 3, True) in rows(stops) and ("SH1", "PF_B", 2, False) in rows(stops)
    assert rows(schedule.pattern_stops(tables["stop_times"], tables["trips"], collapse=True).where("shape_id = 'SH1'"), "stop_id", "stop_sequence") == [("PF_A", 3), ("PF_B", 2)]
    s = schedule.serves(stops, p, tables["stops"])
    assert rows(s) == [("BLUE", "STN_B", "Station"), ("D80", "1001", "BusStop"), ("D80", "1002", "BusStop"), ("RED", "STN_A", "Station"), ("RED", "STN_B", "Station")]
    assert schedule.summary(r, tables["trips"], p).first().asDict() == {"bus_routes": 2, "rail_routes": 2, "trips": 4, "patterns": 3}
