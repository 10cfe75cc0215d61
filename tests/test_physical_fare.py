import pytest

from meshline.plans import fare, physical


@pytest.fixture(scope="module")
def stops(feed):
    return feed(
        "stop_id stop_name location_type parent_station zone_id level_id",
        ("STN_A", "Alpha", "1", None, "3", None), ("STN_B", "Beta", "1", "", "10", None), ("PF_A1", "A 1", "0", "STN_A", None, "L2"), ("PF_A2", "A 2", "4", "STN_A", None, "L2"),
        ("ENT_A", "A door", "2", "STN_A", None, "L0"), ("NODE_A_FG_PAID", "gate", "3", "STN_A", "3", "L1"), ("NODE_A_FG_UNPAID", "gate", "3", "STN_A", "3", "L1"), ("NODE_A_MEZ", "mezzanine", "3", "STN_A", None, "L1"), ("1001", "bus", "0", None, None, None),
        ("STRANGE", "odd", "0", None, None, None),
    )


@pytest.fixture(scope="module")
def pathways(feed):
    return feed(
        "pathway_id from_stop_id to_stop_id pathway_mode is_bidirectional",
        ("P1", "ENT_A", "NODE_A_FG_UNPAID", "1", "1"), ("P2", "NODE_A_FG_UNPAID", "NODE_A_FG_PAID", "6", "0"), ("P3", "NODE_A_FG_PAID", "NODE_A_MEZ", "1", "1"), ("P4", "NODE_A_MEZ", "PF_A1", "4", "0"), ("P5", "ENT_A", "PF_A1", "5", "1"), ("P6", "ENT_A", "NODE_A_MEZ", "2", "1"), ("P7", "NODE_A_MEZ", "NODE_A_FG_PAID", "1", "0"),
    )


def test_kinds_and_endpoints(stops, pathways, feed, rows):
    k = physical.stop_kinds(stops)
    assert rows(k.where("is_station"), "id") == [("STN_A",), ("STN_B",)]
    assert rows(k.where("is_platform"), "id") == [("PF_A1",), ("PF_A2",)]
    assert rows(k.where("is_bus_stop"), "id") == [("1001",)]
    found = dict(rows(physical.endpoints(pathways, k)))
    assert found["NODE_A_MEZ"] == "DEFERRED" and found["ENT_A"] == found["NODE_A_FG_PAID"] == "MATCHED"
    physical.require_endpoints(physical.endpoints(pathways, k))
    bad = feed("pathway_id from_stop_id to_stop_id", ("X", "STRANGE", "NOWHERE"))
    assert dict(rows(physical.endpoints(bad, k))) == {"STRANGE": "GAP", "NOWHERE": "MISSING"}
    with pytest.raises(ValueError, match="MISSING"):
        physical.require_endpoints(physical.endpoints(bad, k))


def test_sides(stops, pathways, rows):
    k = physical.stop_kinds(stops)
    side = dict(rows(physical.sides(pathways, k), "pathway_id", "side_category"))
    assert side == {"P1": "pregate_internal", "P2": "cross_faregate", "P3": "postgate_internal", "P4": "postgate_internal", "P5": "mixed_non_gate", "P6": "pregate_internal", "P7": "postgate_internal"}
    old = dict(rows(physical.sides(pathways, k, strict_compatible=True), "pathway_id", "side_category"))
    assert old["P4"] == old["P7"] == "pregate_internal" and old["P6"] == "mixed_non_gate"
    labels = dict(rows(physical.sides(pathways, k), "pathway_id", "labels"))
    assert labels["P5"] == ["Pathway", "Elevator"] and labels["P4"] == ["Pathway", "Escalator", "Paid"] and labels["P6"] == ["Pathway", "Stairs", "Unpaid"]


def test_links_chains_levels(stops, pathways, feed, rows):
    k = physical.stop_kinds(stops)
    link = rows(physical.links(pathways, k).where("pathway_id in ('P1', 'P4')"))
    assert link == [("ENT_A", "P1", "StationEntrance", "from"), ("ENT_A", "P1", "StationEntrance", "to"), ("NODE_A_FG_UNPAID", "P1", "FareGate", "from"), ("NODE_A_FG_UNPAID", "P1", "FareGate", "to"), ("PF_A1", "P4", "Platform", "from")]
    chain = rows(physical.chains(pathways, physical.endpoints(pathways, k)))
    assert ("P3", "P4", "NODE_A_MEZ") in chain and ("P6", "P4", "NODE_A_MEZ") in chain and ("P4", "P3", "NODE_A_MEZ") not in chain
    levels = feed("level_id level_index", ("L0", "0"), ("L1", "-1"), ("L2", "-2"))
    out = physical.level_links(pathways, k, levels)
    on = rows(out["on_level"])
    assert [x for x in on if x[0] == "P5"] == [("P5", "L0"), ("P5", "L1"), ("P5", "L2")] and ("P2", "L1") in on and ("P3", "L1") in on
    assert ("P4", "L1") in rows(out["starting_level"]) and ("P4", "L2") in rows(out["ending_level"]) and ("P6", "L0") in rows(out["starting_level"])
    contains = physical.contains(k)
    assert ("STN_A", "P1") in rows(physical.station_pathways(contains, physical.links(pathways, k)))


def test_fare(feed, spark, rows):
    stops = feed("stop_id zone_id parent_station", ("STN_A", "3", None), ("STN_B", " 3 ", None), ("STN_C", "10", None), ("NODE_A_FG_1", "3", "STN_A"), ("1001", "", None))
    zones, station, gates = fare.zones(stops)
    assert rows(zones) == [("10",), ("3",)] and len(rows(station)) == 3 and rows(gates) == [("NODE_A_FG_1", "3", "STN_A")]
    raw = feed("fare_product_id fare_media_id amount", ("metrorail_one_way_full_fare_225", "card", "2.25"), ("metrorail_one_way_full_fare_675", "card", "6.75"), ("metrobus_one_way_regular_fare", "card", "2.0"), ("metrobus_one_way_regular_fare", "cash", "2.0"), ("unheard", "card", "1"))
    products, accepted = fare.products(raw)
    assert rows(products, "fare_product_id") == [("bus_regular",), ("rail_one_way",)] and len(rows(accepted)) == 3
    assert dict(rows(fare.amounts(raw)))["metrobus_one_way_regular_fare"] == 2.0
    legs = feed(
        "leg_group_id network_id from_area_id to_area_id fare_product_id from_timeframe_group_id",
        ("bus", "metrobus", None, None, "metrobus_one_way_regular_fare", "any"), ("rail", "metrorail", "STN_A", "STN_C", "metrorail_one_way_full_fare_225", "peak"), ("rail", "metrorail", "STN_A", "STN_C", "metrorail_one_way_full_fare_675", "off"),
        ("rail", "metrorail", "STN_A", "STN_B", "metrorail_free_fare_000", "any"), (None, "metrorail", "STN_A", "STN_B", "x", "any"),
    )
    out = fare.leg_rules(legs, stops, raw)
    assert rows(out["leg_rules"], "rule_id") == [("bus__NULL__NULL",), ("rail__STN_A__STN_B",), ("rail__STN_A__STN_C",)]
    assert rows(out["from_area"]) == [("rail__STN_A__STN_B", "3"), ("rail__STN_A__STN_C", "3")] and ("rail__STN_A__STN_C", "10") in rows(out["to_area"])
    applied = {(r, p, a) for r, p, _, a, _ in rows(out["applies_product"])}
    assert applied == {("bus__NULL__NULL", "bus_regular", 2.0), ("rail__STN_A__STN_C", "rail_one_way", 2.25), ("rail__STN_A__STN_C", "rail_one_way", 6.75), ("rail__STN_A__STN_B", "rail_free", 0.0)}
    with pytest.raises(ValueError, match="NOWHERE"):
        fare.leg_rules(feed("leg_group_id network_id from_area_id to_area_id fare_product_id", ("r", "metrorail", "NOWHERE", "STN_A", "x")), stops, raw)
    assert fare.transfer_rules(None, spark).count() == 0
    t = fare.transfer_rules(feed("from_leg_group_id to_leg_group_id fare_product_id", ("bus", "rail", "metrobus_transfer_discount_x"), ("rail", "rail", "")), spark)
    assert rows(t, "rule_id", "fare_product_id") == [("bus__rail__bus_transfer_discount", "bus_transfer_discount"), ("rail__rail__NULL", None)]
