import pytest
from pyspark.sql import functions as F

from meshline.operators import expand as X
from meshline.operators import resolve as R


@pytest.fixture(scope="module")
def pathways(spark):
    p = "NODE_A08_"
    return spark.createDataFrame(
        [
            ("p1", f"{p}N_ESC1_BT", f"{p}N_ESC1_TP", 4, "Escalator between street and mezzanine", ""),
            ("p2", f"{p}N_ESC2_BT", f"{p}N_ESC2_TP", 4, "Escalator between mezzanine and platform", ""),
            ("p3", f"{p}N_ESC3_TP", f"{p}N_ESC3_XX", 4, "Escalator between mezzanine and platform", ""),
            ("p4", f"{p}S_ELE1_BT", f"{p}S_ELE1_TP", 5, "Elevator between street and platform", ""),
            ("p5", "NODE_B01_X_ESC1_BT", "NODE_B01_X_ESC1_TP", 4, "no words", ""),
            ("p6", "NODE_B01_X_ESC1_XX", "NODE_B01_X_ESC1_YY", 4, "no words", ""),
            ("p7", "NODE_C05_W_ESC2_BT", "NODE_C05_W_ESC2_TP", 4, "Escalator between street and mezzanine", ""),
            ("p8", "NODE_C05_W_ESC5_BT", "NODE_C05_W_ESC5_TP", 4, "Escalator between street and mezzanine", ""),
        ],
        "pathway_id string, from_stop_id string, to_stop_id string, mode int, from_desc string, to_desc string",
    )


def test_cascade(spark, pathways, rows):
    o = spark.createDataFrame(
        [
            ("o1", "A08", "A08N09", "ESCALATOR", "Escalator between mezzanine and street"),  # F1
            ("o2", "A08", "A08N02", "ESCALATOR", "somewhere"),  # F2
            ("o3", "A08", "A08N09", "ESCALATOR", "between platform and mezzanine"),  # F3 by the lower end
            ("o4", "B01", "B01X01", "ESCALATOR", "between here and there"),  # F4, lowest number of the lower ends
            ("o5", "A08", "A08N07", "ESCALATOR", "Between Mezzanine Level and Amtrak Station"),  # F5
            ("o6", "A08", "A08Z00", "ELEVATOR", "somewhere"),  # F6
            ("o7", "C05", "C05W09", "ESCALATOR", "between street and mezzanine"),  # F7
            ("o8", "D09", "D09N01", "ESCALATOR", "between street and mezzanine"),
            ("o9", "D09", "D09N02", "escalator", ""),
        ],
        "outage_id string, station_code string, unit_name string, unit_type string, location_description string",
    )
    known = spark.createDataFrame([("D09N02", "ESCALATOR", "p99")], "unit_name string, unit_type string, pathway_id string")
    got = {k: (t, m) for k, t, m in rows(R.resolve_outages(o, pathways, None, known))}
    assert got == {"o1": ("F1", "p1"), "o2": ("F2", "p2"), "o3": ("F3", "p2"), "o4": ("F4", "p5"), "o5": ("F5", "p1"), "o6": ("F6", "p4"), "o7": ("F7", "p7"), "o9": ("static", "p99")}
    rate = dict((t, n) for t, n, _ in rows(R.match_rate(o, R.resolve_outages(o, pathways, None, known), "outage_id")))
    assert rate["unmatched"] == 1 and sum(rate.values()) == 9


def test_equal_outages_meet_the_pathways_once(spark, rows):
    pathways = spark.createDataFrame([(f"p{i}", 5, f"NODE_A01_N_ELV{i % 7 + 1}_BT", "x", "", "") for i in range(30)] + [("q1", 5, "NODE_B02_N_ELV1_BT", "x", "", "")], "pathway_id string, mode int, from_stop_id string, to_stop_id string, from_desc string, to_desc string")
    said = [("A01", "A01N03"), ("B02", "B02N01"), ("B02", "B02N02"), ("Z", "Z00N01")]
    outages = spark.createDataFrame([(f"o{i}", *said[i % 4], "ELEVATOR", "at the platform") for i in range(200)] + [("twice", "B02", "B02N01", "ELEVATOR", "at the platform")] * 2 + [(None, "B02", "B02N01", "ELEVATOR", "x")], "outage_id string, station_code string, unit_name string, unit_type string, location_description string")
    once = R.outage_candidates(outages.where("outage_id in ('o0', 'o1', 'o2', 'o3', 'twice')"), pathways)
    assert R.outage_candidates(outages, pathways).count() == once.count() == 30 + 1 + 1 + 2
    assert rows(R.resolve_outages(outages, pathways)) == sorted([(f"o{i}", "F2", "q1") for i in range(1, 200, 4)] + [(f"o{i}", "F6", "q1") for i in range(2, 200, 4)])


def test_rates_and_strategies_of_many_equal_outages(spark, rows, tmp_path):
    """Twelve units of each of two stations, 40 riders to a unit, 25 lifts to a number of the first station."""
    from meshline.plans.catalogue import QUERIES

    riders = [(1200 * (k % 40) + 12 * 7 * (k // 40 % 2) + k // 80, k // 40 % 2) for k in range(960)]
    lifts = [(12 * k + j, 0) for j in range(12) for k in range(25)] + [(5000 + j, 1) for j in range(3)]
    spark.createDataFrame(riders, "c_custkey long, c_nationkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(lifts, "s_suppkey long, s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    hits = lambda r: sum(n == r[1] and s % 12 == r[0] % 12 for s, n in lifts)
    one, many = sum(hits(r) == 1 for r in riders), sum(hits(r) > 1 for r in riders)
    assert one == 120 and many == 480
    assert rows(QUERIES["jn20_match_rates"](spark, str(tmp_path))) == [("F2", one, 12.5), ("unmatched", 840, 87.5)]
    assert rows(QUERIES["jn20_strategies"](spark, str(tmp_path))) == [("A station", 0, 960, 0), ("B number", one, many, 360), ("F cascade", one, 0, 840)]


def test_search_order(spark, rows):
    nodes = spark.createDataFrame([(1, "Metro Center"), (2, "Metro Metro"), (3, "Union Station"), (4, "Metropolis Center")], "id long, name string")
    index = R.token_index(nodes, "name")
    degrees = spark.createDataFrame([(1, 5), (4, 2)], "id long, degree long")
    out = R.search(index, spark.createDataFrame([("metro center",)], "mention string"), degrees, 3)
    assert [r["id"] for r in out.orderBy(F.desc("score")).collect()][0] == 1
    assert rows(R.search_codes(nodes.withColumn("code", F.lit(None).cast("string")), "UNION", "code", "name"), "id", "display") == [(3, "3")]
    assert R.nearest_names(nodes, "unoin station", 1).first()["name"] == "Union Station"


def test_coherence_beats_score_and_score_breaks_ties(spark, rows):
    c = spark.createDataFrame([("m1", "station", "s1", 9.0), ("m1", "station", "s2", 1.0), ("m2", "route", "r1", 5.0), ("m2", "route", "r2", 4.0), ("m3", "level", "l1", 1.0), ("m3", "level", "l2", 1.0)], "mention string, type string, id string, score double")
    e = spark.createDataFrame([("r1", "s2", "SERVES"), ("s1", "s2", "NEAR")], "src string, dst string, type string")
    best = rows(R.coherence(c, e), "mention", "id", "coherence")
    assert best == [("m1", "s2", 1.0), ("m2", "r1", 1.0), ("m3", "l1", 0.0), ("m3", "l2", 0.0)]


def test_expand_and_budget(spark, rows):
    nodes = spark.createDataFrame([(i, "Station" if i < 3 else "Trip", f"name {i}") for i in range(6)], "id long, label string, text string")
    edges = spark.createDataFrame([(0, 1, "A"), (2, 1, "A"), (2, 3, "B"), (3, 4, "B"), (4, 5, "A")], "src long, dst long, type string")
    start = X.seeds(nodes, [("Station", "text|label", "name 0")])
    sub = X.expand(nodes, edges, start, X.Expansion(hops=3, kinds=("A", "B")))
    assert rows(sub.nodes, "id", "hop") == [(0, 0), (1, 1), (2, 2), (3, 3)] and rows(sub.edges) == [(0, 1, "A"), (2, 1, "A"), (2, 3, "B")]
    assert rows(X.expand(nodes, edges, start, X.Expansion(hops=3, labels=("Station",))).nodes, "id") == [(0,), (1,), (2,)]
    assert rows(X.expand(nodes, edges, start, X.Expansion(hops=3, nodes=2)).nodes, "id") == [(0,), (1,)]
    text = X.serialise(sub, "text", 36)
    assert "name 0" in text and "name 3" not in text and "1 nodes left out" in text
    assert "no context" in X.serialise(X.Subgraph(failed="no anchors"), "text")
    assert rows(X.provenance(sub, edges, ("B",))) == [(2, 3, "B"), (3, 4, "B")]


def test_budget_by_a_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from meshline.operators import expand as X

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["short", "a somewhat longer line of text", "", "ünïcode wörds and 12345 numbers"]
    nodes = spark.createDataFrame([(i, "Trip", 1, t) for i, t in enumerate(texts)], "id int, label string, hop int, name string")
    rows = {r["id"]: r for r in X.within_budget(nodes, "name", 500, 30, tokens=X.token_counter(path)).collect()}
    library = Tokenizer.from_file(path)
    used = 0
    for i, t in enumerate(texts):
        used += len(library.encode(t, add_special_tokens=False).ids)
        assert rows[i]["used"] == used
    assert X.within_budget(nodes, "name", 33, 30, tokens=X.token_counter(path)).count() < 4
