"""Finding nodes by name, choosing between candidates, matching records in tiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from meshline.functions.columns import segment_key, seq_in_stop, seq_in_unit, with_synonyms
from meshline.operators.graph import top_per_group


def token_index(nodes: DataFrame, text: str) -> DataFrame:
    """(token, id, weight): lower-case words of a text column and the share of a
    node's words that each makes up; the stored form of a full-text index (SRC-16)."""
    words = nodes.select("id", F.explode(F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")).alias("token"))
    n = words.groupBy("id").agg(F.count("*").alias("n"))
    return words.groupBy("id", "token").agg(F.count("*").alias("k")).join(n, "id").select("token", "id", (F.col("k") / F.col("n")).alias("weight"))


def search(index: DataFrame, mentions: DataFrame, degrees: DataFrame, k: int = 5, total: int | None = None) -> DataFrame:
    """(mention, id, score, degree): the k best nodes for each mention (RT-01).

    Each word of a mention matches index tokens that start with it; a rare token
    counts more (inverse document frequency). Candidates are ordered by score,
    then degree, then id; the limit for each mention runs before the shuffle."""
    size = total if total is not None else index.select("id").distinct().count()
    frequency = index.groupBy("token").agg(F.countDistinct("id").alias("df"))
    words = mentions.select("mention", F.explode(F.array_distinct(F.filter(F.split(F.lower("mention"), r"[^\p{L}\p{N}]+"), lambda w: w != ""))).alias("word"))
    # a first letter joins words and tokens, then the prefix is checked
    keyed = index.join(frequency, "token").withColumn("c", F.substring("token", 1, 1))
    hit = words.withColumn("c", F.substring("word", 1, 1)).join(keyed, "c").where(F.col("token").startswith(F.col("word")))
    idf = F.log(F.lit(1.0) + F.lit(float(size)) / F.col("df"))
    scored = hit.groupBy("mention", "word", "id").agg(F.max(F.col("weight") * idf * F.when(F.col("token") == F.col("word"), 1.0).otherwise(0.5)).alias("s")).groupBy("mention", "id").agg(F.sum("s").alias("score"))
    ranked = scored.join(degrees.select("id", "degree"), "id", "left").fillna(0, ["degree"])
    return top_per_group(ranked, ["mention"], [F.desc("score"), F.desc("degree"), F.asc("id")], k)


def search_codes(nodes: DataFrame, mention: str, code: str, name: str, k: int = 5) -> DataFrame:
    """Exact code (score 2) or a name that contains the mention (score 1) (RT-02,
    RT-05); `display` is the code, else the id."""
    low = mention.lower()
    score = F.when(F.lower(F.col(code)) == low, 2).when(F.contains(F.lower(F.col(name)), F.lit(low)), 1)
    return nodes.withColumn("score", score).where("score is not null").withColumn("display", F.coalesce(F.col(code), F.col("id").cast("string"))).orderBy(F.desc("score"), "id").limit(k)


def search_contains(nodes: DataFrame, mention: str, k: int = 5) -> DataFrame:
    """Nodes whose name contains the mention, by id (RT-05)."""
    return nodes.where(F.contains(F.lower("name"), F.lit(mention.lower()))).orderBy("id").limit(k)


def search_pathways(pathways: DataFrame, mention: str, label: str | None = None, k: int = 5, order: Column | None = None) -> DataFrame:
    """Pathways by the start of an id ('NODE_...'), else by unit name and station
    code ('A01N02'): adds `tier` (RT-04). `pathways`: id, label, station_code."""
    upper = mention.upper()
    by_node = upper.startswith("NODE_")
    keep = F.upper("id").startswith(upper) if by_node else (F.col("station_code") == upper[:3]) & F.contains(F.upper("id"), F.lit(upper[3:]))
    if label:
        keep = keep & (F.col("label") == label)
    return pathways.where(keep).withColumn("tier", F.lit("node" if by_node else "unit")).distinct().orderBy(order if order is not None else F.col("id")).limit(k)


def nearest_names(names: DataFrame, mention: str, k: int = 5) -> DataFrame:
    """The k names of the smallest edit distance to a mention (RT-08)."""
    return names.select("name").distinct().withColumn("distance", F.levenshtein(F.lower("name"), F.lit(mention.lower()))).orderBy("distance", "name").limit(k)


def select_top(candidates: DataFrame, group: str, score: str, k: int = 1) -> DataFrame:
    """The k best candidates; k = 1 keeps every candidate of the best score (RT-06)."""
    if k == 1:
        return top_per_group(candidates, [group], [F.desc(score)], 1, ties=True)
    return top_per_group(candidates, [group], [F.desc(score), F.asc("id")], k)


#: How much a relationship between candidates of two anchor types says.
COHERENCE = (
    ("station", "SERVES", "route", 1.0),
    ("station", "BELONGS_TO", "pathway", 1.0),
    ("route", "AFFECTS_ROUTE", "date", 0.8),
)
OTHER_WEIGHT = 0.1


def coherence(candidates: DataFrame, edges: DataFrame, weights: tuple = COHERENCE, other: float = OTHER_WEIGHT) -> DataFrame:
    """The best candidates of each mention by the weighted relationships they
    have with candidates of other types (RT-07, JN-21); string score breaks ties,
    what is still tied stays. `candidates`: mention, type, id, score; `edges`:
    src, dst, type. Each edge counts once; weights hold in either direction."""
    a = candidates.select(F.col("id").alias("src"), F.col("type").alias("ta")).distinct()
    b = candidates.select(F.col("id").alias("dst"), F.col("type").alias("tb")).distinct()
    met = edges.select("src", "dst", F.col("type").alias("rel")).distinct().join(a, "src").join(b, "dst").where("ta <> tb")
    weight = F.lit(other)
    for x, rel, y, w in weights:
        weight = F.when((F.col("rel") == rel) & (((F.col("ta") == x) & (F.col("tb") == y)) | ((F.col("ta") == y) & (F.col("tb") == x))), w).otherwise(weight)
    each = met.withColumn("w", weight)
    sums = each.select(F.col("src").alias("id"), "w").unionAll(each.select(F.col("dst").alias("id"), "w")).groupBy("id").agg(F.sum("w").alias("coherence"))
    scored = candidates.join(sums, "id", "left").fillna(0.0, ["coherence"])
    return top_per_group(scored, ["mention"], [F.desc("coherence"), F.desc("score")], 1, ties=True)


def unique_in_pool(pool: DataFrame, key: str) -> DataFrame:
    """Rows that are alone in their pool (WN-03): counted by aggregation, so a
    large pool is never held."""
    alone = pool.groupBy(key).agg(F.count("*").alias("__n")).where("__n = 1").select(key)
    return pool.join(alone, key, "left_semi")


def tiers(records: DataFrame, key: str, steps: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """(key, tier, match): the first step that answers a record decides. A step
    takes the records still open and returns (key, match) (JN-19, JN-20)."""
    open_, out = records, None
    for name, step in steps:
        found = step(open_).select(key, F.lit(name).alias("tier"), "match")
        out = found if out is None else out.unionAll(found)
        open_ = open_.join(found.select(key), key, "left_anti")
    return out


def match_rate(records: DataFrame, matched: DataFrame, key: str) -> DataFrame:
    """(tier, n, percent) and the unmatched (JN-20)."""
    all_of = records.select(key).distinct().join(matched, key, "left").withColumn("tier", F.coalesce("tier", F.lit("unmatched")))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return all_of.groupBy("tier").agg(F.countDistinct(key).alias("n")).withColumn("percent", F.round(100.0 * F.col("n") / total, 2))


# --- outages to pathways (ETL-18) ------------------------------------------------

MODES = {"ESCALATOR": 4, "ELEVATOR": 5}


def outage_units(outages: DataFrame) -> DataFrame:
    """(outage_id, unit): what the tiers look at of each outage, as an array of
    one struct for each row of that id."""
    kind = F.upper(F.col("unit_type"))
    mode = F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in MODES.items()))
    rows = outages.where((F.length("unit_name") >= 4) & (F.col("station_code") != "")).select(
        "outage_id",
        F.col("station_code").alias("code"),
        mode.alias("mode"),
        seq_in_unit(F.col("unit_name")).alias("seq"),
        F.upper(F.substring("unit_name", 4, 1)).alias("zone"),
        segment_key(F.col("location_description")).alias("key"),
        segment_key(with_synonyms(F.col("location_description"))).alias("wide_key"),
    )
    said = F.struct(*(c for c in rows.columns if c != "outage_id"))
    return rows.where("outage_id is not null").groupBy("outage_id").agg(F.sort_array(F.collect_list(said)).alias("unit"))


def outage_candidates(outages: DataFrame, pathways: DataFrame, stop_names: DataFrame | None = None) -> DataFrame:
    """Every pathway of a unit's mode and station, with what the tiers look at,
    for each distinct `unit` of outage_units(): outages that say the same meet the
    pathways once. The station code is cut out of the stop ids, so this is an
    equi-join."""
    p = pathways
    if stop_names is not None:
        for end in ("from", "to"):
            p = p.join(stop_names.select(F.col("stop_id").alias("__s"), F.col("stop_desc").alias(f"{end}_desc")), F.col(f"{end}_stop_id") == F.col("__s"), "left").drop("__s")
    code_of = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"NODE_([^_]+)_"), F.lit(1))
    p = p.select(
        "pathway_id",
        "mode",
        F.explode(F.array_union(code_of(F.col("from_stop_id")), code_of(F.col("to_stop_id")))).alias("code"),
        F.concat_ws(" ", "from_stop_id", "to_stop_id").alias("ends"),
        F.coalesce(F.col("from_stop_id").endswith("_BT"), F.lit(False)).alias("bottom"),
        seq_in_stop(F.col("from_stop_id")).alias("from_seq"),
        seq_in_stop(F.col("to_stop_id")).alias("to_seq"),
        segment_key(with_synonyms(F.coalesce("from_desc", F.lit("")))).alias("from_key"),
        segment_key(with_synonyms(F.coalesce("to_desc", F.lit("")))).alias("to_key"),
    )
    o = outage_units(outages).select("unit").distinct().select("unit", F.inline("unit"))
    met = o.join(p, ["code", "mode"])
    in_zone = F.contains(F.col("ends"), F.concat(F.lit("_"), F.col("zone"), F.lit("_")))
    zones = met.groupBy("unit").agg(F.max(in_zone).alias("zone_known"))
    either = lambda a, b, v: F.coalesce((F.col(a) == v) | (F.col(b) == v), (F.col(a) == v), (F.col(b) == v), F.lit(False))
    return met.join(zones, "unit").withColumns(
        {
            "by_desc": either("from_key", "to_key", F.col("key")),
            "by_wide": either("from_key", "to_key", F.col("wide_key")) & F.coalesce(F.col("wide_key") != F.col("key"), F.col("wide_key").isNotNull()),
            "in_zone": in_zone | ~F.col("zone_known"),
            "by_seq": either("from_seq", "to_seq", F.col("seq")) & (in_zone | ~F.col("zone_known")),
        }
    )


def resolve_outages(outages: DataFrame, pathways: DataFrame, stop_names: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """(outage_id, tier, match): the pathway of each outage, by the first tier
    that leaves one. `known` (unit_name, unit_type, pathway_id) is asked first.

    F1 description; F2 number, in the zone where it occurs; F3 description and
    number, or the lower end; F4 number and description, lower end, or the
    lowest number; F5 description with synonyms; F6 the only one at the station;
    F7 by description the lowest number, where none matched by number.

    One pass over the candidates counts, for each distinct unit, how many rows
    each tier leaves and what the single or lowest one is; no tier joins again."""
    steps = []
    c = outage_candidates(outages, pathways, stop_names)
    bottom, seq, desc, wide = F.col("bottom"), F.col("by_seq"), F.col("by_desc"), F.col("by_wide") & F.col("in_zone")
    any_seq = F.coalesce((F.col("from_seq") == F.col("seq")) | (F.col("to_seq") == F.col("seq")), F.col("from_seq") == F.col("seq"), F.col("to_seq") == F.col("seq"), F.lit(False))
    pools = {
        "desc": desc, "seq": seq, "desc_seq": desc & any_seq, "desc_bottom": desc & bottom, "seq_desc": seq & desc, "seq_desc_bottom": seq & desc & bottom,
        "seq_bottom": seq & bottom, "wide": wide, "wide_seq": wide & any_seq, "wide_bottom": wide & bottom, "station": F.lit(True),
    }
    order = F.struct(F.coalesce("from_seq", F.lit(1 << 30)).alias("s"), "pathway_id")
    counted = c.groupBy("unit", "key").agg(*(F.count(F.when(p, 1)).alias(f"n_{k}") for k, p in pools.items()), *(F.min(F.when(p, order)).alias(f"m_{k}") for k, p in pools.items()))
    n, m = (lambda k: F.col(f"n_{k}")), (lambda k: F.col(f"m_{k}.pathway_id"))
    has_key = F.col("key").isNotNull()
    cases = [
        ("F1", n("desc") == 1, m("desc")),
        ("F2", n("seq") == 1, m("seq")),
        ("F3", n("desc_seq") == 1, m("desc_seq")),
        ("F3", n("desc_bottom") == 1, m("desc_bottom")),
        ("F4", has_key & (n("seq_desc") == 1), m("seq_desc")),
        ("F4", has_key & (n("seq_desc_bottom") == 1), m("seq_desc_bottom")),
        ("F4", has_key & (n("seq") > 1), F.when(n("seq_bottom") > 0, m("seq_bottom")).otherwise(m("seq"))),
        ("F5", n("wide") == 1, m("wide")),
        ("F5", n("wide_seq") == 1, m("wide_seq")),
        ("F5", n("wide_bottom") == 1, m("wide_bottom")),
        ("F6", n("station") == 1, m("station")),
        ("F7", has_key & (n("seq") == 0) & (n("desc") > 0), F.when(n("desc_bottom") > 0, m("desc_bottom")).otherwise(m("desc"))),
    ]
    chosen = F.coalesce(*(F.when(when, F.struct(F.lit(tier).alias("tier"), value.alias("match"))) for tier, when, value in cases))
    of_unit = counted.select("unit", chosen.alias("c")).where("c is not null")
    decided = outage_units(outages).join(of_unit, "unit").select("outage_id", "c.tier", "c.match")
    if known is not None:
        steps.append(("static", lambda o: o.withColumn("unit_type", F.upper("unit_type")).join(known.withColumn("unit_type", F.upper("unit_type")), ["unit_name", "unit_type"]).select("outage_id", F.col("pathway_id").alias("match"))))
        static = tiers(outages, "outage_id", steps)
        return static.unionByName(decided.join(static.select("outage_id"), "outage_id", "left_anti"))
    return decided
