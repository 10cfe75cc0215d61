import json
import os
import shutil
import zipfile

import pytest
from pyspark.sql import functions as F

from meshline import session
from meshline.operators import upsert as U
from meshline.operators.validate import Check, guard_sql, run_checks, targets_exist
from meshline.sources import feeds, sinks
from meshline.streaming import poll


def test_upserts(spark, rows):
    state = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, v int, w string")
    batch = spark.createDataFrame([("b", 5, 1), ("b", 7, 2), ("c", 9, 3)], "id string, v int, at int")
    assert rows(U.upsert_nodes(state, batch, ["id"], "at")) == [("a", 1, "x"), ("b", 7, "y"), ("c", 9, None)]
    n = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    e = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("a", "zz")], "src string, dst string")
    assert rows(U.merge_edges(e, n("a"), n("x"))) == [("a", "x")]


def test_polls(spark, tmp_path, rows):
    base = "composite_key string, status string, date_out_of_service long, first_seen_poll timestamp, last_seen_poll timestamp, resolved_at timestamp, actual_duration_days long"
    path = str(tmp_path / "state")
    spark.createDataFrame([], base).write.parquet(path)
    inbox = tmp_path / "polls"
    inbox.mkdir()
    schema = "composite_key string, status string, date_out_of_service long, poll_timestamp timestamp"
    day = 86_400_000
    polls = [[("k1", "active", 0), ("k2", "active", 0)], [("k2", "active", 0), ("k3", "active", day)], [("k3", "active", day)]]
    for i, p in enumerate(polls):
        (inbox / f"{i}.json").write_text("\n".join(json.dumps({"composite_key": k, "status": s, "date_out_of_service": d, "poll_timestamp": f"1970-01-0{i + 3}T12:00:00Z"}) for k, s, d in p))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(inbox))
        poll.run_until_empty(poll.keep_state(stream, path), str(tmp_path / "checkpoint"))
    state = spark.read.parquet(path)
    assert rows(state, "composite_key", "status", "actual_duration_days") == [("k1", "resolved", 3), ("k2", "resolved", 4), ("k3", "active", None)]
    assert [r["d"] for r in state.orderBy("composite_key").select(F.date_format("first_seen_poll", "dd").alias("d")).collect()] == ["03", "03", "04"]


def test_stream_dedup(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    for i in range(2):
        (inbox / f"{i}.json").write_text("\n".join(json.dumps({"h": f"h{k}", "t": "2026-01-01T00:00:00Z"}) for k in range(i, i + 3)))
    stream = spark.readStream.schema("h string, t timestamp").option("maxFilesPerTrigger", 1).json(str(inbox))
    poll.run_until_empty(poll.new_content(stream, "h", "t").writeStream.format("parquet").option("path", out), str(tmp_path / "c"))
    assert sorted(r["h"] for r in spark.read.parquet(out).collect()) == ["h0", "h1", "h2", "h3"]


def test_checks(spark):
    t = {"stops": spark.createDataFrame([("a", None), ("a", "p")], "id string, parent string"), "empty": spark.createDataFrame([], "id string")}
    result, table = run_checks(t, [Check("unique", "stops", unique=("id",)), Check("parent", "stops", F.col("parent").isNull(), level="warning"), Check("orphan", "stops", refers=("parent", "stops", "id")), Check("rows", "empty", non_empty=True), Check("gone", "none", non_empty=True), Check("few", "stops", F.col("parent").isNull(), most=1)])
    assert sorted(e.split(":")[0] for e in result.errors) == ["gone", "orphan", "rows", "unique"] and result.warnings == ["parent: 1"]
    assert table.count() == 5 and not result.ok
    with pytest.raises(ValueError):
        result.raise_if_failed()
    assert targets_exist(t, ["stops", "empty", "none"]) == ["empty", "none"]


def test_guard(spark):
    spark.createDataFrame([(1, "x")], "id int, name string").createOrReplaceTempView("allowed")
    spark.createDataFrame([(1,)], "id int").createOrReplaceTempView("secret")
    ok = lambda q, **k: guard_sql(spark, q, {"allowed"}, **k).ok
    assert ok("select id, count(*) from allowed group by id")
    assert ok("with a as (select * from allowed) select * from a", functions=set())
    assert not ok("drop table allowed") and not ok("select * from secret") and not ok("select 1; select 2") and not ok("select nope from allowed")
    assert not ok("select reflect('java.lang.System', 'exit', '0') from allowed", functions={"count"})
    assert not ok("select name from allowed", columns={"id"}) and ok("select id from allowed", columns={"id"})


def test_feeds(spark, tmp_path, rows):
    folder = tmp_path / "feed"
    archive = tmp_path / "feed.zip"
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("agency.txt", "agency_id , agency_name\n001,Metro\n")
    feeds.unpack(str(archive), str(folder))
    found = feeds.read_feed(spark, str(folder))
    assert list(found) == ["agency"] and rows(found["agency"], "agency_id", "agency_name") == [("001", "Metro")]
    with pytest.raises(KeyError, match="fare_products"):
        feeds.tables_of(found, "fare")
    (folder / "new.txt").write_text("x")
    feeds.unpack(str(archive), str(folder))  # not unpacked again
    assert (folder / "new.txt").exists()
    calls = []

    def opener(url):
        calls.append(url)
        return open(archive, "rb")

    target = str(tmp_path / "copy.zip")
    for force in (False, False, True):
        feeds.download("http://x", target, force, opener=opener)
    assert len(calls) == 2


def test_statements_and_replace(spark, tmp_path):
    assert sinks.statements("// ── first ──\nMATCH a;\n// ── second\nMATCH b\n") == {"first": "MATCH a", "second": "MATCH b"}
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    sinks.replace(spark, spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2


def test_cut_off_swaps_are_settled(spark, tmp_path):
    path = str(tmp_path / "t")
    for left, want in ((["t"], 3), (["t.old", "t.new"], 5), (["t.old"], 3), (["t", "t.old"], 3)):
        for name in left:
            spark.range(5 if name == "t.new" else 3).write.parquet(str(tmp_path / name))
        sinks.settle(spark, path)
        assert spark.read.parquet(path).count() == want and not (tmp_path / "t.old").exists()
        sinks.replace(spark, spark.read.parquet(path).limit(1), path)
        assert spark.read.parquet(path).count() == 1 and sorted(x.name for x in tmp_path.iterdir()) == ["t"]
        shutil.rmtree(path)


def test_shared_folder_off_local_masters(monkeypatch):
    class Context:
        master = "yarn"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(Session())
    assert session.is_local("local[4]") and session.is_local("local") and not session.is_local("local-cluster[2,1,512]")


def test_discard_removes_what_cut_wrote(spark):
    held = session.cut(spark.range(3).toDF("id"), "gone")
    path = held.__dict__["scratch_path_of_cut"].removeprefix("file://")
    assert held.count() == 3 and os.path.isdir(path)
    session.discard(held.where("id > 0"))
    assert os.path.isdir(path)
    session.discard(held)
    session.discard(None)
    assert not os.path.exists(path)
