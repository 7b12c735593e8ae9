import json
import random

import pytest
from pyspark.sql import functions as F

from caseloom.operators import ocel as logs
from caseloom.sources import ocel, xes

PLAIN = """<?xml version="1.0"?><log {ns}>
<{p}trace><{p}date key="d" value="2024-01-01T00:00:00Z"/><{p}string key="concept:name" value="t1"/><{p}string key="concept:name" value="second"/>
<{p}event><{p}string key="concept:name" value="A"/><{p}string key="x" value="1"/><{p}string key="x" value="2"/><{p}date key="time:timestamp" value="2024-01-01T10:00:00.500+02:00"/></{p}event>
<{p}event><{p}string key="concept:name" value="B"/><{p}string key="case_id" value="own"/></{p}event></{p}trace>
<{p}trace><{p}event><{p}string key="concept:name" value="C"/></{p}event></{p}trace>
<{p}trace><{p}string key="concept:name" value="empty"/></{p}trace></log>"""


def test_xes_with_and_without_prefix(spark, tmp_path):
    for name, ns, p in (("plain", 'xmlns="http://www.xes-standard.org/"', ""), ("prefixed", 'xmlns:q="http://www.xes-standard.org/"', "q:")):
        (tmp_path / f"{name}.xes").write_text(PLAIN.format(ns=ns, p=p))
        rows = xes.read_xes(spark, str(tmp_path / f"{name}.xes")).orderBy("activity").collect()
        assert [(r.case_id, r.pos, r.activity) for r in rows] == [("t1", 0, "A"), ("own", 1, "B"), (None, 0, "C")]
        assert rows[0].attrs["x"] == "2" and rows[0].ts.isoformat().startswith("2024-01-01T08:00:00.5") and rows[1].ts is None


def test_xes_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("c1", "A", "2024-01-01 00:00:01"), ("c1", "B", "2024-01-01 00:00:00.25"), ("c2", "A", "2024-02-01 00:00:00")], "case_id string, activity string, t string").select("case_id", "activity", F.to_timestamp("t").alias("ts"))
    xes.write_xes(df, str(tmp_path / "out"))
    back = xes.read_xes(spark, str(tmp_path / "out"))
    assert sorted((r.case_id, r.activity, r.ts) for r in back.collect()) == sorted((r.case_id, r.activity, r.ts) for r in df.collect())
    assert [r.activity for r in back.where("case_id = 'c1'").orderBy("pos").collect()] == ["B", "A"]


def test_csv_has_a_header(spark, tmp_path):
    xes.write_csv(spark.range(3).coalesce(1), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["id"]


def test_ocel(spark, tmp_path):
    (tmp_path / "log.jsonocel").write_text(
        '{"ocel:events": {"e1": {"ocel:activity": "A", "ocel:timestamp": "2024-01-01T00:00:00", "ocel:omap": ["o1", "o2"], "ocel:vmap": {"k": "v"}}, "e2": {"ocel:activity": "B", "ocel:timestamp": "2024-01-02T00:00:00", "ocel:omap": []}}, "ocel:objects": {"o1": {"ocel:type": "order", "ocel:ovmap": {"p": "1"}}, "o2": {"ocel:type": "item"}}}'
    )
    events, objects, relations = ocel.read_ocel(spark, str(tmp_path / "log.jsonocel"))
    assert (events.count(), objects.count(), relations.count()) == (2, 2, 2)
    ocel.write_ocel(events, objects, relations, str(tmp_path / "tables"))
    again = ocel.read_ocel_tables(spark, str(tmp_path / "tables"))
    assert sorted(map(str, again[2].select("eid", "oid", "type").collect())) == sorted(map(str, relations.collect()))


def whole(spark, path):
    """The same tables, each document read by one task."""
    doc = spark.read.schema(ocel.JSON).option("multiLine", True).json(path)
    e = doc.select(F.explode("ocel:events").alias("eid", "e")).select("eid", F.col("e.`ocel:activity`").alias("activity"), F.to_timestamp("e.`ocel:timestamp`").alias("ts"), F.col("e.`ocel:vmap`").alias("vmap"), F.col("e.`ocel:omap`").alias("omap"))
    objects = doc.select(F.explode("ocel:objects").alias("oid", "o")).select("oid", F.col("o.`ocel:type`").alias("type"), F.col("o.`ocel:ovmap`").alias("ovmap"))
    return e.drop("omap"), objects, e.select("eid", F.explode("omap").alias("oid")).join(objects.select("oid", "type"), "oid", "left").select("eid", "oid", "type")


def document(rng, n, odd):
    """A document whose names and values hold what its syntax is made of."""
    text = lambda: "".join(rng.choice(['"', "\\", "}", "{", "a", " ", "\n", "é", ",", ":", '\\"}', "ocel:events"]) for _ in range(rng.randrange(12))) if odd else str(rng.random())
    events = {f"e{i}{text()}": {"ocel:activity": text(), "ocel:timestamp": "2024-01-01T00:00:00", "ocel:omap": [f"o{rng.randrange(n)}" for _ in range(rng.randrange(3))], "ocel:vmap": {text(): text() for _ in range(rng.randrange(3))}} for i in range(n)}
    objects = {f"o{i}": {"ocel:type": text(), "ocel:ovmap": {text(): text()}} for i in range(n)}
    doc = {"ocel:global-event": {"ocel:activity": "__INVALID__"}, "ocel:global-log": {"ocel:version": "1.0", "names": ["a", "}"]}, "ocel:events": events, "note": text(), "ocel:objects": objects, "other": {"x": {"y": {}}}}
    if odd:
        events |= {"none": None, "bare": {}}
        objects["last"] = None
        doc |= {"more": {}, "ocel:objects": objects}
    return doc


@pytest.mark.parametrize("odd, indent", [(True, None), (True, 2), (False, None)])
def test_ocel_by_splits_equals_whole_documents(spark, tmp_path, odd, indent):
    rng = random.Random(3)
    path = tmp_path / "docs"
    path.mkdir()
    for i, n in enumerate((60, 0, 7)):
        (path / f"{i}.jsonocel").write_text(json.dumps(document(rng, n, odd), indent=indent, ensure_ascii=bool(i)) + "\n" * (i % 2), encoding="utf-8")
    (path / "empty.jsonocel").write_text("")
    (path / "bare.jsonocel").write_text("{}")
    (path / "turned.jsonocel").write_text('{"ocel:objects": {"o1": {"ocel:type": "t"}}, "ocel:events": {}}')
    want = [sorted(map(repr, df.collect())) for df in whole(spark, str(path))]
    assert all(want)
    for size in ("180", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = ocel.read_ocel(spark, str(path))
            assert [sorted(map(repr, df.collect())) for df in got] == want
            if size == "180":
                assert spark.read.option("lineSep", "}").text(f"{path}/0.jsonocel").rdd.getNumPartitions() > 30
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_bucketed_tables_move_no_relations(spark, tmp_path):
    events = spark.range(300).select(F.concat(F.lit("e"), "id").alias("eid"), F.lit("x").alias("activity"), F.col("id").alias("ts_us"))
    objects = spark.range(50).select(F.concat(F.lit("o"), "id").alias("oid"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("type"), F.col("id").alias("size"))
    relations = spark.range(900).select(F.concat(F.lit("e"), F.col("id") % 320).alias("eid"), F.concat(F.lit("o"), F.col("id") * 7 % 50).alias("oid"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("type"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ocel.save_ocel(events, objects, relations, "bucketed_log", 4)
        saved = ocel.load_ocel(spark, "bucketed_log")
        by_object = ocel.load_ocel(spark, "bucketed_log", "oid")
        jobs = [(lambda e, o, r: logs.event_objects(e, r), saved), (lambda e, o, r: logs.flatten_ocel(e, r, "odd"), saved), (lambda e, o, r: logs.orphan_objects(o, r), by_object)]
        for job, tables in jobs:
            out = job(*tables)
            assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(repr, out.collect())) == sorted(map(repr, job(events, objects, relations).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for t in ("events", "objects", "relations", "object_relations"):
            spark.sql(f"DROP TABLE IF EXISTS bucketed_log_{t}")
