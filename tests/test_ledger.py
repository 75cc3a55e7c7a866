import json
import math
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from lapidary.operators import ledger as L


def test_life_of_runs(spark, tmp_path):
    led = L.Ledger(spark, str(tmp_path))
    a = led.register("f", "h", 1, phase="p1", selection_metric="loss")
    b = led.register("f", "h", 2)
    c = led.register("g", "h", 1)
    n = {r["run_id"]: r["n_variants_tried_so_far_in_this_family"] for r in led.runs().collect()}
    assert (n[a], n[b], n[c]) == (1, 2, 1)
    led.complete(a, metrics={"loss": math.inf, "ok": True, "acc": 0.5})
    r = L.show_run(led.runs(), a)
    assert r["status"] == "completed"
    m = led.runs().where(F.col("run_id") == a).select(L.metric("all_metrics", F.lit("loss")), L.metric("all_metrics", F.lit("ok")), L.metric("all_metrics", F.lit("acc")), L.metric("all_metrics", F.lit("no"))).first()
    assert m[0] == math.inf and m[1] is None and m[2] == 0.5 and m[3] is None
    for bad in (lambda: led.complete(a), lambda: led.complete("x"), lambda: led.complete(b, "done"), lambda: led.register("f", " ", 1), lambda: led.register("f", "h", True), lambda: L.show_run(led.runs(), "x")):
        with pytest.raises(L.LedgerError):
            bad()
    with pytest.raises(KeyError):
        with led.run("g", "h", 3) as (run_id, metrics):
            metrics["x"] = 1
            raise KeyError("boom")
    r = L.show_run(led.runs(), run_id)
    assert r["status"] == "failed" and "KeyError" in r["notes"] and json.loads(r["all_metrics"]) == {"x": 1}
    before = led.runs().count()
    assert led.compact() == 6 and led.compact() == 0 and led.runs().count() == before
    assert {r["family"]: (r["registered"], r["failed"], r["open"]) for r in L.family_counts(led.runs()).collect()} == {"f": (2, 0, 1), "g": (2, 1, 1)}


def test_concurrent_writers(spark, tmp_path):
    led = L.Ledger(spark, str(tmp_path))
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda i: led._append({"event": "register", "run_id": f"r{i}", "timestamp": "t", "family": "f", "seed": i}), range(8)))
    assert led.runs().count() == 8


def test_corrupt_and_contradicting(spark, tmp_path):
    led = L.Ledger(spark, str(tmp_path))
    led._append({"event": "register", "run_id": "r", "timestamp": "t1", "family": "f"})
    led._append({"event": "register", "run_id": "r", "timestamp": "t1", "family": "f"})
    assert led.runs().count() == 1
    led._append({"event": "register", "run_id": "r", "timestamp": "t2", "family": "f"})
    with pytest.raises(Exception, match="twice"):
        led.runs().collect()
    other = L.Ledger(spark, str(tmp_path / "o"))
    other._append({"event": "complete", "run_id": "q", "timestamp": "t1"})
    with pytest.raises(Exception, match="unknown run"):
        other.runs().collect()
    (tmp_path / "o" / "ledger.d" / "bad.jsonl").write_text("{not json\n")
    with pytest.raises(Exception):
        other.runs().collect()


def runs(spark, rows):
    return spark.createDataFrame([(*r, "completed") for r in rows], "family string, seed long, config_hash string, value double, status string")


def test_report(spark):
    r = runs(spark, [("f", 1, "a", 0.5), ("f", 1, "b", 0.7), ("f", 2, "a", 0.55), ("f", 2, "b", 0.75), ("g", 1, "a", None)])
    v = L.family_values(r).first()
    assert (v["best"], v["median"], v["worst"], v["n_values"]) == (0.75, 0.625, 0.5, 4)
    assert L.family_values(r, larger_is_better=False).first()["best"] == 0.5
    assert L.family_value_list(r).first()["values"] == [0.75, 0.7, 0.55, 0.5]
    assert L.rank_stability(r).first()["rank_stability"] == 1.0
    assert L.rank_stability(runs(spark, [("f", 1, "a", 0.9), ("f", 1, "b", 0.1), ("f", 2, "a", 0.1), ("f", 2, "b", 0.9)])).first()["rank_stability"] == -1.0
    assert L.rank_stability(runs(spark, [("f", 1, "a", 0.9)])).count() == 0
    t = spark.createDataFrame([("x", "i", 1.0, 2.0)], "g string, i string, a double, b double")
    assert math.isnan(L.kendall_tau(t, ["g"], "i", "a", "b").first()["tau"])
    assert L.family_report(r).count() == 2 and L.family_counts(r.limit(0)).count() == 0


def test_lines_and_recovery(spark):
    df = lambda *x: spark.createDataFrame([(i,) for i in x], "line string")
    assert sorted(r[0].strip() for r in L.merge_lines(df("a", " ", "b"), df("b ", "c", "c")).collect()) == ["a", "b", "c"]
    logs, cfg = spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, steps long"), spark.createDataFrame([("r1", "f"), ("r2", "f"), ("r3", "f")], "run_id string, family string")
    assert [r["run_id"] for r in L.missing_runs(logs, cfg, spark.createDataFrame([("r1",)], "run_id string")).collect()] == ["r2"]


def test_stream(spark, tmp_path):
    from lapidary.streaming.ledger import event_stream, family_activity, keep_runs, read_view

    led = L.Ledger(spark, str(tmp_path / "l"))
    ts = "2026-01-05T00:31:57+00:00"
    for i in range(3):
        led._append({"event": "register", "run_id": f"r{i}", "timestamp": ts, "family": "f", "seed": i})
    shards, view, cp = str(tmp_path / "l" / "ledger.d"), str(tmp_path / "v"), str(tmp_path / "c")
    keep_runs(spark, shards, view, cp).awaitTermination()
    assert read_view(spark, view).count() == 3
    led._append({"event": "register", "run_id": "r9", "timestamp": ts, "family": "g", "seed": 9})
    led._append({"event": "complete", "run_id": "r1", "timestamp": ts, "status": "failed", "notes": "late"})
    keep_runs(spark, shards, view, cp).awaitTermination()
    assert {r["run_id"]: r["status"] for r in read_view(spark, view).collect()} == {"r0": "registered", "r1": "failed", "r2": "registered", "r9": "registered"}
    q = family_activity(event_stream(spark, shards)).writeStream.format("memory").queryName("activity").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["family"]: r["n"] for r in spark.table("activity").where("event = 'register'").collect()} == {"f": 3, "g": 1}
