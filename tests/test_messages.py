import datetime as dt

from pyspark.sql import functions as F

from lapidary.operators.messages import MessageIndex, identifier, surplus_deliveries

SCHEMA = "delivery_id long, batch_id long, received_at timestamp, run_id string, status string, completed_at string, id string"
T = lambda m: dt.datetime(2026, 1, 1, 0, m)


def deliveries(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


ROWS = [
    (1, 0, T(5), "A1", "completed", "2026-01-10T22:41:05Z"),
    (2, 1, T(3), " a1\n", "Completed ", "2026-01-10T22:41:05.900+00:00"),  # the same, earlier, in a later batch
    (3, 1, T(3), "a1", "completed", "2026-01-10T17:41:05-05:00"),  # the same at the same time
    (4, 2, T(9), "a1", "completed", "2026-01-10T22:41:06Z"),
    (5, 2, T(1), "a1", "registered", None),
    (6, 3, T(2), "a1", "registered", " "),
    (7, None, None, None, None, None),
    (8, 3, T(4), None, None, None),
    (9, 3, T(4), "b", "x", "soon"),
    (10, 3, T(4), "b", "x", "Soon"),
]


def test_surplus(spark):
    want = {1, 3, 6, 7, 10}
    for rounds in (1, 4):
        for n in (1, 5):
            assert {r[0] for r in surplus_deliveries(deliveries(spark, ROWS).repartition(n), rounds).collect()} == want
    assert surplus_deliveries(deliveries(spark, [])).count() == 0


def test_index_is_idempotent_and_merges(spark):
    ix = MessageIndex(spark, prefix_bits=2, most_runs=2)
    d = deliveries(spark, ROWS).select(identifier().alias("id"), "received_at", "delivery_id")
    for _ in range(4):
        ix.ingest(d)
    assert len(ix.runs()) <= 2
    assert {r[0] for r in ix.keepers().collect()} == {2, 4, 5, 8, 9}


def test_prefixes_lengthen_and_runs_merge_in_tiers(spark, monkeypatch):
    """Longer prefixes as identifiers come in, small runs merged with small ones, merged ones deleted."""
    from lapidary.operators import messages

    monkeypatch.setattr(messages, "PREFIX", 100)
    ix = MessageIndex(spark, prefix_bits=1, most_runs=3)
    rows = lambda a, b: spark.range(a, b).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("id"), F.timestamp_seconds(F.col("id")).alias("received_at"), F.col("id").alias("delivery_id"))
    at, firsts = 0, []
    for n in (1000, 40, 300, 90, 90, 90):
        ix.ingest(rows(max(at - 10, 0), at + n))
        at += n
        runs = ix.runs()
        assert len(runs) <= 3 and len(ix._listed()) == len(runs)
        firsts.append(runs[0][:2])
    assert firsts == [(0, 0)] * 6 and runs[0][2] < runs[-1][2]  # the large run was not written again
    assert sorted(r[0] for r in ix.keepers().collect()) == list(range(at))


def test_hot_message(spark):
    hot = spark.range(3000).select(F.col("id").alias("delivery_id"), (F.col("id") % 7).alias("batch_id"), F.timestamp_seconds(F.col("id") + 100).alias("received_at"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("run_id"), F.lit("s").alias("status"), F.lit(None).cast("string").alias("completed_at"))
    assert surplus_deliveries(hot).count() == 999


def test_stream(spark, tmp_path):
    from lapidary.streaming.messages import ingest_stream

    deliveries(spark, ROWS[:4]).write.parquet(str(tmp_path / "in"))
    ix = MessageIndex(spark)
    src = lambda: spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    ingest_stream(src(), ix, str(tmp_path / "cp")).awaitTermination()
    deliveries(spark, ROWS[4:]).write.mode("append").parquet(str(tmp_path / "in"))
    ingest_stream(src(), ix, str(tmp_path / "cp")).awaitTermination()
    assert {r[0] for r in ix.keepers().collect()} == {2, 4, 5, 8, 9}
