"""The ledger as a stream: every run writes its own files, a query keeps the view of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lapidary.operators.ledger import EVENT


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Events of new shard files as they appear."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.jsonl").text(folder)
    e = F.from_json("value", EVENT, {"mode": "FAILFAST", "allowNonNumericNumbers": "true"})
    metrics = F.regexp_extract("value", r'"all_metrics"\s*:\s*(\{[^{}]*\})', 1)
    return raw.where(F.trim("value") != "").select(e.alias("e"), F.when(metrics != "", metrics).alias("all_metrics")).select("e.*", "all_metrics", F.col("e.timestamp").cast("timestamp").alias("at"))


def family_activity(events: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events per family, kind and time window; repeated events count once, those later than ``late`` are dropped."""
    e = events.withWatermark("at", late).dropDuplicatesWithinWatermark(["run_id", "event", "timestamp"])
    return e.groupBy(F.window("at", window).alias("w"), "family", "event").agg(F.count("*").alias("n"))


def keep_runs(spark: SparkSession, folder: str, view: str, checkpoint: str) -> StreamingQuery:
    """Maintain the folded view of runs at ``view``, for :func:`read_view`.

    A micro-batch adds its events to a log, under its number, so a repeated one
    replaces itself.  Only the runs it touches are folded again; the others are
    taken from the version before.  A version is a folder of its own and becomes
    current when it is complete, so readers never see half of one; the last but
    one is deleted.
    """
    from lapidary.operators.ledger import fold
    from lapidary.session import Files

    files = Files(spark)

    def update(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("at", F.struct(F.lit(number).alias("batch"), F.col("at").alias("t"), F.monotonically_increasing_id().alias("i")))
        rows.write.mode("overwrite").parquet(f"{view}/events/batch={number}")
        touched = spark.read.parquet(f"{view}/events/batch={number}").select("run_id").distinct()
        events, current = spark.read.parquet(f"{view}/events").drop("batch"), _current(files, view)
        if current is not None and current < number:
            runs = fold(events.join(touched, "run_id", "left_semi"))
            runs = runs.unionByName(spark.read.parquet(f"{view}/runs/{current}").join(touched, "run_id", "left_anti"))
        else:
            runs = fold(events)
        runs.write.mode("overwrite").parquet(f"{view}/runs/{number}")
        files.write(f"{view}/current", f"{number}\n")
        for old in range(number - 2, -1, -1):
            if not files.exists(f"{view}/runs/{old}"):
                break
            files.delete(f"{view}/runs/{old}")

    return event_stream(spark, folder).writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _current(files, view: str) -> int | None:
    return int(files.read(f"{view}/current")) if files.exists(f"{view}/current") else None


def read_view(spark: SparkSession, view: str) -> DataFrame:
    """The current version of the view of runs; an error if there is none yet."""
    from lapidary.session import Files

    current = _current(Files(spark), view)
    if current is None:
        raise FileNotFoundError(f"no view of runs at {view}")
    return spark.read.parquet(f"{view}/runs/{current}")
