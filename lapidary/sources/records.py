"""Record files: one JSON object per line, keys sorted, and the table form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapidary.functions.hashing import content_hash
from lapidary.session import ranked_within

SCHEMA = "corpus string, doc_id string, fields map<string,string>, meta map<string,string>, sent_id string"


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON lines in file order; blank lines are skipped, a missing ``meta`` is empty, anything else malformed is an error."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("s"), "value")
    r = raw.where(F.trim("value") != "").withColumn("r", F.from_json("value", SCHEMA, {"mode": "FAILFAST"}))
    empty = F.create_map().cast("map<string,string>")
    cols = r.select("f", "b", "s", "r.corpus", "r.doc_id", "r.sent_id", "r.fields", F.coalesce("r.meta", empty).alias("meta"))
    return _ordered(cols)


def _ordered(cols: DataFrame) -> DataFrame:
    r = ranked_within(cols, [], ["f", "b", "s"], "ord")
    return r.select("corpus", "doc_id", "sent_id", "fields", "meta", F.col("ord").cast("long").alias("ord"))


def to_json_lines(records: DataFrame) -> DataFrame:
    """``(value)``: sorted keys, non-ASCII kept, map entries by key."""

    def sorted_map(c: str):
        e = F.transform(F.sort_array(F.map_entries(c)), lambda x: F.concat(_quoted(x["key"]), F.lit(": "), F.coalesce(_quoted(x["value"]), F.lit("null"))))
        return F.concat(F.lit("{"), F.array_join(e, ", "), F.lit("}"))

    one = [("corpus", _quoted(F.col("corpus"))), ("doc_id", _quoted(F.col("doc_id"))), ("fields", sorted_map("fields")), ("meta", sorted_map("meta")), ("sent_id", _quoted(F.col("sent_id")))]
    body = F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), F.coalesce(c, F.lit("null"))) for k, c in one])
    return records.select(F.concat(F.lit("{"), body, F.lit("}")).alias("value"))


def _quoted(c: Column) -> Column:
    """A JSON string of a column; null stays null."""
    return F.when(c.isNotNull(), F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1))


def write_jsonl(records: DataFrame, path: str) -> int:
    """Overwrite ``path`` with JSON lines in order of ``ord``; returns the number of lines."""
    ordered = records.repartitionByRange("ord").sortWithinPartitions("ord")
    to_json_lines(ordered).write.mode("overwrite").text(path)
    return records.sparkSession.read.text(path).count()


def data_version(records: DataFrame) -> str:
    """12 hex of the content, whatever the files."""
    return content_hash(records.select("corpus", "doc_id", "sent_id", "fields", "meta"))[:12]
