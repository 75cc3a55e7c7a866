"""What all sources share: record layout, ordered line scans, raw-data checks."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lapidary.session import ranked_within

RECORD = "corpus string, doc_id string, sent_id string, fields map<string,string>, meta map<string,string>, ord long"


class NotIngestable(RuntimeError):
    """A source that cannot be read, with the way to get it."""


def require_raw(path: str, hint: str) -> str:
    """``path`` if it exists (locally; other file systems are left to the reader), else an error with ``hint``."""
    if "://" not in path and not os.path.exists(path):
        raise NotIngestable(f"{path} is missing; fetch it with: {hint}")
    return path


def path_key(path: Column) -> Column:
    """Sorts paths component by component."""
    return F.translate(path, "/", "\x01")


def relative(path: Column, root: str) -> Column:
    """Part of a file path behind ``root``."""
    return F.regexp_replace(path, "^(file:)?/*" + "\\Q" + root.strip("/") + "\\E/*", "")


def files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``(path, length, rel)`` below ``root``; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return df.select("path", "length", relative(F.regexp_replace("path", "^file:", ""), root).alias("rel"))


def whole_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """``(rel, content)`` of small files."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return df.select(relative(F.regexp_replace("path", "^file:", ""), root).alias("rel"), "content")


def lines(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``(file, block, seq, value)``: lines of text files; (file, block, seq) is their order.

    A large file is read in blocks by several tasks: ``block`` is the offset of a
    block and ``seq`` grows within it.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root)
    return raw.select(
        relative(F.regexp_replace(F.col("_metadata.file_path"), "^file:", ""), root).alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"),
        F.regexp_replace("value", r"\r$", "").alias("value"),
    )


def running_count(df: DataFrame, flag: Column, name: str) -> DataFrame:
    """Number of rows with ``flag`` up to and with each line of its file.

    Counted within blocks and offset by the blocks before, so one large file is
    no single task.
    """
    rows = df.withColumn("__f", F.coalesce(flag.cast("int"), F.lit(0)))
    inner = F.sum("__f").over(W.partitionBy("file", "block").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    blocks = rows.groupBy("file", "block").agg(F.sum("__f").alias("__s"))
    w = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = blocks.select("file", "block", F.coalesce(F.sum("__s").over(w), F.lit(0)).alias("__b"))
    return rows.withColumn("__i", inner).join(before, ["file", "block"]).withColumn(name, F.col("__i") + F.col("__b")).drop("__f", "__i", "__b")


def as_records(df: DataFrame, corpus: str, order: list[str]) -> DataFrame:
    """``(doc_id, sent_id, fields, meta)`` in ``order`` -> records with consecutive ``ord``."""
    ranked = ranked_within(df, [], order, "ord")
    out = ranked.select(F.lit(corpus).alias("corpus"), "doc_id", "sent_id", "fields", "meta", F.col("ord").cast("long").alias("ord"))
    return out


def pairs(**cols: Column) -> Column:
    """A map of the given columns without the null ones."""
    m = F.create_map(*[x for k, c in cols.items() for x in (F.lit(k), c)])
    return F.map_filter(m, lambda k, v: v.isNotNull())




def write_files(contents: DataFrame, root: str) -> int:
    """Write ``contents(rel, content)``, a small file a row, below ``root``; returns the number of files.

    Tasks write their own rows through Arrow's file systems; a repeated task
    writes the same files again.  A null content is an empty file.
    """

    def put(parts):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        for pdf in parts:
            for rel, content in zip(pdf["rel"], pdf["content"]):
                path = f"{base}/{rel}"
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(path) as f:
                    f.write((content or "").encode("utf-8", "surrogatepass"))
            yield pdf[["rel"]]

    return contents.select("rel", "content").mapInPandas(put, "rel string").count()
